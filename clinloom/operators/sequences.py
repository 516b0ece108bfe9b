"""Token sequences as corpus-level Spark jobs.

No pretrained vocabulary ships with the data, so the vocabulary is built from the
corpus (A15); an external tokenizer can be plugged in through ``hooks.apply_tokenizer``.

Scale notes
  * tokens are never shuffled: encoding maps whole token arrays in place (Arrow batches)
    against the vocabulary's most frequent entries, broadcast within a byte bound; where the
    vocabulary is larger, the tokens that miss them are written with the row and only those are
    joined with the rare tail.
  * block packing never explodes per token: each document explodes once per block it
    overlaps, and a block gathers at most ``block`` document pieces.
  * global order never comes from a window over the data: vocabulary ids come from
    ``global_rank``; document offsets come from hash buckets (hash order) or
    ``global_rank`` over (key, length) only and join the id arrays afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.operators.joins import sized_broadcast
from clinloom.operators.ranking import global_rank, hash_rank
from clinloom.session import materialise

# Fixed ids of the special tokens of the corpus vocabulary (this library's choice).
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
N_SPECIAL = len(SPECIAL_TOKENS)
IGNORE_LABEL = -100

# Words (letters, digits, underscore) or single other non-space characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokenize(c: Column, lower: bool = True) -> Column:
    """Q1: text -> array of tokens (lower-cased by default, like an uncased vocabulary)."""
    t = F.lower(c) if lower else c
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def build_vocab(df: DataFrame, tokens: str = "tokens", min_count: int = 1, max_size: int | None = None) -> DataFrame:
    """Token -> id by descending frequency, ties by token; ids start after the specials.

    Counting is a partial aggregate; ids are the distributed rank.  ``max_size`` caps the
    vocabulary size (total ids including specials), a parameter of the vocabulary
    itself.  Output: token, n, id.
    """
    counts = (df.select(F.explode(tokens).alias("token"))
                .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= min_count)
                .withColumn("_neg", -F.col("n")))
    ranked = global_rank(counts, ["_neg", "token"], rank_col="_r")
    out = ranked.select("token", "n", (F.col("_r") + N_SPECIAL).cast("int").alias("id"))
    if max_size is not None:
        out = out.where(F.col("id") < max_size)
    return out


HEAD_BYTES = 64 << 20


def _head_limit(vocab: DataFrame, head_bytes: int) -> int | None:
    """None when the whole vocabulary holds at most ``head_bytes``; else the id below which it does."""
    size = vocab.agg(F.sum(F.octet_length("token") + F.lit(20)).alias("b"), F.max("id").alias("m"),
                     F.max(F.octet_length("token") + F.lit(20)).alias("w")).first()
    if (size["b"] or 0) <= head_bytes:
        return None
    # ids follow the frequency; an id range of bytes / longest entry is safe for any lengths
    low, high = N_SPECIAL + max(1, head_bytes // size["w"]), size["m"] + 1
    while high - low > max(1, low // 8):                     # a few aggregates: the largest range within the bound
        mid = (low + high) // 2
        b = vocab.where(F.col("id") < mid).agg(F.sum(F.octet_length("token") + F.lit(20))).first()[0] or 0
        low, high = (mid, high) if b <= head_bytes else (low, mid)
    return low


class HeadTable:
    """The head of a vocabulary as sorted hashes: built once a worker, asked for each batch's distinct tokens.

    A hash only proposes an entry; the token itself decides.
    """

    def __init__(self, words, ids):
        import numpy as np
        import pandas as pd
        h = np.zeros(len(words), np.uint64)
        for at in range(0, len(words), HASH_ROWS):                # Python strings of one run at a time
            run = words.slice(at, HASH_ROWS).to_numpy(zero_copy_only=False)
            h[at:at + HASH_ROWS] = pd.util.hash_array(run)
        order = np.argsort(h, kind="stable")
        self.hashes, self.order, self.words, self.ids = h[order], order.astype(np.int32), words, ids
        same = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        clash = np.unique(np.concatenate([order[same], order[same + 1]]))
        self.clash = {words[int(i)].as_py(): int(ids[i]) for i in clash}

    def __call__(self, tokens):
        """Ids of an Arrow array of distinct tokens; -1 for those outside the head."""
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc
        out = np.full(len(tokens), -1, np.int64)
        if len(tokens) and len(self.words):
            h = pd.util.hash_array(tokens.to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            i = np.flatnonzero(self.hashes[at] == h)
            place = self.order[at[i]]
            same = pc.equal(tokens.take(pa.array(i)), self.words.take(pa.array(place))).to_numpy(zero_copy_only=False)
            out[i[same]] = self.ids[place[same]]
        for token, i in self.clash.items():
            out[pc.equal(tokens, token).to_numpy(zero_copy_only=False)] = i
        return out


HASH_ROWS = 1 << 16
MISSES, CODES = "_misses", "_codes"


def _map_arrays(df: DataFrame, head, token_cols: Sequence[str], suffix: str, keep_misses: bool) -> DataFrame:
    """Replace token arrays by id arrays in place.

    With ``keep_misses`` the row's i-th distinct token outside the head takes the code -1 - i and
    stands in ``_misses`` (null where a row misses none); without, it takes UNK.
    """
    from pyspark.sql import types as T

    from clinloom.operators.worker import fresh_key, pieces, resident
    others = [f for f in df.schema.fields if f.name not in token_cols]
    ids_type = T.ArrayType(T.IntegerType())
    schema = T.StructType(others + [T.StructField(c + suffix, ids_type) for c in token_cols]
                          + ([T.StructField(MISSES, T.ArrayType(T.StringType()))] if keep_misses else []))
    key = fresh_key()

    def convert(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        table = resident(key, lambda: HeadTable(*head.value))
        for batch in (p for b in batches for p in pieces(b)):
            rows = batch.num_rows
            parts, flats = [], []
            for c in token_cols:
                col = batch.column(c)
                size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                parts.append(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                flats.append(col.flatten())
            coded = pa.chunked_array(flats, pa.string()).combine_chunks().dictionary_encode() if flats else None
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            if coded.null_count:
                raise ValueError("a token is null")
            which = coded.indices.to_numpy(zero_copy_only=False)
            ids = table(coded.dictionary)
            got = (ids[which] if len(ids) else np.zeros(0, np.int64)).astype(np.int32)
            miss = np.flatnonzero(got < 0)
            row = np.concatenate([np.repeat(np.arange(rows), np.diff(off)) for off in parts])
            held = pa.array([None] * rows, pa.list_(pa.string()))
            if not keep_misses:
                got[miss] = UNK_ID
            elif len(miss):                                       # number a row's missing tokens once each
                pair, back = np.unique(row[miss] * np.int64(len(ids)) + which[miss], return_inverse=True)
                owner = pair // len(ids)
                first = np.searchsorted(owner, np.arange(rows + 1))
                got[miss] = -1 - (back - first[row[miss]])
                held = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)),
                                                coded.dictionary.take(pa.array(pair % len(ids))).cast(pa.string()),
                                                mask=pa.array(np.diff(first) == 0))
            out, at = [batch.column(f.name) for f in others], 0
            for off in parts:
                out.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(got[at:at + off[-1]])))
                at += off[-1]
            if keep_misses:
                out.append(held)
            yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    return df.mapInArrow(convert, schema)


def _fill_codes(df: DataFrame, id_cols: Sequence[str], found: str) -> DataFrame:
    """Replace the codes -1 - i of ``id_cols`` by the row's ``found`` ids (i, id); UNK where there is none."""
    from pyspark.sql import types as T

    from clinloom.operators.worker import pieces
    schema = T.StructType([f for f in df.schema.fields if f.name != found])

    def fill(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in (p for b in batches for p in pieces(b)):
            col = batch.column(found)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            flat = col.flatten()
            i, ids = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("i", "id"))
            owner = np.repeat(np.arange(batch.num_rows), size)
            out, arrays = {}, {}
            for c in id_cols:
                a = batch.column(c)
                n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
                arrays[c] = (np.concatenate([[0], np.cumsum(n)]).astype(np.int32), np.repeat(np.arange(batch.num_rows), n),
                             a.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            width = 1 + max([int(i.max(initial=0)), *(int(-v.min(initial=0)) for _, _, v in arrays.values())])
            keys = owner * width + i                              # one number per (row, code)
            order = np.argsort(keys, kind="stable")
            keys, known = keys[order], ids[order]
            for c, (off, row, v) in arrays.items():
                code = np.flatnonzero(v < 0)
                want = row[code] * width + (-1 - v[code])
                at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
                v = v.copy()
                v[code] = np.where(keys[at] == want, known[at], UNK_ID) if len(keys) else UNK_ID
                out[c] = pa.ListArray.from_arrays(pa.array(off), pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([out.get(f, batch.column(f)) for f in schema.fieldNames()],
                                             names=schema.fieldNames())

    return df.mapInArrow(fill, schema)


def resolve_misses(coded: DataFrame, keys: Sequence[str], tail: DataFrame) -> DataFrame:
    """(keys, ``_codes``: array of (i, id)): ids of the rows' missing tokens that the tail of the vocabulary holds.

    The distinct missing tokens of all rows meet the tail first, one row per token on either
    side; what the vocabulary does not hold, however frequent, goes no further than its
    own row's entry in the second join, which adaptive execution can split.
    """
    misses = coded.where(F.col(MISSES).isNotNull()).select(*keys, F.posexplode(MISSES).alias("i", "token"))
    known = materialise(misses.select("token").distinct().join(tail, "token"), "known-misses")
    return (misses.join(sized_broadcast(known), "token")
            .groupBy(*keys).agg(F.collect_list(F.struct("i", "id")).alias(CODES)))


def encode(df: DataFrame, key: Sequence[str] | str, token_cols: Sequence[str], vocab: DataFrame,
           head_bytes: int = HEAD_BYTES, suffix: str = "_ids", carry: Sequence[str] = ()) -> DataFrame:
    """Q2: token arrays -> id arrays for one or more token columns in one pass; unknown -> UNK.

    ``key`` must be unique per row.  ``carry`` names columns that stay with the row.  The
    vocabulary's most frequent entries within ``head_bytes`` are broadcast and arrays are
    mapped in place.  Where the vocabulary is larger, the mapped rows are written once with the
    tokens that missed; only these tokens -- never one the head holds -- are joined with the
    tail, and only rows that miss any take part in a shuffle.  Output: key columns + carry
    columns + ``<col><suffix>`` per token column.
    """
    keys = [key] if isinstance(key, str) else list(key)
    extra = [c for c in carry if c not in keys]
    cols = list(token_cols)
    rows = df.select(*keys, *extra, *cols)
    v = vocab.select("token", "id")
    limit = _head_limit(v, head_bytes)
    table = (v if limit is None else v.where(F.col("id") < limit)).toArrow()
    words = table.column("token").combine_chunks()
    head = df.sparkSession.sparkContext.broadcast((words, table.column("id").to_numpy()))
    if limit is None:
        return _map_arrays(rows, head, cols, suffix, False)
    coded = materialise(_map_arrays(rows, head, cols, suffix, True), "coded")
    found = resolve_misses(coded, keys, v.where(F.col("id") >= limit))
    whole = coded.where(F.col(MISSES).isNull()).drop(MISSES)
    partly = coded.where(F.col(MISSES).isNotNull()).drop(MISSES).join(found, keys, "left")
    return whole.unionByName(_fill_codes(partly, [c + suffix for c in cols], CODES))


def truncate(c: Column, max_len: int, reserve: int = 2) -> Column:
    """Q3: keep the first ``max_len - reserve`` items (room for special tokens)."""
    return F.slice(c, 1, max_len - reserve)


def truncated_pair_lengths(la: Column, lb: Column, m: int):
    """Q4 closed form of 'pop from the longer, ties from b, until la + lb <= m'."""
    over = (la + lb) > m
    a_len = F.least(la, F.greatest(F.lit(m) - lb, F.lit((m + 1) // 2)))
    b_len = F.least(lb, F.greatest(F.lit(m) - la, F.lit(m // 2)))
    return F.when(over, a_len).otherwise(la), F.when(over, b_len).otherwise(lb)


def truncate_pair(a: Column, b: Column, m: int):
    """Q4: truncate two sequences so that their total length is at most ``m``."""
    la, lb = F.size(a), F.size(b)
    na, nb = truncated_pair_lengths(la, lb, m)
    return F.slice(a, 1, na), F.slice(b, 1, nb)


def truncate_only_first(a: Column, b: Column, m: int) -> Column:
    """Q7: truncate only the first sequence so that the pair fits in ``m``."""
    return F.slice(a, 1, F.greatest(F.lit(m) - F.size(b), F.lit(0)))


def pad(c: Column, length: int | Column, value: int = PAD_ID) -> Column:
    """Q6: right-pad to ``length`` (no-op when already long enough)."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(c, F.array_repeat(F.lit(value), F.greatest(n - F.size(c), F.lit(0))))


def pad_longest(df: DataFrame, ids: str, batch: str = "batch_id", value: int = PAD_ID,
                max_len: int | None = None, out_col: str = "input_ids") -> DataFrame:
    """Q6, ``longest`` mode: pad each row to the longest row of its batch (at most ``max_len``).

    The batch maximum is a grouped aggregate (one row per batch) joined back.
    """
    size = F.size(ids) if max_len is None else F.least(F.size(ids), F.lit(max_len))
    longest = df.groupBy(batch).agg(F.max(size).alias("_longest"))
    return (df.join(longest, batch)
              .withColumn(out_col, pad(F.slice(F.col(ids), 1, F.col("_longest")), F.col("_longest"), value))
              .drop("_longest"))


def length_mask(n: Column, length: int) -> Column:
    """Q8: 1 for positions below ``n``, 0 after, ``length`` positions."""
    ones = F.least(F.greatest(n, F.lit(0)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(length) - ones))


def pair_features(df: DataFrame, a: str, b: str, max_len: int) -> DataFrame:
    """Q5: ``[CLS] a [SEP] b [SEP]`` (or ``[CLS] a [SEP]`` when b is empty), zero-padded.

    Adds input_ids, segment_ids, input_mask (each ``max_len`` long) and seq_len (the
    pre-truncation length a + b, logged by the reference as the max pair length).
    """
    has_b = F.col(b).isNotNull() & (F.size(F.col(b)) > 0)
    ta_pair, tb_pair = truncate_pair(F.col(a), F.col(b), max_len - 3)
    ta = F.when(has_b, ta_pair).otherwise(truncate(F.col(a), max_len, 2))
    tb = F.when(has_b, tb_pair).otherwise(F.array().cast("array<int>"))
    cls, sep = F.array(F.lit(CLS_ID)), F.array(F.lit(SEP_ID))
    first = F.concat(cls, ta, sep)
    second = F.when(has_b, F.concat(tb, sep)).otherwise(F.array().cast("array<int>"))
    ids = F.concat(first, second)
    seg = F.concat(F.array_repeat(F.lit(0), F.size(first)), F.array_repeat(F.lit(1), F.size(second)))
    return df.select("*",
                     pad(ids, max_len).alias("input_ids"),
                     pad(seg, max_len, 0).alias("segment_ids"),
                     length_mask(F.size(ids), max_len).alias("input_mask"),
                     (F.size(F.col(a)) + F.when(has_b, F.size(F.col(b))).otherwise(0)).alias("seq_len"))


def line_blocks(df: DataFrame, ids: str, block: int) -> DataFrame:
    """Q10: one line = one example: truncated to ``block - 2``, wrapped, padded to ``block``."""
    wrapped = F.concat(F.array(F.lit(CLS_ID)), truncate(F.col(ids), block, 2), F.array(F.lit(SEP_ID)))
    return df.withColumn("input_ids", pad(wrapped, block)).withColumn(
        "attention_mask", length_mask(F.size(wrapped), block))


def pack_blocks(df: DataFrame, order: str, ids: str, block: int, add_special: bool = True,
                order_is_hash: bool = False) -> DataFrame:
    """Q9: concatenate every document's ids in ``order``, cut blocks, drop the short tail.

    With ``add_special`` each block holds ``block - 2`` content ids wrapped in
    [CLS] ... [SEP] (the text-dataset rule).  ``order`` must be unique.
    ``order_is_hash``: the order column is a uniform hex hash (e.g. md5 of the text);
    offsets then come from hash buckets instead of a range partitioning.  Either way they
    are computed on (order, length) alone and joined to the id arrays, which are written
    once.  Output: block_id, input_ids.
    """
    size = block - 2 if add_special else block
    docs = materialise(df.select(order, ids, F.size(ids).alias("_n")).where(F.col("_n") > 0), "encoded")
    narrow = docs.select(order, "_n")
    offs = (hash_rank(narrow, order, rank_col="_doc", total_col=None, weight="_n", offset_col="_off")
            if order_is_hash else global_rank(narrow, [order], weight="_n", rank_col="_doc", offset_col="_off"))
    docs = docs.join(sized_broadcast(materialise(offs.select(order, "_off"), "offsets")), order)
    first_b = F.floor(F.col("_off") / size)
    last_b = F.floor((F.col("_off") + F.col("_n") - 1) / size)
    pieces = docs.select(order, ids, "_off", "_n", F.explode(F.sequence(first_b, last_b)).alias("block_id"))
    start = F.greatest(F.col("block_id") * size - F.col("_off"), F.lit(0))
    end = F.least((F.col("block_id") + 1) * size - F.col("_off"), F.col("_n"))
    pieces = pieces.select("block_id", F.col(order).alias("_o"),
                           F.slice(F.col(ids), (start + 1).cast("int"), (end - start).cast("int")).alias("_piece"))
    blocks = (pieces.groupBy("block_id")
                    .agg(F.sort_array(F.collect_list(F.struct("_o", "_piece"))).getField("_piece").alias("_p"))
                    .select(F.col("block_id").cast("bigint").alias("block_id"),
                            F.flatten("_p").alias("input_ids"))
                    .where(F.size("input_ids") == size))
    if add_special:
        blocks = blocks.withColumn("input_ids", F.concat(F.array(F.lit(CLS_ID)), "input_ids", F.array(F.lit(SEP_ID))))
    return blocks


# The draws' generator works modulo this prime: products stay below 2**62.
_PRIME = 2147483647


def mask_tokens(df: DataFrame, ids: str, block_key: str, vocab_size: int, seed: int = 42,
                p: float = 0.15) -> DataFrame:
    """Q11: masked-LM inputs and labels, deterministic per (seed, block, position).

    Non-special positions are chosen with probability ``p``; of those 80% become
    [MASK], 10% a random id in [N_SPECIAL, vocab_size), 10% stay.  Labels hold the
    original id at chosen positions and -100 elsewhere.  One md5 per block seeds it; a
    position's three draws follow by squaring and multiplying modulo a prime, in 64-bit
    integers over the flat ids of a batch.  A null id may be masked and has no label.
    """
    from pyspark.sql import types as T

    from clinloom.operators.worker import pieces
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(block_key).cast("string"))), 1, 7),
                   16, 10).cast("bigint")
    kind = df.schema[ids].dataType
    fields = [f for f in df.schema.fields if f.name not in ("masked_ids", "labels")]
    schema = T.StructType(fields + [T.StructField("masked_ids", kind), T.StructField("labels", kind)])
    names, span = [f.name for f in fields], vocab_size - N_SPECIAL

    def draw(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in (b for whole in batches for b in pieces(whole)):
            col, start = batch.column(ids), batch.column("_start").to_numpy(zero_copy_only=False)
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(n)])
            flat = col.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            x = pc.fill_null(flat, N_SPECIAL).to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.arange(len(x)) - np.repeat(off[:-1], n)
            a = (np.repeat(start, n) + (i + 1) * 48271) % _PRIME
            b = (a * a + 12345) % _PRIME
            s = (b * b + i) % _PRIME
            drawn = np.flatnonzero((s < int(p * _PRIME)) & (x >= N_SPECIAL))
            v = (s[drawn] * 48271) % _PRIME
            swap = (v >= int(0.8 * _PRIME)) & (v < int(0.9 * _PRIME))
            if span < 1 and swap.any():
                raise ValueError(f"no id to draw from in a vocabulary of {vocab_size}")
            masked, real, labels = x.copy(), known.copy(), np.full(len(x), IGNORE_LABEL, np.int64)
            labels[drawn] = np.where(known[drawn], x[drawn], IGNORE_LABEL)
            at = drawn[v < int(0.8 * _PRIME)]
            masked[at], real[at] = MASK_ID, True
            at = drawn[swap]
            masked[at], real[at] = N_SPECIAL + ((v[swap] * 69621) % _PRIME) % max(span, 1), True
            null = None if not col.null_count else col.is_null()
            lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), flat_out, mask=null) for flat_out in
                     (pa.array(masked, mask=~real).cast(flat.type), pa.array(labels).cast(flat.type))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in names), *lists], names=schema.fieldNames())

    return df.select("*", start.alias("_start")).mapInArrow(draw, schema)
