"""Operator 9: language-model scores from Brown classes.

Tokens are words (A-Z lower-cased) and one end per document; documents with
crc32(doc_id) mod 7 != 2 are learned from.  The model is P(w | u, v) = P(class(w) | class(u),
class(v)) P(w | class(w)); a document begins after two ends.

1.  *Counts.*  Rows are written once in compressed blocks, numbered in chunks of about ``CHUNK`` bytes
    as they come, so rows that repeat do not gather in one.  A task turns a chunk into its distinct words with their training counts;
    totals are an aggregate.  The ``COMMON`` most frequent words' totals and classes are broadcast
    (17 bytes each, whatever the vocabulary); those of all others are joined back to every chunk
    that holds the word.  Only distinct words per chunk are shuffled, never tokens.
2.  *Classes of the head.*  The ``HEAD`` most frequent words are clustered by exchange into
    ``CLASSES`` classes: each round a Spark job sums every word's bigrams by its neighbours'
    classes, and every third word moves to the class that raises the likelihood of the class
    bigrams most; a round that lowers it (words that moved together) is undone and fewer
    words move at once from there on.
3.  *Classes of all other words.*  As in Brown's procedure, the rest is put into these classes, head
    first: a word's bigrams with the head's classes are summed over all training documents (one
    sparse row per task and word) and the word takes the class that raises the likelihood of
    the class bigrams most.  Words seen once or never share one class.
4.  *Transitions* are counted over the class sequences of all training documents, two classes of
    history, smoothed towards one and none by the number of successors (Witten-Bell).
5.  *Emissions* are relative frequencies.  Words seen once share their class with unseen ones:
    n1 / (n1 + 2 n2) of its mass is the unseen words', after Good and Turing, in equal parts
    for the n1 n1 / (2 n2) words that Chao's estimate holds unseen.

Result: ``doc_id``, ``held_out`` (remainder 2), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
(add-one unigrams), ``score`` (log10 probability of the text) and ``perplexity``.

Defined cases: null and empty texts are the end alone; a null ``doc_id`` is not learned from
and not held out; repeated rows count as often as they occur; without training documents
every word is unseen and ``base_score`` follows its formula with N = V = 0; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import fold, materialise, small_batches
from clinloom.llm.words import hash_ints, key_runs, release, slabs

CHUNK, HEAD, CLASSES, ROUNDS = 8 << 20, 2048, 64, 12
COMMON = 1 << 18                                        # words whose totals and classes are broadcast
RARE = CLASSES                                          # class of words seen once or never
END = CLASSES + 1                                       # class of the end token
ALL = END + 1
HELD = 1 << 21                                          # bigrams a task holds before it hands them on
_ROW = "doc_id long, held_out boolean, train boolean"


def _deal(batches, chunk_bytes: int):
    """(chunk, ends, block): runs of about ``chunk_bytes`` of a task's rows, each batch of one packed into a block."""
    done, first = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        size = pa.compute.binary_length(batch.column("text")).to_numpy() + 1
        at = done + np.cumsum(size) - size
        done += int(size.sum())
        chunk = first + at // chunk_bytes
        cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            part, out = batch.slice(lo, hi - lo), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(chunk[lo])]), pa.array([pa.compute.sum(part.column("train")).as_py()], pa.int64()),
                 pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["chunk", "ends", "block"])


def _rows(batches, train: bool = False):
    """The rows of blocks, those learned from only with ``train``."""
    for batch in batches:
        for block in batch.column("block"):
            with pa.ipc.open_stream(block.as_buffer()) as rows:
                for part in rows:
                    yield part.filter(part.column("train")) if train else part


def _dictionary(batches):
    """(chunk, word, n): a chunk's distinct words and their training counts."""
    release()
    for t in key_runs(batches, "chunk"):
        words, counts = [], []
        for batch in _rows(t.to_batches()):
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for w in slabs(batch.column("text"), lower=True):
                mine = train[w.row:w.row + w.rows][w.row_of_word()]
                h, inv = np.unique(w.hashes, return_inverse=True)
                words.append(h)
                counts.append(np.bincount(inv, mine, len(h)).astype(np.int64))
        if not words:
            continue
        h, inv = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(inv, np.concatenate(counts), len(h)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
        chunk = t.column("chunk")[0].as_py()
        for lo in range(0, len(h), 1 << 16):
            part = h[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), chunk, np.int64)), pa.array(part.view(np.int64)),
                 pa.array(n[lo:lo + (1 << 16)])], names=["chunk", "word", "n"])


def _head_pairs(batches, head):
    """Counts of neighbouring head words over a task's training documents."""
    keys, number = head.value
    size = len(keys) + 2                                # the rest of the words, then the document's ends
    grid = np.zeros(size * size, np.int64)
    for batch in _rows(batches, train=True):
        for w in slabs(batch.column("text"), lower=True):
            h, n = w.hashes, len(w)
            code = np.full(n + w.rows + 1, size - 1, np.int64)
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            place = np.arange(n) + w.row_of_word() + 1
            code[place] = np.where(keys[at] == h, number[at], size - 2) if len(keys) else size - 2
            np.add.at(grid, code[:-1] * size + code[1:], 1)
    hit = np.flatnonzero(grid)
    for lo in range(0, len(hit), 1 << 16):
        part = hit[lo:lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array((part // size).astype(np.int32)),
                                          pa.array((part % size).astype(np.int32)), pa.array(grid[part])],
                                         names=["v", "w", "n"])


def _packed(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds values[off[i]:off[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [
        None, pa.py_buffer((off * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _flat(col: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The values of all rows of a binary column, one after the other."""
    return np.frombuffer(b"".join(col.to_pylist()), kind)


def _neighbours(batches, head):
    """(word, code, n): a word's training bigrams by the head classes beside it, a byte a class and four a count.

    Classes before the word count from 0, those after it from ``ALL``; other words count as ``RARE``.
    """
    release()
    keys, number = head.value

    def rows(word, code, n):
        order = np.lexsort((code, word))
        word, code, n = word[order], code[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        off = np.concatenate([new, [len(word)]])
        for lo in range(0, len(new), 1 << 15):
            cut = off[lo:lo + (1 << 15) + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[cut[:-1]].view(np.int64)), _packed(code[cut[0]:cut[-1]].astype(np.uint8), cut - cut[0]),
                 _packed(n[cut[0]:cut[-1]].astype("<u4"), cut - cut[0])], names=["word", "code", "n"])

    def summed(kept):
        word, code, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        mark = hash_ints(code.astype(np.uint64)) ^ word
        _, first, back = np.unique(mark, return_index=True, return_inverse=True)
        return word[first], code[first], np.bincount(back, n, len(first)).astype(np.int64)

    kept, size = [], 0
    for batch in _rows(batches, train=True):
        for w in slabs(batch.column("text"), lower=True):
            if not len(w):
                continue
            h, n = w.hashes, len(w)
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            cls = np.full(n + w.rows + 1, END, np.int64)
            place = np.arange(n) + w.row_of_word() + 1
            cls[place] = np.where(keys[at] == h, number[at], RARE) if len(keys) else RARE
            kept.append(summed([(h, cls[place - 1], np.ones(n, np.int64)), (h, ALL + cls[place + 1], np.ones(n, np.int64))]))
            size += len(kept[-1][0])
            if size >= HELD:
                kept = [summed(kept)]
                size = len(kept[0][0])
                if size >= HELD // 2:
                    yield from rows(*kept[0])
                    kept, size = [], 0
    if kept:
        yield from rows(*summed(kept))


def best_classes(left: np.ndarray, right: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigrams ``grid`` most.

    ``left[w, c]`` / ``right[w, c]`` count the bigrams of word w with class c before / after it.  A
    word is small beside its class, so its gain is the slope of the likelihood.
    """
    k = grid.shape[0] - 2                               # neither the rare words' class nor the end's
    logs = np.log(grid + 0.5)
    rows, cols = np.log(grid.sum(axis=1) + 0.5 * len(grid)), np.log(grid.sum(axis=0) + 0.5 * len(grid))
    gain = right @ (logs - rows[:, None])[:k].T + left @ (logs - cols[None, :])[:, :k]
    return gain.argmax(axis=1)


def _choose(batches, grid, least: int):
    """(word, cls) of words with ``least`` bigrams to the left and more, from their sums of all tasks."""
    held = []

    def chosen(t):
        word = t.column("word").to_numpy()
        which = np.repeat(np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])),
                          pa.compute.binary_length(t.column("code")).to_numpy())
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        table_ = np.zeros((len(at), 2 * ALL))
        np.add.at(table_, (which, _flat(t.column("code"), "u1")), _flat(t.column("n"), "<u4"))
        enough = table_[:, :ALL].sum(axis=1) >= least
        cls = best_classes(table_[enough, :ALL], table_[enough, ALL:], grid.value)
        return pa.RecordBatch.from_arrays([pa.array(word[at[enough]]), pa.array(cls.astype(np.int32))], names=["word", "cls"])

    for batch in batches:                               # whole words: a batch ends where the next word begins
        if not batch.num_rows:
            continue
        word = batch.column("word").to_numpy()
        cut = int(np.flatnonzero(word != word[-1])[-1]) + 1 if word[0] != word[-1] else 0
        if cut:
            yield chosen(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield chosen(pa.Table.from_batches(held))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(cls: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, move: np.ndarray,
             classes: int) -> int:
    """Move words to their best classes, in place; the number of moves.

    ``left[w, c]`` / ``right[w, c]`` count the bigrams of word w with class c before / after
    it, ``own[w]`` those with itself; classes from ``classes`` on take no part but count.
    """
    total = left.shape[1]
    grid = np.zeros((total, total))
    np.add.at(grid, cls, right)
    moves = 0
    for w in move:
        a, n_r, n_l, me = cls[w], right[w].copy(), left[w].copy(), own[w]
        n_r[a] -= me
        n_l[a] -= me
        grid[a] -= n_r
        grid[:, a] -= n_l
        grid[a, a] -= me
        rows, cols = grid.sum(axis=1), grid.sum(axis=0)
        gain = np.empty(classes)
        up = _xlogx(grid[:classes] + n_r) - _xlogx(grid[:classes])
        down = _xlogx(grid[:, :classes].T + n_l) - _xlogx(grid[:, :classes].T)
        k = np.arange(classes)
        diag = grid[k, k]
        gain = up.sum(axis=1) - up[k, k] + down.sum(axis=1) - down[k, k]
        gain += _xlogx(diag + n_r[:classes] + n_l[:classes] + me) - _xlogx(diag)
        gain -= _xlogx(rows[:classes] + n_r.sum() + me) - _xlogx(rows[:classes])
        gain -= _xlogx(cols[:classes] + n_l.sum() + me) - _xlogx(cols[:classes])
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = int(a)
        moves += b != a
        cls[w] = b
        grid[b] += n_r
        grid[:, b] += n_l
        grid[b, b] += me
    return moves


def exchange_rounds(sums, own: np.ndarray, n_head: int, classes: int, rounds: int) -> np.ndarray:
    """Classes of the head words after at most ``rounds`` of exchange.

    ``sums(cls)`` gives (left, right): each word's bigrams by the classes of its neighbours.
    """
    cls = np.arange(n_head) % classes                    # by frequency rank
    best, most, stride, quiet = cls.copy(), -np.inf, 3, 0
    for step in range(rounds + 1):
        full = np.concatenate([cls, [classes, classes + 1]])
        left, right = sums(full)
        grid = np.zeros((left.shape[1], left.shape[1]))
        np.add.at(grid, full, right)
        now = float(_xlogx(grid).sum() - _xlogx(grid.sum(axis=0)).sum() - _xlogx(grid.sum(axis=1)).sum())
        if now < most - 1e-6:
            cls, stride, quiet = best.copy(), 2 * stride, 0
            continue
        best, most = cls.copy(), now
        if step == rounds or quiet >= stride:
            break
        moved = exchange(full, left, right, np.concatenate([own, [0, 0]]), np.arange(step % stride, n_head, stride), classes)
        cls, quiet = full[:n_head].copy(), 0 if moved else quiet + 1
    return best


def brown_classes(pairs: DataFrame, n_head: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the head words 0 .. n_head - 1 from their bigram counts (v, w, n)."""
    spark = pairs.sparkSession
    own = np.zeros(n_head)
    for r in pairs.filter(f"v = w AND v < {n_head}").collect():
        own[r["v"]] = r["n"]

    def sums(full):
        label = F.broadcast(spark.createDataFrame(pa.table({"id": pa.array(range(len(full)), pa.int32()), "c": pa.array(full, pa.int32())})))
        out = []
        for key, other in (("w", "v"), ("v", "w")):      # at most HEAD * CLASSES sums each
            t = pairs.join(label, F.col(other) == F.col("id")).groupBy(key, "c").agg(F.sum("n").alias("n")).toArrow()
            into = np.zeros((n_head + 2, classes + 2))
            into[t.column(key).to_numpy(), t.column("c").to_numpy()] = t.column("n").to_numpy()
            out.append(into)
        return out

    return exchange_rounds(sums, own, n_head, classes, rounds) if n_head else np.zeros(0, np.int64)


def unseen_types(once: int, twice: int) -> float:
    """Chao's estimate of the words not seen, at least one, from those seen once and twice."""
    return max(once * once / (2 * twice) if twice else once * (once - 1) / 2, 1.0)


def _score_chunk(left, right, model):
    """Counts, base score, emissions and class sequence of every document of a chunk."""
    n, v, ends, mass, unseen, types, common = model.value
    words, total, cls = (np.concatenate([a, right.column(c).to_numpy()])
                         for a, c in zip(common, ("word", "total", "cls"), strict=True))
    order = np.argsort(words.view(np.uint64))
    words, total, cls = words.view(np.uint64)[order], total[order], cls[order]
    emit = np.log10(np.maximum(total, 1) / np.maximum(mass[cls], 1))
    emit[total == 1] += np.log10(1 - unseen)
    emit[total == 0] = np.log10(unseen / types)
    base = np.log10((total + 1) / (n + v + 1))
    end_base = np.log10((ends + 1) / (n + v + 1))
    out = []
    for batch in _rows(left.to_batches()):
        for w in slabs(batch.column("text"), lower=True):
            code = np.searchsorted(words, w.hashes)
            if len(code) and not (words[np.minimum(code, len(words) - 1)] == w.hashes).all():
                raise RuntimeError("a chunk's dictionary lacks one of its words")
            row = w.row_of_word()
            c8 = cls[code].astype(np.uint8)
            seq = [c8[w.first[r]:w.first[r + 1]].tobytes() for r in range(w.rows)]
            cut = batch.slice(w.row, w.rows)
            out.append(pa.RecordBatch.from_arrays(
                [cut.column("doc_id"), cut.column("held_out"), cut.column("train"),
                 pa.array((w.counts + 1).astype(np.int64)),
                 pa.array((np.bincount(row, total[code] > 0, w.rows) + (ends > 0)).astype(np.int64)),
                 pa.array(np.bincount(row, base[code], w.rows) + end_base),
                 pa.array(np.bincount(row, emit[code], w.rows).astype(float)), pa.array(seq, pa.binary())],
                names=["doc_id", "held_out", "train", "n_tokens", "n_known", "base_score", "emission", "classes"]))
    return pa.Table.from_batches(out)


def _sequence(col) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all documents, each after two ends and before one; place of each token to be predicted)."""
    raw = col.to_pylist()
    flat = np.frombuffer(b"".join(bytes([END, END]) + r + bytes([END]) for r in raw), np.uint8).astype(np.int64)
    size = np.array([len(r) + 3 for r in raw])
    begin = np.cumsum(size) - size
    at = np.ones(len(flat), bool)
    at[begin], at[begin + 1] = False, False
    return flat, np.flatnonzero(at)


def _transitions(batches):
    grid = np.zeros(ALL ** 3, np.int64)
    for batch in batches:
        c, at = _sequence(batch.column("classes"))
        grid += np.bincount((c[at - 2] * ALL + c[at - 1]) * ALL + c[at], minlength=ALL ** 3)
    hit = np.flatnonzero(grid)
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(grid[hit])], names=["abc", "n"])


def transition_matrix(grid: np.ndarray) -> np.ndarray:
    """log10 P(c | a, b): Witten-Bell from two classes of history to one, to the class frequencies."""
    def smoothed(counts, prior):
        kinds = np.maximum((counts > 0).sum(axis=-1), 1)[..., None]
        return (counts + kinds * prior) / (counts.sum(axis=-1)[..., None] + kinds)

    two = grid.sum(axis=0)
    into = two.sum(axis=0)
    prior = (into + 0.5) / (into.sum() + 0.5 * len(into))
    return np.log10(smoothed(grid, smoothed(two, prior)[None, :, :]))


def _finish(batches, table_, n: int):
    logs = table_.value
    for batch in batches:
        c, at = _sequence(batch.column("classes"))
        tokens = np.asarray(batch.column("n_tokens"))
        row = np.repeat(np.arange(batch.num_rows), tokens)
        score = np.asarray(batch.column("emission")) + np.bincount(row, logs[c[at - 2], c[at - 1], c[at]], batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")),
             pa.array(np.full(batch.num_rows, n, np.int64)), batch.column("base_score"), pa.array(score),
             pa.array(10 ** np.minimum(-score / tokens, 300))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])


def word_classes(rows: DataFrame, words: DataFrame, head: int, rounds: int, least: int = 2) -> DataFrame:
    """(word, cls) of every training word with ``least`` bigrams and more; ``rows`` hold blocks."""
    spark = rows.sparkSession
    top = words.filter("total > 1").orderBy(F.desc("total"), "word").limit(head).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    seen = spark.sparkContext.broadcast((hashes[order], order))
    grams = materialise(rows.mapInArrow(partial(_head_pairs, head=seen), "v int, w int, n long")
                        .groupBy("v", "w").agg(F.sum("n").alias("n")), "op9-bigrams")
    cls = brown_classes(grams, len(top), CLASSES, rounds)
    full = np.concatenate([cls, [RARE, END]]).astype(np.int64)
    grid = np.zeros((ALL, ALL))
    for part in grams.toArrow().to_batches():            # at most HEAD * HEAD counts
        v, w, n = (part.column(c).to_numpy() for c in ("v", "w", "n"))
        np.add.at(grid, (full[v], full[w]), n)
    known = spark.sparkContext.broadcast((hashes[order], cls[order] if len(top) else order))
    shared = spark.sparkContext.broadcast(grid)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = (rows.mapInArrow(partial(_neighbours, head=known), "word long, code binary, n binary")
              .repartition(parts, "word").sortWithinPartitions("word")
              .mapInArrow(partial(_choose, grid=shared, least=least), "word long, cls int"))
    fixed = spark.createDataFrame(pa.table({"word": pa.array([r["word"] for r in top], pa.int64()), "own": pa.array(cls, pa.int32())}))
    return (chosen.join(F.broadcast(fixed), "word", "left")          # the head's classes stand
            .select("word", F.coalesce("own", "cls").alias("cls")))


def lm_scores(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS, chunk_bytes: int = CHUNK, common: int = COMMON,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row of ``docs``; see the module text."""
    spark = docs.sparkSession
    small_batches(spark)
    d, t = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = fold(d, 7)
    rows = docs.select(d.alias("doc_id"), F.coalesce(left == 2, F.lit(False)).alias("held_out"),
                       F.coalesce(left != 2, F.lit(False)).alias("train"), t.alias("text"))
    dealt = materialise(rows.mapInArrow(partial(_deal, chunk_bytes=chunk_bytes),
                                        "chunk long, ends long, block binary"), "op9-rows", "none")
    ends = dealt.agg(F.sum("ends")).first()[0] or 0
    # a chunk whose rows are read by two tasks has two dictionaries with the same totals
    pairs = materialise(dealt.select("chunk", "block").mapInArrow(_dictionary, "chunk long, word long, n long"), "op9-pairs", "zstd")
    words = materialise(pairs.groupBy("word").agg(F.sum("n").alias("total")), "op9-words")
    classes = word_classes(dealt.select("block"), words.filter("total > 0"), head, rounds)
    words = materialise(words.join(classes, "word", "left").select(
        "word", "total", F.when(F.col("total") > 1, F.col("cls")).otherwise(RARE).alias("cls")), "op9-classes")
    sums = words.filter("total > 0").groupBy("cls").agg(
        F.sum("total").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("total") == 1).cast("long")).alias("one"),
        F.sum((F.col("total") == 2).cast("long")).alias("two")).collect()
    mass = np.zeros(ALL)
    for r in sums:
        mass[r["cls"]] = r["n"]
    n = sum(r["n"] for r in sums) + ends
    v = sum(r["v"] for r in sums) + (ends > 0)
    once, twice = sum(r["one"] for r in sums), sum(r["two"] for r in sums)
    unseen = once / (once + 2 * twice) if once and twice else 0.5
    top = materialise(words.orderBy(F.desc("total"), "word").limit(common), "op9-common")
    held = top.select("word", "total", F.col("cls").cast("byte").alias("cls")).toArrow()     # ``common`` rows at most
    model = spark.sparkContext.broadcast((n, v, ends, mass, unseen, unseen_types(once, twice),
                                          [held.column(c).to_numpy() for c in ("word", "total", "cls")]))
    reply = (pairs.select("chunk", "word").join(F.broadcast(top.select("word")), "word", "left_anti")
             .join(words, "word"))

    def scored(left, right):
        return _score_chunk(left, right, model)

    seqs = materialise(dealt.select("chunk", "block").groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(
        scored, _ROW + ", n_tokens long, n_known long, base_score double, emission double, classes binary"), "op9-seqs")
    grid = np.zeros(ALL ** 3)
    for part in (seqs.filter("train").select("classes").mapInArrow(_transitions, "abc int, n long")
                 .groupBy("abc").agg(F.sum("n").alias("n")).toArrow().to_batches()):       # at most ALL ** 3 counts
        grid[part.column("abc").to_numpy()] = part.column("n").to_numpy()
    logs = spark.sparkContext.broadcast(transition_matrix(grid.reshape(ALL, ALL, ALL)))
    return seqs.drop("train").mapInArrow(
        partial(_finish, table_=logs, n=n),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, perplexity double")


@query("op9_brown_lm")
def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    return lm_scores(table(spark, sf_dir, "documents"))
