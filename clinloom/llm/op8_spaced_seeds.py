"""Operator 8: benchmark decontamination by spaced-seed hashing.

A document is contaminated by a benchmark item when some stretch of the item of
``least`` words (13, or the whole item where it has 8 to 12) stands in the document, in
place, with at least ``share`` (0.8) of its words equal (A-Z lower-cased).  An item of 1 to 7
words contaminates where it stands in the document word for word.

1.  *Seeds.*  Three fixed masks pick five of up to eight neighbouring words and ignore the
    others.  For every window of ``least`` words and every set of substitutions the share
    allows, some mask at some place misses all of them (a test checks all patterns), so the
    seeds find every stretch that qualifies.  Items under 8 words have one seed: the hash of
    the whole item, looked for at the lengths that the benchmark holds.
2.  *Filter.*  The seeds of the benchmark set bits in a filter of fixed size (``BITS``), whatever
    the benchmark's size; tasks scan whole texts against it and only positions that pass
    are shuffled.
3.  *Join.*  Test and training seeds meet in a shuffle join; hits shrink to distinct
    (document, item, diagonal) before they meet the texts.
4.  *Verification.*  The document's words along a hit's diagonal are compared with the whole
    item, and the qualifying windows are counted word by word.

Result: one row per document and item text: ``doc_id``, ``item_id`` (the smallest id with
that text), ``n_items`` (items with that text), ``start`` and ``item_start`` (words),
``length`` (words from the first to the last qualifying window) and ``matched`` (equal
words therein), for the diagonal with the most matches.

Defined cases: null and empty texts (documents or items) match nothing; of an item under 8
words the first place in a document is reported; rows that repeat with the same id and text
give one row; a null ``doc_id`` stays null; empty tables give no rows; other columns are not
read.  The masks are proven for shares of 0.8 and more and stretches of 8 to 13 words; other
values are refused.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import keyed, materialise
from clinloom.llm.words import hash_ints, mix, release, slabs

MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 3, 4), (0, 1, 2, 5, 6))
LEAST, SHORTEST, SHARE = 13, 8, 0.8
BITS = 1 << 26
_U = np.uint64
_FACTOR = hash_ints(np.arange(16), 31) | _U(1)


def seeds(h: np.ndarray, first: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of one mask at every place where it lies within a row.

    Numbers from ``len(MASKS)`` on stand for runs of 1, 2, ... whole words.
    """
    off = MASKS[mask] if mask < len(MASKS) else tuple(range(mask - len(MASKS) + 1))
    n = len(h) - off[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = h[:n] * _FACTOR[0] + hash_ints([mask], 32)[0]
    for j, o in enumerate(off[1:], 1):
        acc += h[o:o + n] * _FACTOR[j]
    ok = np.ones(n, bool)
    for b in np.unique(first[1:-1]):
        ok[max(0, b - off[-1]):b] = False
    at = np.flatnonzero(ok)
    return at, mix(acc[at])


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h % _U(bits)).astype(np.int64), ((h >> _U(32)) % _U(bits)).astype(np.int64)


def _emit_items(batches):
    for batch in batches:
        key = batch.column("item")
        for words in slabs(batch.column("text"), lower=True):
            off = words.first.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [key.slice(words.row, words.rows), pa.ListArray.from_arrays(
                    pa.array(off), pa.array(words.hashes.view(np.int64)))], names=["item", "words"])


def _emit_seeds(batches):
    for batch in batches:
        col = batch.column("words")
        h = np.asarray(col.flatten()).view(np.uint64)
        first = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(col).to_numpy())]).astype(np.int64)
        item = batch.column("item").to_numpy()
        size = np.diff(first)
        for m in range(len(MASKS) + SHORTEST - 1):
            at, s = seeds(h, first, m)
            row = np.searchsorted(first, at, side="right") - 1
            mine = size[row] >= SHORTEST if m < len(MASKS) else size[row] == m - len(MASKS) + 1
            at, s, row = at[mine], s[mine], row[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.view(np.int64)), pa.array(item[row]), pa.array((at - first[row]).astype(np.int32)),
                 pa.array(size[row].astype(np.int32))], names=["seed", "item", "at", "size"])


def _emit_bits(batches, bits: int):
    for batch in batches:
        h = batch.column("seed").to_numpy().view(np.uint64)
        at = np.unique(np.concatenate(_probes(h, bits)))
        word, bit = at >> 6, _U(1) << (at & 63).astype(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else []
        if len(word):
            yield pa.RecordBatch.from_arrays([pa.array(word[cut]), pa.array(
                np.bitwise_or.reduceat(bit, cut).view(np.int64))], names=["word", "bits"])


def bit_filter(found: DataFrame, bits: int) -> np.ndarray:
    """The filter of all benchmark seeds: ``bits`` / 8 bytes at any size of the benchmark."""
    rows = (found.select("seed").mapInArrow(partial(_emit_bits, bits=bits), "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")))
    out = np.zeros(bits >> 6, np.uint64)
    for part in rows.toArrow().to_batches():
        out[part.column("word").to_numpy()] = part.column("bits").to_numpy().view(np.uint64)
    return out


def _scan(batches, filt, short: list[int]):
    release()
    table_ = filt.value
    bits = len(table_) << 6

    def held(at):
        return (table_[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1

    for batch in batches:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for words in slabs(batch.column("text"), lower=True):
            for m in [*range(len(MASKS)), *(len(MASKS) + n - 1 for n in short)]:
                at, s = seeds(words.hashes, words.first, m)
                one, two = _probes(s, bits)
                hit = np.flatnonzero(held(one))
                hit = hit[held(two[hit])]
                if len(hit):
                    row = np.searchsorted(words.first, at[hit], side="right") - 1
                    if m >= len(MASKS):                # whole items: the first place in a row says it all
                        order = np.lexsort((at[hit], s[hit], row))
                        hit, row = hit[order], row[order]
                        new = np.ones(len(hit), bool)
                        new[1:] = (row[1:] != row[:-1]) | (s[hit[1:]] != s[hit[:-1]])
                        hit, row = hit[new], row[new]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[words.row + row]), pa.array(k2[words.row + row]),
                         pa.array(s[hit].view(np.int64)), pa.array((at[hit] - words.first[row]).astype(np.int32))],
                        names=["k1", "k2", "seed", "pos"])


def _slices(batches):
    """The words of each document along the diagonals of its hits."""
    for batch in batches:
        hits = batch.column("hits")
        off = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(hits).to_numpy())]).astype(np.int64)
        flat = hits.flatten()
        item, diag, size = (np.asarray(flat.field(f)) for f in ("item", "diag", "size"))
        for words in slabs(batch.column("text"), lower=True):
            h, n = words.hashes, words.counts
            a, b = off[words.row], off[words.row + words.rows]
            row = np.repeat(np.arange(words.rows), np.diff(off[words.row:words.row + words.rows + 1]))
            lo = np.maximum(diag[a:b], 0)
            hi = np.minimum(diag[a:b] + size[a:b], n[row])
            part = [h[words.first[r] + x:words.first[r] + y].view(np.int64)
                    for r, x, y in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            cut = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int32)
            own = pa.array(words.row + row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(own) for c in ("k1", "k2", "doc_id")), pa.array(item[a:b]),
                 pa.array(lo.astype(np.int32)), pa.array((lo - diag[a:b]).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(part) if part
                                                                  else np.zeros(0, np.int64)))],
                names=["k1", "k2", "doc_id", "item", "start", "item_start", "doc_words"])


def overlap(equal: np.ndarray, item_size: int, least: int, share: float) -> tuple[int, int, int] | None:
    """(first, end, matched) over the windows that qualify, or None."""
    w = min(least, item_size)
    if len(equal) < w:
        return None
    if item_size < SHORTEST:
        share = 1.0
    total = np.concatenate([[0], np.cumsum(equal)])
    ok = np.flatnonzero(total[w:] - total[:-w] >= share * w - 1e-9)
    if not len(ok):
        return None
    a, b = int(ok[0]), int(ok[-1]) + w
    return a, b, int(total[b] - total[a])


def _verify(batches, least: int, share: float):
    for batch in batches:
        out = []
        start, item_start = batch.column("start").to_numpy(), batch.column("item_start").to_numpy()
        for i, (d, t) in enumerate(zip(batch.column("doc_words"), batch.column("words"), strict=True)):
            d, t = np.asarray(d.values), np.asarray(t.values)
            s = int(item_start[i])
            got = overlap(d == t[s:s + len(d)], len(t), least, share)
            if got is not None:
                out.append((i, int(start[i]) + got[0], s + got[0], got[1] - got[0], got[2]))
        if out:
            row, *rest = map(list, zip(*out, strict=True))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("k1", "k2", "doc_id", "item")),
                 *(pa.array(x, pa.int64()) for x in rest)],
                names=["k1", "k2", "doc_id", "item", "start", "item_start", "length", "matched"])


def contaminated(docs: DataFrame, bench: DataFrame, least: int = LEAST, share: float = SHARE, bits: int = BITS,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(k1, k2, doc_id, item_id, n_items, start, item_start, length, matched); see the module text."""
    if not (SHORTEST <= least <= LEAST and share >= SHARE):
        raise ValueError(f"the masks are proven for least in {SHORTEST}..{LEAST} and share >= {SHARE}")
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    texts = (bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
             .filter("text is not null").groupBy("text")
             .agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items")))
    texts = materialise(texts.withColumn("item", F.monotonically_increasing_id()), "op8-texts")
    items = materialise(texts.select("item", "text").mapInArrow(_emit_items, "item long, words array<long>"),
                        "op8-items")
    items = items.filter("size(words) > 0")
    short = sorted(r[0] for r in items.select(F.size("words")).filter(F.size("words") < SHORTEST).distinct().collect())
    found = items.mapInArrow(_emit_seeds, "seed long, item long, at int, size int")
    filt = spark.sparkContext.broadcast(bit_filter(found, bits))
    hits = rows.select("k1", "k2", "text").mapInArrow(partial(_scan, filt=filt, short=short),
                                                      "k1 long, k2 long, seed long, pos int")
    diag = (hits.join(found, "seed")
            .select("k1", "k2", "item", (F.col("pos") - F.col("at")).alias("diag"), "size").distinct())
    per_doc = materialise(diag.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "diag", "size")).alias("hits")),
                          "op8-hits")
    along = rows.join(per_doc, ["k1", "k2"]).mapInArrow(
        _slices, "k1 long, k2 long, doc_id long, item long, start int, item_start int, doc_words array<long>")
    good = along.join(items, "item").mapInArrow(
        partial(_verify, least=least, share=share),
        "k1 long, k2 long, doc_id long, item long, start long, item_start long, length long, matched long")
    best = good.groupBy("k1", "k2", "doc_id", "item").agg(
        F.max(F.struct("matched", F.negative("length").alias("l"), F.negative("start").alias("s"),
                       F.negative("item_start").alias("i"))).alias("b"))
    return best.join(texts.drop("text"), "item").select(
        "k1", "k2", "doc_id", "item_id", "n_items", F.negative("b.s").alias("start"),
        F.negative("b.i").alias("item_start"), F.negative("b.l").alias("length"), F.col("b.matched").alias("matched"))


# the definition itself: every diagonal with enough equal words, window by window
_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w, text FROM documents WHERE text IS NOT NULL),
dr AS (SELECT row_number() OVER () AS rid, doc_id, w, len(w) AS n FROM d),
t AS (
  SELECT text, min(item_id) AS item_id, count(*) AS n_items, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark WHERE text IS NOT NULL GROUP BY text),
tr AS (SELECT item_id, n_items, w, len(w) AS n, least(13, len(w)) AS k FROM t WHERE len(w) >= 1),
dw AS (SELECT rid, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM dr),
tw AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM tr),
m AS (SELECT rid, item_id, dw.pos - tw.pos AS diag, tw.pos AS ip FROM dw JOIN tw ON dw.word = tw.word),
c AS (SELECT m.rid, m.item_id, diag, any_value(k) AS k FROM m JOIN tr ON tr.item_id = m.item_id
      GROUP BY m.rid, m.item_id, diag HAVING count(*) >= CASE WHEN any_value(k) < 8 THEN any_value(k) ELSE 0.8 * any_value(k) - 1e-9 END),
r AS (SELECT c.*, unnest(range(greatest(0, -diag), least(tr.n, dr.n - diag))) AS ip
      FROM c JOIN dr ON dr.rid = c.rid JOIN tr ON tr.item_id = c.item_id),
q AS (SELECT r.*, CASE WHEN m.ip IS NULL THEN 0 ELSE 1 END AS eq
      FROM r LEFT JOIN m ON m.rid = r.rid AND m.item_id = r.item_id AND m.diag = r.diag AND m.ip = r.ip),
v AS (
  SELECT rid, item_id, diag, ip, eq, k, CASE WHEN k = 13 THEN sum(eq) OVER w13 WHEN k = 12 THEN sum(eq) OVER w12
           WHEN k = 11 THEN sum(eq) OVER w11 WHEN k = 10 THEN sum(eq) OVER w10 WHEN k = 9 THEN sum(eq) OVER w9
           WHEN k = 8 THEN sum(eq) OVER w8 ELSE sum(eq) OVER (PARTITION BY rid, item_id, diag) END AS hit,
         count(*) OVER (PARTITION BY rid, item_id, diag ORDER BY ip DESC) AS left_over
  FROM q
  WINDOW w13 AS (PARTITION BY rid, item_id, diag ORDER BY ip ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING),
    w12 AS (PARTITION BY rid, item_id, diag ORDER BY ip ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING),
    w11 AS (PARTITION BY rid, item_id, diag ORDER BY ip ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING),
    w10 AS (PARTITION BY rid, item_id, diag ORDER BY ip ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING),
    w9 AS (PARTITION BY rid, item_id, diag ORDER BY ip ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING),
    w8 AS (PARTITION BY rid, item_id, diag ORDER BY ip ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
o AS (SELECT rid, item_id, diag, min(ip) AS a, max(ip) + any_value(k) AS b FROM v
      WHERE left_over >= k AND hit >= CASE WHEN k < 8 THEN k ELSE 0.8 * k - 1e-9 END GROUP BY rid, item_id, diag),
g AS (SELECT o.rid, o.item_id, a + o.diag AS start, a AS item_start, b - a AS length, sum(q.eq) AS matched
      FROM o JOIN q ON q.rid = o.rid AND q.item_id = o.item_id AND q.diag = o.diag AND q.ip >= a AND q.ip < b
      GROUP BY o.rid, o.item_id, o.diag, a, b),
f AS (SELECT *, row_number() OVER (PARTITION BY rid, item_id ORDER BY matched DESC, length, start, item_start) AS best FROM g)
SELECT dr.doc_id, f.item_id, tr.n_items, f.start, f.item_start, f.length, CAST(f.matched AS BIGINT) AS matched
FROM f JOIN dr ON dr.rid = f.rid JOIN tr ON tr.item_id = f.item_id WHERE best = 1
"""


@query("op8_spaced_seeds", _SQL)
def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go; the others stay unchanged."""
    bad = contaminated(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    own = docs.withColumns({"_k1": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"),
                            "_k2": F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))})
    return own.join(bad, ["_k1", "_k2"], "left_anti").select(*docs.columns)
