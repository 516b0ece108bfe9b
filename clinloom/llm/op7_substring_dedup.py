"""Operator 7: repeated word windows removed through a compacted de Bruijn graph.

Semantics (``window`` consecutive words, 35 by default): every word covered by a window
whose word sequence also starts anywhere else -- in another row or elsewhere in the same
row -- is removed.  Windows are judged on the input, never on what is left.

Method, every step a Spark job over all rows:

1.  *Token k-mers become nodes and edges.*  Of the ``window - seed + 1`` k-mers
    (``seed`` words) in a window, those with the smallest hash are its anchors; equal
    windows have equal anchors, so no repeat can escape.  An anchor is a graph node; the
    stretch from one anchor through the next is an edge, identified by the hash of all
    its words.  About one k-mer in thirteen is an anchor.
2.  *Repeated nodes* are those counted twice or more (partial aggregates); the other
    anchors go by a semi join.
3.  *Nonbranching paths compact through joins.*  A node whose occurrences all leave by one
    edge (or all arrive by one) is unbranched on that side; joined back to the
    occurrences, consecutive anchors merge into one path wherever neither end branches.
4.  *Source coordinates verify long spans.*  A row's paths of at least ``window`` words
    stand as one span each; windows that contain a repeated anchor but lie in no such
    path are spans of their own.  Spans are compared by a 128-bit hash of all their
    words; those found at two coordinates or more are removed.

Defined cases: a null text counts as empty (no words, the hash of the empty text); rows
of fewer than ``window`` words are unchanged; repeated rows (same id, same text) are
separate places, so each loses what the other holds (their anchors and spans are kept once
and counted as often as the row repeats); a null ``doc_id`` stays null; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import keyed, materialise
from clinloom.llm.words import Words, release, slabs, spans, whole, windows

WINDOW = 35
SEED = 11
_TOP = np.uint64(2**64 - 1)
_NODES = "k1 long, k2 long, node long, pos int, gap int, edge long"
_PLACES = ("k1 long, k2 long, doc_id long, n_words long, sha string, text string, "
           "cands array<struct<start:int,len:int,h1:long,h2:long>>")


def _slide(v: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive values, by doubling."""
    have, cur = 1, v
    while have * 2 <= w:
        cur = op(cur[:-have], cur[have:])
        have *= 2
    rest = w - have
    return op(cur[:len(cur) - rest], cur[rest:]) if rest else cur


def anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the slab's anchors and all its seed hashes."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    v = windows(words.hashes, seed)
    w = window - seed + 1
    low = _slide(np.where(whole(words.first, n, seed), v, _TOP), w, np.minimum)
    low[~whole(words.first, n, window)] = 0                      # windows across rows select nothing
    edge = np.zeros(w - 1, np.uint64)
    best = _slide(np.concatenate([edge, low, edge]), w, np.maximum)   # over the windows holding each seed
    return np.flatnonzero(best == v), v


def _emit_nodes(batches, window: int, seed: int):
    release()
    for batch in batches:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for words in slabs(batch.column("text")):
            at, v = anchors(words, window, seed)
            if not len(at):
                continue
            row = np.searchsorted(words.first, at, side="right") - 1
            gap = np.zeros(len(at), np.int64)
            gap[:-1] = np.where(row[1:] == row[:-1], at[1:] - at[:-1], 0)
            edge = spans(words.hashes, at, at + gap + seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[words.row + row]), pa.array(k2[words.row + row]), pa.array(v[at].view(np.int64)),
                 pa.array((at - words.first[row]).astype(np.int32)), pa.array(gap.astype(np.int32)),
                 pa.array(edge.view(np.int64))], names=["k1", "k2", "node", "pos", "gap", "edge"])


def _ragged(col: pa.Array, field: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of one field of an array<struct> column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.concatenate([[0], np.cumsum(np.nan_to_num(
        pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))])
    return off, np.asarray(col.flatten().field(field))


def _row_spans(pos, gap, out1, in1, lo: int, n: int, window: int, seed: int):
    """(start, end) word spans of one row to be verified: long paths, then loose windows."""
    order = np.argsort(pos, kind="stable")
    pos, gap, out1, in1 = pos[order], gap[order], out1[order], in1[order]
    link = (pos[:-1] + gap[:-1] == pos[1:]) & (gap[:-1] > 0) & out1[:-1] & in1[1:]
    head = np.flatnonzero(np.concatenate([[True], ~link]))
    tail = np.concatenate([head[1:] - 1, [len(pos) - 1]])
    s, e = pos[head], pos[tail] + seed
    keep = e - s >= window
    s, e = s[keep], e[keep]
    m = n - window + 1
    cover = np.zeros(m + 1, np.int64)                             # windows that hold a repeated anchor
    np.add.at(cover, np.clip(pos - (window - seed), 0, m), 1)
    np.add.at(cover, np.clip(pos + 1, 0, m), -1)
    inside = np.zeros(m + 1, np.int64)                            # windows within a long path
    np.add.at(inside, s, 1)
    np.add.at(inside, e - window + 1, -1)
    loose = np.flatnonzero((np.cumsum(cover[:m]) > 0) & (np.cumsum(inside[:m]) == 0))
    return np.concatenate([s, loose]) + lo, np.concatenate([e, loose + window]) + lo


def _emit_places(batches, window: int, seed: int):
    for batch in batches:
        cols = {c: batch.column(c) for c in ("k1", "k2", "doc_id")}
        off, pos = _ragged(batch.column("path"), "pos", batch.num_rows)
        gap, out1, in1 = (_ragged(batch.column("path"), f, batch.num_rows)[1] for f in ("gap", "out1", "in1"))
        for words in slabs(batch.column("text")):
            h, n_words, texts, shas, starts, lens, owners = words.hashes, words.counts, [], [], [], [], []
            for r in range(words.rows):
                a, b = off[words.row + r], off[words.row + r + 1]
                text = words.data[words.offsets[r]:words.offsets[r + 1]].tobytes()
                shas.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                got = 0
                if b > a:
                    s, e = _row_spans(pos[a:b], gap[a:b], out1[a:b], in1[a:b], int(words.first[r]),
                                      int(n_words[r]), window, seed)
                    got = len(s)
                    starts.append(s)
                    lens.append(e - s)
                texts.append(text.decode() if got else None)
                owners.append(got)
            s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            size = np.concatenate(lens) if lens else np.zeros(0, np.int64)
            first = words.first[np.repeat(np.arange(words.rows), owners)] if len(s) else s
            cands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(owners)]).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array((s - first).astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(spans(h, s, s + size, 3).view(np.int64)),
                     pa.array(spans(h, s, s + size, 5).view(np.int64))], names=["start", "len", "h1", "h2"]))
            cut = slice(words.row, words.row + words.rows)
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(cut.start, words.rows) for c in cols.values()), pa.array(n_words.astype(np.int64)),
                 pa.array(shas), pa.array(texts, pa.string()), cands],
                names=["k1", "k2", "doc_id", "n_words", "sha", "text", "cands"])


def _emit_result(batches):
    for batch in batches:
        off, start = _ragged(batch.column("gone"), "start", batch.num_rows)
        size = _ragged(batch.column("gone"), "len", batch.num_rows)[1]
        n, sha = batch.column("n_words").to_numpy(), batch.column("sha").to_pylist()
        removed, kept_text = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
        for words in slabs(batch.column("text")):
            for r in range(words.rows):
                i = words.row + r
                a, b = off[i], off[i + 1]
                if b == a:
                    continue
                delta = np.zeros(int(n[i]) + 1, np.int64)
                np.add.at(delta, start[a:b], 1)
                np.add.at(delta, start[a:b] + size[a:b], -1)
                kept = words.data[words.offsets[r]:words.offsets[r + 1]].tobytes().split()
                left = np.flatnonzero(np.cumsum(delta[:-1]) == 0)
                removed[i] = n[i] - len(left)
                text = b" ".join([kept[j] for j in left])
                sha[i], kept_text[i] = hashlib.sha256(text).hexdigest(), text.decode()
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), batch.column("doc_id"), batch.column("n_words"),
             pa.array(removed), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
            names=["k1", "k2", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, n_words, n_removed, kept_sha256, kept_text) per input row.

    ``kept_text`` is the kept words joined by one space, null where nothing was removed
    (the row's own text stands).  ``seed`` must not exceed ``window``.
    """
    rows = keyed(docs, id_col, text_col)
    found = rows.select("k1", "k2", "text").mapInArrow(partial(_emit_nodes, window=window, seed=seed), _NODES)
    # written first: with both sides of a join read from files, a hot node's rows can be split
    repeated = materialise(found.groupBy("node").count().filter("count > 1").select("node"), "op7-nodes")
    # a join that a grouping follows in the same stage cannot be split, so it is written by itself;
    # rows that repeat hold the same anchors: one copy of them, however often the row repeats
    hits = materialise(found.join(repeated, "node", "left_semi"), "op7-joined")
    hits = materialise(hits.distinct(), "op7-hits")
    along = Window.partitionBy("k1", "k2").orderBy("pos")
    came = hits.withColumn("came", F.when(F.lag("pos").over(along) + F.lag("gap").over(along) == F.col("pos"),
                                          F.lag("edge").over(along)))
    came = came.withColumn("left", F.when(F.col("gap") > 0, F.col("edge")))
    n = F.count(F.lit(1))
    degree = came.groupBy("node").agg(
        ((F.count("left") == n) & (F.min("left") == F.max("left"))).alias("out1"),
        ((F.count("came") == n) & (F.min("came") == F.max("came"))).alias("in1"))
    degree = materialise(degree.select("node", F.coalesce("out1", F.lit(False)).alias("out1"),
                                       F.coalesce("in1", F.lit(False)).alias("in1")), "op7-degrees")
    paths = materialise(hits.join(degree, "node").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("pos", "gap", "out1", "in1")).alias("path")), "op7-paths")
    places = materialise(rows.join(paths, ["k1", "k2"], "left")
                         .mapInArrow(partial(_emit_places, window=window, seed=seed), _PLACES), "op7-places")
    cand = places.select("k1", "k2", F.explode("cands").alias("c")).select("k1", "k2", "c.*")
    twice = materialise(cand.groupBy("h1", "h2", "len").count().filter("count > 1").select("h1", "h2", "len"),
                        "op7-twice")
    gone = materialise(cand.join(twice, ["h1", "h2", "len"], "left_semi")
                       .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "len")).alias("gone")), "op7-gone")
    return places.drop("cands").join(gone, ["k1", "k2"], "left").mapInArrow(
        _emit_result, "k1 long, k2 long, doc_id long, n_words long, n_removed long, kept_sha256 string, "
                      "kept_text string")


# the definition itself, window by window
_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT rid, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM d),
s AS (
  SELECT rid, pos, word, md5(string_agg(word, ' ') OVER ahead) AS h, count(*) OVER ahead AS n FROM e
  WINDOW ahead AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT h FROM s WHERE n = 35 GROUP BY h HAVING count(*) > 1),
f AS (SELECT s.rid, s.pos, s.word, CASE WHEN r.h IS NOT NULL THEN 1 ELSE 0 END AS again FROM s LEFT JOIN r ON s.n = 35 AND s.h = r.h),
c AS (SELECT rid, pos, word, max(again) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT rid, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept
      FROM c GROUP BY rid)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""


@query("op7_substring_dedup", _SQL)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; 35-word windows."""
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with the repeated spans cut from ``text``.

    Rows without a removal keep their text byte for byte; ``n_chars`` (where present)
    follows the new text.
    """
    cut = substring_dedup(docs).filter("kept_text is not null").select("k1", "k2", "kept_text").distinct()
    own = docs.withColumns({"_k1": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"),
                            "_k2": F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))})
    cut = cut.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept_text").alias("_kept"))
    out = own.join(cut, ["_k1", "_k2"], "left")
    new = F.coalesce("_kept", "text")
    cols = [new.alias(c) if c == "text"
            else F.when(F.col("_kept").isNotNull(), F.length("_kept").cast(docs.schema[c].dataType))
            .otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)
