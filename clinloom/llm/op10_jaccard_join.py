"""Operator 10: n-gram Jaccard self-join by chosen paths.

A document's set holds the hashes of its ``n``-word shingles (5; a text of 1 to n-1 words
is one shingle).  Two documents are linked when the Jaccard similarity of their sets is at
least ``threshold`` (0.8).

1.  *Sets.*  Documents with the same set become one node (partial aggregates; a group of
    copies of any size is one row) with its size and a signature of ``T`` min-hash tokens,
    the embedded set on which the paths are chosen.
2.  *Chosen paths.*  Each of several independent runs splits all sets on a sampled token;
    buckets of one set end there.  A bucket above ``LIMIT`` is split again on ``BRANCH``
    tokens sampled by its path, up to ``DEPTH`` times -- unless it kept more than half of its
    parent's sets: those are near copies, which more splits would only multiply, and go to
    the brute force at once.  A pair whose signatures agree in a share j stays together in a
    run with probability j (1-(1-j)**BRANCH)**(depth-1).  Runs are repeated until a pair at
    ``threshold`` is found with probability ``recall`` (``plan``: over the binomial spread of
    j, all levels split, loss of the signature filter included); a pair above it more often.
3.  *Brute force in buckets.*  Within a bucket, sets whose sizes allow the threshold and
    whose signatures agree in as many places as ``plan`` asks are candidates; a bucket
    yields its candidate groups as stars, never as pairs.  A bucket still above ``LIMIT``
    then is dealt into blocks of ``BUCKET`` sets and every two blocks meet in a task.
4.  *Exact check.*  Candidate groups, joined to components, get their whole shingle sets
    back; every pair inside is counted exactly (again in blocks), giving each set its exact
    links, and the exact links form the classes.  Pairs are counted where they are found
    and never become rows.

Result: one row per document -- ``doc_id``, ``class_id`` (smallest doc_id of its class),
``n_copies`` (documents with the same set, itself included), ``n_links`` (other documents
linked to it, copies included), ``n_texts`` (different sets linked to its own).

Defined cases: null, empty and blank texts have no shingle, link to nothing and are their
own class; rows that repeat are copies; a null ``doc_id`` stays null and a class of null
ids only has a null ``class_id``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import components, keyed, materialise
from clinloom.llm.words import Words, hash_ints, key_runs, mix, release, slabs, spans, windows

N, THRESHOLD = 5, 0.8
RECALL = 0.99999                                         # share of the pairs at the threshold to be found
T, BRANCH, DEPTH, LIMIT, BUCKET, BLOCK, MASS = 128, 2, 4, 512, 16384, 1024, 1 << 20
_U = np.uint64
_MULT = hash_ints(np.arange(T), 11) | _U(1)


def plan(threshold: float, recall: float, branch: int = BRANCH, depth: int = DEPTH, t: int = T) -> tuple[int, int, float]:
    """(agreements asked, runs, expected loss) for pairs at ``threshold``; the loss is at most 1 - ``recall``.

    Of ``t`` signature tokens Binomial(t, threshold) agree.  A tenth of the loss allowed goes to the
    filter, which looks at the same tokens in every run; runs are added until the rest suffices.
    """
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold must lie in (0, 1] and recall in (0, 1)")
    agree = np.arange(t + 1)
    share = agree / t
    p = np.array([math.comb(t, k) * threshold ** k * (1 - threshold) ** (t - k) for k in range(t + 1)])
    below = np.cumsum(p) - p                             # P(fewer agreements)
    need = int(np.flatnonzero(below <= (1 - recall) / 10)[-1])
    apart = 1 - share * (1 - (1 - share) ** branch) ** (depth - 1)
    for runs in range(1, t + 1):
        loss = float(below[need] + (p * apart ** runs)[need:].sum())
        if loss <= 1 - recall:
            return need, runs, loss
    raise ValueError(f"{t} runs do not reach a recall of {recall} at similarity {threshold}: use fewer levels or more branches")


def shingle_sets(words: Words, n: int):
    """The sorted distinct shingle hashes of each row of a slab."""
    h = words.hashes
    win = windows(h, n) if len(h) >= n else np.zeros(0, np.uint64)
    short = (words.counts > 0) & (words.counts < n)
    alone = spans(h, words.first[:-1][short], words.first[1:][short], 7)
    k = 0
    for r in range(words.rows):
        a, b = int(words.first[r]), int(words.first[r + 1])
        if b - a >= n:
            yield np.unique(win[a:b - n + 1])
        elif b > a:
            yield alone[k:k + 1]
            k += 1
        else:
            yield win[:0]


def signature(s: np.ndarray, t: int = T) -> np.ndarray:
    out = np.full(t, 2**32 - 1, np.uint32)
    for lo in range(0, len(s), 1024):
        part = ((s[None, lo:lo + 1024] * _MULT[:t, None]) >> _U(32)).min(axis=1)
        np.minimum(out, part.astype(np.uint32), out=out)
    return out


def _emit_sets(batches, n: int):
    release()
    for batch in batches:
        for words in slabs(batch.column("text")):
            out = []
            for r, s in enumerate(shingle_sets(words, n)):
                if len(s):
                    m = mix(s)
                    out.append((words.row + r, int(s.sum().view(np.int64)), int(m.sum().view(np.int64)), len(s),
                                signature(s).tobytes()))
            if out:
                row, s1, s2, size, sig = zip(*out, strict=True)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").take(at), batch.column("k2").take(at), batch.column("doc_id").take(at),
                     pa.array(s1), pa.array(s2), pa.array(size, pa.int32()), pa.array(sig, pa.binary())],
                    names=["k1", "k2", "doc_id", "s1", "s2", "size", "sig"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), -1)


def _root_tokens(batches, runs: int):
    for batch in batches:
        sig, sid = _matrix(batch.column("sig")), batch.column("sid").to_numpy()
        pick = hash_ints(np.arange(runs), 21)
        for r in range(runs):
            coord = int(pick[r] % _U(sig.shape[1] // runs)) + r * (sig.shape[1] // runs)
            key = mix(sig[:, coord].astype(np.uint64) ^ hash_ints([r], 22)[0])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid)], names=["path", "sid"])


def _next_tokens(batches, branch: int):
    for batch in batches:
        sig, sid = _matrix(batch.column("sig")), batch.column("sid").to_numpy()
        path = batch.column("path").to_numpy().view(np.uint64)
        for b in range(branch):
            coord = (mix(path + _U(b + 1)) % _U(sig.shape[1])).astype(np.int64)
            token = sig[np.arange(len(sid)), coord].astype(np.uint64)
            key = mix(mix(path ^ _U(0x51ED270B + b)) ^ (token * _U(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid), batch.column("parent")],
                                             names=["path", "sid", "parent"])


def _groups(sig: np.ndarray, size: np.ndarray, side: np.ndarray | None, need: int, ratio: float) -> np.ndarray:
    """Group number of each set under ``need`` agreements of signatures (searching outwards from one set at a time).

    With ``side`` (two blocks) only sets of different sides are compared.
    """
    m = len(size)
    group, free = np.full(m, -1, np.int64), np.arange(m)
    while len(free):
        start, free = free[0], free[1:]
        group[start] = start
        queue = [int(start)]
        while queue and len(free):
            i = queue.pop()
            ok = (size[free] >= ratio * size[i]) & (size[i] >= ratio * size[free])
            if side is not None:
                ok &= side[free] != side[i]
            ok = np.flatnonzero(ok)
            ok = ok[(sig[free[ok]] == sig[i]).sum(axis=1) >= need] if len(ok) else ok
            if len(ok):
                new = free[ok]
                group[new] = start
                queue += new.tolist()
                free = np.delete(free, ok)
    return group


def _brute(batches, threshold: float, need: int):
    for t in key_runs(batches, "path"):
        if t.num_rows < 2:
            continue
        t = t.combine_chunks()
        sid, size = t.column("sid").to_numpy(), t.column("size").to_numpy().astype(np.int64)
        side = t.column("side").to_numpy()
        group = _groups(_matrix(t.column("sig")), size, side if side.max() > 0 else None,
                        need, threshold)
        order = np.lexsort((sid, group))
        g, s = group[order], sid[order]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        root = s[np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))]
        keep = root != s
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(root[keep]), pa.array(s[keep])], names=["a", "b"])


def _blocks(df: DataFrame, key: str, n_blocks, width: str) -> DataFrame:
    """Deal each group into blocks by ``sid`` and pair every block with itself and every other.

    Adds ``path`` (hash of group and block pair) and ``side`` (1: only pairs across the two
    blocks count, 0 and 1 naming them; 0 everywhere: all pairs count).
    """
    own = F.pmod(F.xxhash64("sid"), F.col(width)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(width) - 1).cast("int")))
    df = df.withColumn("_own", own).withColumn("_other", other)
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    return (df.withColumn("path", F.xxhash64(F.col(key), lo, hi, F.lit(n_blocks)))
            .withColumn("side", F.when(lo == hi, 0).when(F.col("_own") == lo, 1).otherwise(2))
            .drop("_own", "_other"))


def counts_of_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sorted distinct sets."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    df = np.diff(cut)
    out = np.zeros(m * m, np.int64)
    heavy = []
    for d in np.unique(df[df > 1]).tolist():
        first = cut[:-1][df == d]
        if d > 24:
            heavy += [owner[f:f + d] for f in first.tolist()]
            continue
        x, y = np.triu_indices(d, 1)
        for lo in range(0, len(first), 1 + (1 << 18) // len(x)):
            rows = owner[first[lo:lo + 1 + (1 << 18) // len(x), None] + np.arange(d)]
            out += np.bincount((rows[:, x] * m + rows[:, y]).ravel(), minlength=m * m) if m <= 256 else 0
            if m > 256:
                np.add.at(out, (rows[:, x] * m + rows[:, y]).ravel(), 1)
    out = out.reshape(m, m)
    out += out.T
    for lo in range(0, len(heavy), 1024):
        x = np.zeros((m, min(1024, len(heavy) - lo)), np.float32)
        for j, rows in enumerate(heavy[lo:lo + 1024]):
            x[rows, j] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _exact(batches, threshold: float):
    for t in key_runs(batches, "path"):
        t = t.combine_chunks()
        sid, copies = t.column("sid").to_numpy(), t.column("copies").to_numpy()
        side = t.column("side").to_numpy()
        sets = [np.asarray(x.values).view(np.uint64) for x in t.column("shingles")]
        m = len(sets)
        if m < 2:
            continue
        both = counts_of_pairs(sets)
        size = np.array([len(s) for s in sets], np.int64)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if side.max() > 0:
            linked &= side[:, None] != side[None, :]
        links, texts = linked @ copies, linked.sum(axis=1)
        root = np.arange(m)                                     # smallest index reachable, by halving
        while True:
            low = np.where(linked, root[None, :], m).min(axis=1)
            new = np.minimum(root, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        keep = texts > 0
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid[keep]), pa.array(sid[root[keep]]), pa.array(links[keep].astype(np.int64)),
                 pa.array(texts[keep].astype(np.int64))], names=["sid", "root", "links", "texts"])


def _emit_shingles(batches, n: int):
    for batch in batches:
        for words in slabs(batch.column("text")):
            sets = list(shingle_sets(words, n))
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            arr = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(words.row, words.rows) for c in ("sid", "comp", "copies")), arr],
                names=["sid", "comp", "copies", "shingles"])


def _candidates(sets: DataFrame, threshold: float, recall: float, branch: int, depth: int, limit: int,
                bucket: int) -> DataFrame:
    """Star edges (a, b) of candidate groups over ``sid``."""
    need, runs, _ = plan(threshold, recall, branch, depth)
    tokens = sets.select("sid", "sig").mapInArrow(partial(_root_tokens, runs=runs), "path long, sid long") \
        .withColumn("parent", F.lit(None).cast("long"))
    sig = sets.select("sid", "size", "sig")
    ready = []
    for level in range(1, depth + 1):
        tokens = materialise(tokens, f"op10-tokens{level}")
        count = tokens.groupBy("path").agg(F.count(F.lit(1)).alias("count"), F.max("parent").alias("parent"))
        last = (F.col("count") * 2 > F.coalesce("parent", F.lit(2**62))) | F.lit(level == depth)
        fate = F.when(F.col("count") <= limit, "small").when(last, "brute").otherwise("split")
        count = materialise(count.filter("count > 1").select("path", "count", fate.alias("fate")),
                            f"op10-paths{level}")
        held = tokens.drop("parent").join(count, "path")
        ready.append(held.filter("fate = 'small'").select("path", "sid").withColumn("side", F.lit(0)))
        fates = {r["fate"] for r in count.select("fate").distinct().collect()}
        if "brute" in fates:
            big = held.filter("fate = 'brute'").withColumn("width", F.ceil(F.col("count") / bucket).cast("int"))
            ready.append(_blocks(big, "path", level, "width").select("path", "sid", "side"))
        if "split" not in fates:
            break
        tokens = (held.filter("fate = 'split'").select("path", "sid", F.col("count").alias("parent"))
                  .join(sig.select("sid", "sig"), "sid")
                  .mapInArrow(partial(_next_tokens, branch=branch), "path long, sid long, parent long"))
    rows = ready[0]
    for r in ready[1:]:
        rows = rows.union(r)
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.join(sig, "sid").select("path", "sid", "side", "size", "sig")
            .repartition(parts, "path").sortWithinPartitions("path")
            .mapInArrow(partial(_brute, threshold=threshold, need=need), "a long, b long"))


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
                    branch: int = BRANCH, depth: int = DEPTH, limit: int = LIMIT, bucket: int = BUCKET, block: int = BLOCK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, class_id, n_copies, n_links, n_texts) per input row; ``class_row`` marks
    the key (k1, k2) of the class's first document."""
    rows = keyed(docs, id_col, text_col)
    made = materialise(rows.mapInArrow(
        partial(_emit_sets, n=n), "k1 long, k2 long, doc_id long, s1 long, s2 long, size int, sig binary"), "op10-rows")
    node = ["s1", "s2", "size"]
    sets = made.groupBy(*node).agg(F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"),
                                   F.min(F.struct("k1", "k2")).alias("rep"))
    sets = materialise(sets.withColumn("sid", F.monotonically_increasing_id()), "op10-sets")
    comp = components(_candidates(sets, threshold, recall, branch, depth, limit, bucket), "op10-cand")
    comp = materialise(comp.toDF("sid", "comp"), "op10-comp")
    member = (sets.join(comp, "sid").select("sid", "comp", "copies", "size", F.col("rep.k1").alias("k1"),
                                            F.col("rep.k2").alias("k2")))
    mass = member.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("mass"))
    width = mass.select("comp", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("mass") / MASS))
                        .cast("int").alias("width"))
    text = rows.select("k1", "k2", "text").join(member.drop("size"), ["k1", "k2"]).dropDuplicates(["sid"])
    shingles = materialise(text.select("sid", "comp", "copies", "text").mapInArrow(
        partial(_emit_shingles, n=n), "sid long, comp long, copies long, shingles array<long>"), "op10-shingles")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exact = (_blocks(shingles.join(materialise(width, "op10-width"), "comp"), "comp", 0, "width")
             .select("path", "side", "sid", "copies", "shingles")
             .repartition(parts, "path").sortWithinPartitions("path", "sid")
             .mapInArrow(partial(_exact, threshold=threshold), "sid long, root long, links long, texts long"))
    exact = materialise(exact, "op10-exact")
    links = exact.groupBy("sid").agg(F.sum("links").alias("links"), F.sum("texts").alias("n_texts"))
    roots = components(exact.select(F.col("sid").alias("a"), F.col("root").alias("b")), "op10-class")
    info = (sets.select(*node, "sid", "copies", "rep").join(links, "sid", "left")
            .join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
            .withColumn("root", F.coalesce("root", "sid")))
    info = materialise(info, "op10-info")
    named = made.drop("sig").join(info, node)
    per_class = named.groupBy("root").agg(F.min("doc_id").alias("class_id"),
                                          F.min(F.struct(F.col("doc_id").isNull(), "k1", "k2")).alias("first"))
    named = (named.select("k1", "k2", "doc_id", "root", "copies", "links", "n_texts")
             .join(materialise(per_class, "op10-classes"), "root")
             .select("k1", "k2", "doc_id", "class_id", F.col("copies").alias("n_copies"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
                     ((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))).alias("class_row")))
    blank = rows.filter(F.col("text").rlike("^[ \t-\r]*$")).select(
        "k1", "k2", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"),
        F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"), F.lit(True).alias("class_row"))
    return named.unionByName(blank)


# the definition itself: all documents that share a shingle, links by exact similarity
_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT rid, generate_subscripts(w, 1) AS pos, unnest(w) AS word, len(w) AS n FROM d),
s AS (
  SELECT DISTINCT rid, md5(g) AS sh FROM (
    SELECT rid, pos, n, string_agg(word, ' ') OVER ahead AS g, count(*) OVER ahead AS k FROM e
    WINDOW ahead AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  WHERE k = 5 OR (n < 5 AND pos = 1)),
z AS (SELECT rid, count(*) AS size FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS n_both FROM s a JOIN s b ON a.sh = b.sh WHERE a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y, n_both = zx.size AND n_both = zy.size AS same FROM p JOIN z zx ON zx.rid = x JOIN z zy ON zy.rid = y
      WHERE n_both >= 0.8 * (zx.size + zy.size - n_both) - 1e-9),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
own AS (SELECT rid, least(rid, coalesce(min(y) FILTER (WHERE same), rid)) AS node FROM d LEFT JOIN l ON l.x = d.rid GROUP BY rid)
SELECT d.doc_id,
  (SELECT min(doc_id) FROM (SELECT d.doc_id UNION ALL SELECT o.doc_id FROM reach r JOIN d o ON o.rid = r.y WHERE r.x = d.rid)) AS class_id,
  1 + (SELECT count(*) FROM l WHERE l.x = d.rid AND same) AS n_copies, (SELECT count(*) FROM l WHERE l.x = d.rid) AS n_links,
  (SELECT count(DISTINCT own.node) FROM l JOIN own ON own.rid = l.y WHERE l.x = d.rid AND NOT same) AS n_texts
FROM d
"""


@query("op10_jaccard_join", _SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: five-word shingles, similarity 0.8 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_copies", "n_links", "n_texts")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first document (smallest id, nulls last) of each class stays.

    Documents without a word have no class mates and all stay.
    """
    keep = jaccard_classes(docs).filter("class_row").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    own = docs.withColumns({"_k1": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"),
                            "_k2": F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))})
    blank = F.coalesce(F.col("text"), F.lit("")).rlike("^[ \t-\r]*$")
    kept = own.filter(~blank).join(keep.distinct(), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return kept.unionByName(own.filter(blank)).select(*docs.columns)
