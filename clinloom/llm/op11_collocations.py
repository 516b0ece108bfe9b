"""Operator 11: phrase collocations from suffix subtrees, partitioned vertically by prefix.

A-Z is lower-cased; texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words
``[^\\x20\\x09]+``.  Everything is counted per language.  The method follows ERA: the tree of all
suffixes, cut off at four words, is never built as a whole.

1.  *Words* are counted (the tree's first level).  A word below ``least`` occurrences is in no
    candidate and ends every suffix.
2.  *Prefixes* are pairs of words.  Their frequencies come from a second scan; only those of
    ``least`` occurrences and more get a subtree.
3.  *Groups by memory budget.*  Prefixes are dealt, in the order of their hash, into groups of at
    most ``budget`` suffixes each (plus the prefix that passes the mark); a prefix above the
    budget is extended: its suffixes are divided by their next words.
4.  *Subtrees.*  A third scan sends every suffix under such a prefix, cut at the first pair that
    is too rare, to its group.  A group sorts its suffixes -- the leaves of its subtrees from left
    to right -- and reads each node's count off the totals of its leaves.
5.  *Scores.*  A node's prefix and its rest after the first word are nodes as well, so the counts of
    all its cuts come from joins of one level with the next shorter one.

Tasks skip rare words and pairs by bitmaps of fixed size (``WORD_BITS``, ``PAIR_BITS``), which may
let rare ones pass; thresholds are decided on exact counts.  Words are 64-bit hashes between
the scans (a run in which two words of the vocabulary share one is refused), and a task sums
up equal pairs and suffixes by a 64-bit hash of their words.

Defined cases: null and empty texts have no words; a null language is ``und``; rows that repeat
count as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.bits import bit_set, held
from clinloom.llm.catalog import query, table
from clinloom.llm.shared import materialise, small_batches
from clinloom.llm.words import SLAB_BYTES, Words, key_runs, mix, release, texts, trim

LEAST, TOP, DEPTH = 30, 2000, 4
BUDGET = 1 << 20                     # suffixes of a group
WORD_BITS, PAIR_BITS = 26, 27
HELD = 1 << 21                       # entries a task holds before it hands them on
SALT = 32
_U = np.uint64
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TEXT = "lang string, text string"


class Pieces(Words):
    """Words of a slab; ``joined[i]``: words i and i + 1 stand in one piece.  ``ids`` hash word and language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.row, self.rows, self.offsets, self._hash = 0, len(offsets) - 1, offsets, None
        self.data = _LOWER[data]
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        here = inside[1:-1]
        self.starts = np.flatnonzero(here & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        breaks, row = np.cumsum(kind == 2)[self.starts], self.row_of_word()
        self.joined = (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])
        self.ids = mix(self.hashes + langs[row]) | _U(1)              # never 0, which stands for no word


def slabs(batch: pa.RecordBatch) -> Iterator[tuple[int, Pieces]]:
    """(first row, words) of slabs of whole rows."""
    trim()
    code = batch.column("lang").dictionary_encode()
    names = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in code.dictionary.to_pylist()]
    langs = np.array(names, _U)[code.indices.to_numpy()] if len(batch) else np.zeros(0, _U)
    data, off = texts(batch.column("text"))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLAB_BYTES, side="right")) - 1)
        yield i, Pieces(data[off[i]:off[j]], off[i:j + 1] - off[i], langs[i:j])
        i = j


def combine(stream, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums ``n`` of rows that share ``key``, over up to ``HELD`` rows of a task at a time.

    ``stream`` yields dicts of equally long arrays (NumPy or Arrow) with a unique ``key``.
    """
    kept, size = [], 0

    def merged():
        t = pa.Table.from_pylist([]) if not kept else pa.concat_tables(kept)
        key = t.column("key").to_numpy()
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(back, t.column("n").to_numpy(), len(first)).astype(np.int64)
        t = t.take(pa.array(first))
        return t.set_column(t.schema.get_field_index("n"), "n", pa.array(n))

    for part in stream:
        kept.append(pa.table(part))
        size += len(part["n"])
        if size >= HELD:
            kept = [merged()]
            size = kept[0].num_rows
            if size >= HELD // 2:
                yield from kept[0].select(columns).combine_chunks().to_batches(1 << 16)
                kept, size = [], 0
    if size:
        yield from merged().select(columns).combine_chunks().to_batches(1 << 16)


def _words(batches):
    release()

    def parts():
        for batch in batches:
            lang = batch.column("lang")
            for lo, p in slabs(batch):
                if not len(p):
                    continue
                ids, first, n = np.unique(p.ids, return_index=True, return_counts=True)
                row = np.searchsorted(p.first, first, side="right") - 1
                raw = p.data.tobytes()
                word = [raw[a:b] for a, b in zip(p.starts[first].tolist(), p.ends[first].tolist(), strict=True)]
                yield {"key": ids.view(np.int64), "lang": lang.take(pa.array(lo + row)),
                       "word": pa.array(word, pa.binary()).cast(pa.string()), "n": n}
    for b in combine(parts(), ["key", "lang", "word", "n"]):
        yield b.rename_columns(["id", "lang", "word", "n"])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * _U(0x9E3779B97F4A7C15) + b)


def _common_pairs(p: Pieces, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of neighbours in one piece that are both common words."""
    ok = held(words, p.ids)
    at = np.flatnonzero(p.joined & ok[:-1] & ok[1:]) if len(p) else np.zeros(0, np.int64)
    return at, pair_hash(p.ids[at], p.ids[at + 1])


def _pairs(batches, words):
    release()

    def parts():
        for batch in batches:
            for _, p in slabs(batch):
                _, h = _common_pairs(p, words.value)
                if len(h):
                    key, n = np.unique(h.view(np.int64), return_counts=True)
                    yield {"key": key, "n": n}
    for b in combine(parts(), ["key", "n"]):
        yield b.rename_columns(["pair", "n"])


def _suffixes(batches, words, pairs, groups):
    """(grp, w1 .. w4, n): suffixes under common prefixes, cut at the first rare pair (0: none)."""
    release()
    starts, heavy, parts_of = groups.value

    def parts():
        for batch in batches:
            for _, p in slabs(batch):
                at, h = _common_pairs(p, words.value)
                good = held(pairs.value, h)
                at, h = at[good], h[good]
                if not len(at):
                    continue
                deep = np.zeros(len(p) + 2, bool)
                deep[at] = True
                ids = np.concatenate([p.ids, np.zeros(2, _U)])
                w3 = np.where(deep[at + 1], ids[np.minimum(at + 2, len(ids) - 1)], _U(0))
                w4 = np.where(deep[at + 1] & deep[at + 2], ids[np.minimum(at + 3, len(ids) - 1)], _U(0))
                rest = pair_hash(w3, w4)
                key, first, n = np.unique(mix(h + rest * _U(3)), return_index=True, return_counts=True)
                at, h, w3, w4, rest = at[first], h[first].view(np.int64), w3[first], w4[first], rest[first]
                grp = np.maximum(np.searchsorted(starts, h, side="right") - 1, 0)
                if len(heavy):                            # a prefix above the budget: by its next words
                    k = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    mine = heavy[k] == h
                    grp = np.where(mine, -1 - ((k << 24) + (rest % parts_of[k].astype(_U)).astype(np.int64)), grp)
                yield {"key": key.view(np.int64), "grp": grp, "w1": ids[at].view(np.int64),
                       "w2": ids[at + 1].view(np.int64), "w3": w3.view(np.int64), "w4": w4.view(np.int64), "n": n}
    yield from combine(parts(), ["grp", "w1", "w2", "w3", "w4", "n"])


def subtree(w: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, first leaf, count) of the nodes of depth 2 .. len(w) over leaves in lexicographic order."""
    new = np.zeros(len(n), bool)
    new[:1] = True
    for d, col in enumerate(w, 1):
        new[1:] |= col[1:] != col[:-1]
        if d >= 2:
            at = np.flatnonzero(new)
            real = col[at] != 0                           # the leaf of a shorter suffix is no node here
            yield d, at[real], np.add.reduceat(n, at)[real] if len(at) else n


def _nodes(batches, least: int):
    """Counts of the subtrees' nodes; those of divided prefixes are partial and keep all rows."""
    release()
    for t in key_runs(batches, "grp"):
        t = t.combine_chunks()
        w = [t.column(f"w{i}").to_numpy() for i in range(1, DEPTH + 1)]
        partial_ = t.column("grp")[0].as_py() < 0
        for d, at, a in subtree(w, t.column("n").to_numpy()):
            if not partial_:
                at, a = at[a >= least], a[a >= least]
            cols = [pa.array(w[i][at]) if i < d else pa.array(np.zeros(len(at), np.int64)) for i in range(DEPTH)]
            out = pa.RecordBatch.from_arrays([*cols, pa.array(a), pa.array(np.full(len(at), partial_))],
                                             names=["w1", "w2", "w3", "w4", "a", "part"])
            for lo in range(0, len(at), 1 << 16):
                yield out.slice(lo, 1 << 16)


def prefix_groups(pairs: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first pair of each group, pairs above the budget, their number of parts), ascending.

    One number per ``budget`` suffixes reaches the driver.
    """
    share = F.when(F.col("n") > budget, 0).otherwise(F.col("n"))
    sliced = pairs.select("pair", share.alias("n"), F.shiftright("pair", 48).alias("slice"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)       # 65,536 slices at most
    offsets = sliced.groupBy("slice").agg(F.sum("n").alias("n")).select(
        "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    along = Window.partitionBy("slice").orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)
    groups = (sliced.withColumn("done", F.coalesce(F.sum("n").over(along), F.lit(0)))
              .join(F.broadcast(offsets), "slice")
              .groupBy(F.floor((F.col("done") + F.col("offset")) / F.lit(budget)).alias("grp")).agg(F.min("pair").alias("start")))
    starts = np.sort(np.array([r["start"] for r in groups.select("start").collect()], np.int64))
    big = sorted((r["pair"], r["n"]) for r in pairs.filter(F.col("n") > budget).collect())
    return starts, np.array([p for p, _ in big], np.int64), np.array([-(-n // budget) for _, n in big], np.int64)


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, lang_col: str = "lang",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vocabulary: id, lang, word, f; phrases: w1, w2, w3, w4, a of ``least`` occurrences and more, 0 for no word)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocab = materialise(rows.mapInArrow(_words, "id long, lang string, word string, n long")
                        .groupBy("id", "lang", "word").agg(F.sum("n").alias("f")), "op11-words")
    if vocab.groupBy("id").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two words share a hash: change the seed of the word hash")
    words = sc.broadcast(bit_set(vocab.filter(F.col("f") >= least), "id", WORD_BITS))
    pairs = materialise(rows.mapInArrow(partial(_pairs, words=words), "pair long, n long")
                        .groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "op11-pairs")
    common = sc.broadcast(bit_set(pairs, "pair", PAIR_BITS))
    groups = sc.broadcast(prefix_groups(pairs, budget))
    leaves = rows.mapInArrow(partial(_suffixes, words=words, pairs=common, groups=groups),
                             "grp long, w1 long, w2 long, w3 long, w4 long, n long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = materialise(leaves.repartition(parts, "grp").sortWithinPartitions("grp", "w1", "w2", "w3", "w4")
                        .mapInArrow(partial(_nodes, least=least),
                                    "w1 long, w2 long, w3 long, w4 long, a long, part boolean"), "op11-nodes")
    key = ["w1", "w2", "w3", "w4"]
    divided = nodes.filter("part").groupBy(*key).agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return vocab, nodes.filter("NOT part").select(*key, "a").union(divided)


def _score(*cuts) -> F.Column:
    """The lowest-scoring cut as (score, k, l, r); cuts are (l, r) for k = 1, 2, ..."""
    exact = F.lit(2_000_000).cast("decimal(20,0)") * F.col("a").cast("decimal(18,0)")
    options = []
    for k, (left, right) in enumerate(cuts, 1):
        both = (F.col(left).cast("decimal(19,0)") + F.col(right)).cast("decimal(38,0)")
        score = F.call_function("div", exact.cast("decimal(38,0)"), both)
        options.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    return F.array_min(F.array(*options))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score); see the module text."""
    vocab, nodes = phrase_counts(docs, least, budget, lang_col, text_col)
    nodes = materialise(nodes, "op11-phrases")
    word = vocab.filter(F.col("f") >= least)
    two = (nodes.filter("w3 = 0").select("w1", "w2", "a")
           .join(word.select(F.col("id").alias("w1"), "lang", F.col("word").alias("one"), F.col("f").alias("f1")), "w1")
           .join(word.select(F.col("id").alias("w2"), F.col("word").alias("last"), F.col("f").alias("f2")), "w2")
           .select("w1", "w2", "lang", F.concat_ws(" ", "one", "last").alias("phrase"), "last", "a", "f1", "f2"))
    two = materialise(two, "op11-two")
    three = (nodes.filter("w3 != 0 AND w4 = 0").select("w1", "w2", "w3", "a")
             .join(two.select("w1", "w2", "lang", F.col("phrase").alias("head"), "f1", F.col("a").alias("a12")), ["w1", "w2"])
             .join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), "last", F.col("a").alias("a23"),
                              F.col("f2").alias("f3")), ["w2", "w3"])
             .select("w1", "w2", "w3", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "f1", "a12", "a23", "f3"))
    three = materialise(three, "op11-three")
    four = (nodes.filter("w4 != 0")
            .join(three.select("w1", "w2", "w3", "lang", F.col("phrase").alias("head"), "f1", "a12", F.col("a").alias("a123")),
                  ["w1", "w2", "w3"])
            .join(three.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), "last",
                               F.col("a").alias("a234"), F.col("a23").alias("a34"), F.col("f3").alias("f4")), ["w2", "w3", "w4"])
            .withColumn("phrase", F.concat_ws(" ", "head", "last")))
    # a pair within four words is within three of them, which occur at least as often
    in_three = (three.select("w1", "w2", "a").union(three.select("w2", "w3", "a"))
                .groupBy("w1", "w2").agg(F.max("a").alias("longer")))
    in_four = (nodes.filter("w4 != 0").select("w1", "w2", "w3", "a").union(nodes.filter("w4 != 0").select("w2", "w3", "w4", "a"))
               .groupBy("w1", "w2", "w3").agg(F.max("a").alias("longer")))
    wide = "decimal(38,0)"
    free = F.col("longer").isNull() | (100 * F.col("longer").cast(wide) < 80 * F.col("a").cast(wide))
    cols = ["lang", "phrase", "a", "s.l", "s.r", "s.score"]
    found = (two.join(in_three, ["w1", "w2"], "left").filter(free)
             .withColumn("s", _score(("f1", "f2"))).select(*cols)
             .union(three.join(in_four, ["w1", "w2", "w3"], "left").filter(free)
                    .withColumn("s", _score(("f1", "a23"), ("a12", "f3"))).select(*cols))
             .union(four.withColumn("s", _score(("f1", "a234"), ("a12", "a34"), ("a123", "f4"))).select(*cols)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALT))       # a language's first rows are among the first of each share
    some = (found.withColumn("salt", salt)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
            .filter(F.col("rank") <= top).drop("salt"))
    best = (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .filter(F.col("rank") <= top))
    totals = vocab.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT rid, lang, generate_subscripts(ps, 1) AS pid, unnest(ps) AS piece FROM d),
ws AS (SELECT rid, lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT rid, lang, pid, generate_subscripts(w, 1) AS pos, unnest(w) AS w1 FROM ws),
g AS (SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3, lead(w1, 3) OVER s AS w4 FROM t
      WINDOW s AS (PARTITION BY rid, pid ORDER BY pos)),
f AS (
  SELECT lang, w1 AS x, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, x, f AS a, string_split(x, ' ') AS w FROM f WHERE f >= 30 AND len(string_split(x, ' ')) > 1),
cut AS (
  SELECT lang, x, w, a, k, array_to_string(w[1:k], ' ') AS y, array_to_string(w[k + 1:], ' ') AS z
  FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < len(w)),
scored AS (
  SELECT cut.lang, cut.x, cut.w, cut.a, k, fl.f AS l, fr.f AS r,
         ((2000000::HUGEINT * cut.a) // (fl.f + fr.f))::BIGINT AS score
  FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.x = y JOIN f fr ON fr.lang = cut.lang AND fr.x = z),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS x, max(a) AS a
  FROM c, (SELECT unnest([1, 2, 3]) AS i) s, (SELECT unnest([2, 3]) AS m) u WHERE m < len(w) AND i + m - 1 <= len(w) GROUP BY ALL),
left_over AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, x) WHERE inside.a IS NULL OR 100 * inside.a < 80 * low.a),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, x) AS rank FROM left_over)
SELECT lang, rank, x AS phrase, a, l, r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", _SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: phrases of 30 occurrences and more, the first 2000 of each language."""
    return collocations(table(spark, sf_dir, "documents"))
