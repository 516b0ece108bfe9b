"""Operator 12: how document filters overlap, in every order of application.

Filters (a document fails when): ``A`` under 200 words; ``B`` distinct words below half of its
words; ``C`` more than 2 % capitals ``[A-Z]`` of its code points; ``D`` any of ``#$%&*|``; ``E``
the text of a row with a smaller ``doc_id`` (table-wide, removed or not).  Words are maximal
runs of ``[^\\x20\\x09-\\x0D]``.

1.  *Masks.*  One scan turns a text into the bits of A to D and a SHA-256; texts go no further.
    The smallest id of each text decides E.  Equal rows are counted before every shuffle,
    so copies, hot sources and repeated ids stay small.
2.  *Mask cells.*  Per part and mask: documents, those of quality 1, those toxic.  A part has at
    most 32 cells, kept as one row.
3.  *Recursive CTE.*  From the empty prefix of every part, each level appends each unused
    letter, joins the part's mask cells and carries the applied bits; the level's rows are
    that step's metrics.  325 prefixes a part are enumerated once and shared by the 120
    orders that start with them.
4.  *Orders.*  A full order joins its five prefixes; a prefix of length s stands for (5 - s)!
    orders in the letter's sum over all orders (``shapley``).

Defined cases: null and empty texts are one text of no words, which fails A (and E where an
id is larger); a null ``doc_id`` has no label, neither fails E nor makes others fail it; rows that
repeat an id with the same text do not fail E among themselves and count as often as they
occur; several label rows of one id count as their maxima, null labels as 0; a null part is
the empty string; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import materialise

LETTERS = "ABCDE"
MIN_WORDS = 200


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text alone decides (A to D)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {"A": n < MIN_WORDS, "B": 100 * kinds < 50 * n, "C": 100 * capitals > 2 * F.length(text),
             "D": text.rlike(r"[#$%&*|]")}
    out = F.lit(0)
    for letter, bad in fails.items():
        out = out + F.when(bad, _bit(letter)).otherwise(0)
    return out


def mask_cells(docs: DataFrame, labels: DataFrame, part_col: str = "source",
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        text_mask(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("key"))
            .groupBy("key", "id", "part", "own").agg(F.count(F.lit(1)).alias("n")))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    marked = rows.join(known, "id", "left").fillna(0, ["good", "toxic"])
    # one row per text and kind of document: how many, with an id, and at the smallest id among them
    kinds = materialise(marked.groupBy("key", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"),
        F.min("id").alias("low"), F.min_by("n", "id").alias("at_low")), "op12-kinds")
    first = kinds.groupBy("key").agg(F.min("low").alias("first"))
    both = kinds.join(first, "key")
    again = F.col("with_id") - F.when(F.col("low") == F.col("first"), F.col("at_low")).otherwise(0)
    both = both.withColumn("again", F.coalesce(again, F.lit(0)))
    split = both.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("again")).alias("n")),
        F.struct((F.col("own") + F.lit(_bit("E"))).alias("mask"), F.col("again").alias("n")))).alias("c"))
    n = F.col("c.n")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


# every level appends an unused letter to each prefix and reads the step's metrics off the part's cells
_WALK = """
WITH RECURSIVE walk(part, prefix, letter, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT s.part, concat(s.prefix, s.next), s.next, s.applied | s.bit, s.step + 1,
         aggregate(c.cells, 0L, (x, m) -> x + IF(m.mask & (s.applied | s.bit) = 0, m.n, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + IF(m.mask & s.applied = 0 AND m.mask & s.bit != 0, m.n, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + IF(m.mask & s.applied != 0 AND m.mask & s.bit != 0, m.n, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + IF(m.mask = s.bit, m.n, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + IF(m.mask & s.applied = 0 AND m.mask & s.bit != 0, m.good, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + IF(m.mask & s.applied = 0 AND m.mask & s.bit != 0, m.toxic, 0L))
  FROM (SELECT part, prefix, applied, step, next, shiftleft(1, instr({letters}, next) - 1) AS bit
        FROM walk LATERAL VIEW explode(filter(split({letters}, ''), x -> x != '' AND instr(prefix, x) = 0)) AS next
        WHERE step < {depth}) s
  JOIN {cells} c ON c.part = s.part
)
SELECT * FROM walk WHERE step > 0
"""
_METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source",
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")       # 325 rows a part, however many parts
    cells = materialise(mask_cells(docs, labels, part_col, id_col, text_col).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "op12-cells")
    walk = materialise(spark.sql(_WALK, cells=cells, letters=LETTERS, depth=len(LETTERS)), "op12-walk")
    orders = F.element_at(F.array(*[F.lit(math.factorial(len(LETTERS) - s)).cast("long")
                                    for s in range(1, len(LETTERS) + 1)]), F.col("step"))
    shares = walk.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    full = (walk.filter(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
            .withColumn("prefix", F.expr("left(filter_order, step)")))
    return (full.join(walk.drop("step"), ["part", "prefix"]).join(shares, ["part", "letter"])
            .select("part", "filter_order", F.col("step").cast("int").alias("step"), *_METRICS, "shapley"))


_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (len(d.w) < 200)::INT + 2 * (100 * len(list_distinct(d.w)) < 50 * len(d.w))::INT
         + 4 * (100 * length(regexp_replace(d.t, '[^A-Z]+', '', 'g')) > 2 * length(d.t))::INT
         + 8 * regexp_matches(d.t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first.low, false)::INT AS mask
  FROM d JOIN first ON d.t = first.t LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) g),
r AS (
  SELECT c.part, s.filter_order, s.step, s.bit,
         sum(CASE WHEN c.mask & (s.before | s.bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.bit != 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN c.mask & s.before != 0 AND c.mask & s.bit != 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN c.mask = s.bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.bit != 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.bit != 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY c.part, s.filter_order, s.step, s.bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


@query("op12_filter_audit", _SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` and ``labels``, a part per source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
