"""Small Spark helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.session import ensure_checkpoint_dir


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can read, and keeps column pruning and
    filter pushdown for the readers (an RDD checkpoint would lose both).  ``codec`` is the
    files' compression, the session's where none is given.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand documents to Python tasks in batches of at most ``rows`` (a session setting).

    Texts are wide: Spark's default of 10 000 rows a batch costs each task some hundred
    megabytes on both sides, whatever the operator does with them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, text): rows under a non-null key made of id and content.

    Rows that repeat with the same id and text share a key and are treated alike; rows
    that share only the id get different keys.
    """
    small_batches(docs.sparkSession)
    d, t = F.col(id_col), F.col(text_col)
    return docs.select(F.coalesce(d, F.lit(0)).cast("long").alias("k1"),
                       F.xxhash64(d.isNull(), F.coalesce(t, F.lit(""))).alias("k2"),
                       d.cast("long").alias("doc_id"), F.coalesce(t, F.lit("")).alias("text"))


def components(edges: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of ``edges``.

    Alternates large-star and small-star steps (each a grouped minimum and a join on the
    node) until the edges stop changing; the number of rounds grows with the logarithm of
    the longest path.  The minima are written before the join, so that both sides of it
    are shuffled from files and adaptive execution can split a node with many neighbours.
    """
    e = (edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
         .filter("lo < hi").distinct())
    e = materialise(e, f"{name}-edges")
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.union(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")), f"{name}-large")
        large = (both.filter("v > u").join(low, "u")
                 .select(F.least("m", "u").alias("lo"), F.col("v").alias("hi")).distinct())
        large = materialise(large, f"{name}-e1")
        low = materialise(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}-small")
        small = (large.join(low, "hi").select("m", F.explode(F.array("lo", "hi")).alias("v"))
                 .filter("m < v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        e = materialise(small, f"{name}-e2")
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
