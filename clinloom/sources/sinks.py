"""Sinks (K1-K7).

Writes go through the DataFrameWriter (any Hadoop file system).  Only outputs whose
size is bounded by a parameter (a sample of n rows, a metrics table) are written as a
single file.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterable, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.operators.sampling import sample_n


def write_splits(df: DataFrame, directory: str, split_col: str = "split", fmt: str = "parquet") -> None:
    """K1: one output folder per split (``split=train/...``); readers prune by partition."""
    w = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
             .option("ignoreTrailingWhiteSpace", False)
    w.format(fmt).save(directory)


def write_corpus(df: DataFrame, directory: str, text: str = "text", split_col: str | None = "split") -> None:
    """K2: one document per line, no header, no quoting (D15: one clean line per document)."""
    cols = [F.regexp_replace(F.col(text), "[\\r\\n]+", " ").alias("value")]
    if split_col:
        df.select(*cols, split_col).write.mode("overwrite").partitionBy(split_col).text(directory)
    else:
        df.select(*cols).write.mode("overwrite").text(directory)


def write_filtered(df: DataFrame, path: str) -> None:
    """K3: cleaned / filtered table saved for reuse (Parquet)."""
    df.write.mode("overwrite").parquet(path)


# the characters Spark escapes in the name of a partition folder
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def _report_files(folder: str) -> Callable[[Iterable], None]:
    """Writes a partition of (path, bytes), sorted by path, as files below ``folder``.

    A file has its task's number and gets its name when it is whole, so a repeated task
    replaces what an earlier attempt left.
    """
    def write(rows):
        part = f"part-{TaskContext.get().partitionId():05d}.txt"
        for path, group in itertools.groupby(rows, lambda r: r[0]):
            name = "__HIVE_DEFAULT_PARTITION__" if path is None else \
                _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", path)
            place = os.path.join(folder, f"path={name}")
            os.makedirs(place, exist_ok=True)
            unfinished = os.path.join(place, f".{part}-{TaskContext.get().taskAttemptId()}")
            with open(unfinished, "wb") as f:
                for _, text in group:
                    f.write(text or b"")
                    f.write(b"\n")
            os.replace(unfinished, os.path.join(place, part))
    return write


def write_reports(reports: DataFrame, root: str) -> None:
    """Each report (path, text) as a file of its own in the folder ``path=...`` below ``root``.

    Folders and lines are those of Spark's partitioned text writer, which does the work in any
    store but a shared ``file:`` folder.  There Hadoop starts a process for each permission it sets
    (five a report), so the tasks write the files themselves.
    """
    local = re.match(r"file:(?://[^/]*)?(/.*)$", root)
    if local is None:
        reports.select("path", "text").write.partitionBy("path").text(root)
        return
    folder = local[1]
    os.makedirs(folder, exist_ok=True)
    if os.listdir(folder):
        raise FileExistsError(f"{root} is not empty")
    named = F.when(F.col("path") != "", F.col("path")).alias("path")
    (reports.select(named, F.col("text").cast("binary").alias("text")).sortWithinPartitions("path")
        .foreachPartition(_report_files(folder)))


def checkpoint_table(df: DataFrame, path: str) -> DataFrame:
    """K4: write to Parquet and read back -- cuts lineage; the read-back plan is a plain scan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """K4: a table whose files are dealt by the hash of ``keys`` into ``buckets`` and sorted by them.

    Joins and groupings on ``keys`` between tables of the same bucket number need no exchange,
    however often they run.  Rows meet their bucket before the write, so a bucket is one
    file, not one per task.  ``path`` makes the table external (its files stay when it is
    dropped); an existing table of the name is replaced.
    """
    w = (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, *keys).sortBy(*keys))
    (w.option("path", path) if path else w).saveAsTable(table)
    return df.sparkSession.table(table)


def write_sample(df: DataFrame, n: int, path: str, key: str, seed: int = 42) -> None:
    """K5: a seeded sample of ``n`` rows as one CSV file (bounded by n)."""
    (sample_n(df, n, key, seed).coalesce(1).write.mode("overwrite")
        .option("header", False).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path))


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """K6 format: ``key = value`` lines sorted by key."""
    return metrics.orderBy("metric").select(
        F.concat(F.col("metric"), F.lit(" = "), F.col("value").cast("string")).alias("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """K6: a (metric, value) table as sorted ``key = value`` lines (one small file)."""
    metrics_lines(metrics).coalesce(1).write.mode("overwrite").text(path)


def write_confusion(cm: DataFrame, path: str) -> None:
    """K7: long-form confusion counts (one row per batch / actual / predicted)."""
    cm.write.mode("overwrite").parquet(path)


def read_back(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)
