"""Sources (S1-S9): fixed schemas, no inference.

Column names are lower-cased on read.  gzip CSV with multi-line quoted text cannot be
split, so a large single file is repartitioned right after the scan (or converted to
Parquet once with ``sinks.write_filtered``).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.functions.text import is_corpus_line
from clinloom.operators.worker import PIECE_BYTES
from clinloom.session import materialise

# Columns of the source tables by name; a file may hold any of them in any order.  Codes
# and ids that carry leading zeros or an optional ".0" are strings first.
NOTE_COLUMNS = {"row_id": "bigint", "subject_id": "bigint", "hadm_id": "bigint", "chartdate": "string",
                "charttime": "string", "storetime": "string", "category": "string", "description": "string",
                "cgid": "string", "iserror": "string", "text": "string"}
CODE_COLUMNS = {"row_id": "bigint", "subject_id": "bigint", "hadm_id": "bigint", "seq_num": "int"}
# The linkage job's tables and the phenotype annotations.
TABLE_COLUMNS = {
    "annotations": {"row_id": "bigint", "hospital_admission_id": "bigint", "subject_id": "bigint", "unsure": "int"},
    "studies": {"subject_id": "bigint", "study_id": "bigint", "path": "string"},
    "records": {"subject_id": "bigint", "study_id": "bigint", "dicom_id": "string", "path": "string"},
    "metadata": {"dicom": "string", "study_date": "string", "study_time": "string"},
    "diagnoses": {"subject_id": "bigint", "hadm_id": "bigint", "seq_num": "int", "icd_code": "string",
                  "icd_version": "int"},
    "dictionary": {"icd_code": "string", "icd_version": "int", "long_title": "string"},
    "orders": {"subject_id": "bigint", "hadm_id": "bigint", "ordertime": "timestamp_ntz", "order_type": "string",
               "order_subtype": "string"},
}

PAIR_SCHEMA = T.StructType([
    T.StructField("pairID", T.StringType()),
    T.StructField("sentence1", T.StringType()),
    T.StructField("sentence2", T.StringType()),
    T.StructField("gold_label", T.StringType()),
])

PAIR_FILES = {"train": "mli_train_v1.jsonl", "dev": "mli_dev_v1.jsonl", "test": "mli_test_v1.jsonl"}


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a freshly read scan that has fewer partitions than the cluster has
    cores (a single Parquet row group, one gzip CSV); a no-op for normally split input.

    Call it on a plain scan only: the partition count of a scan is known from planning,
    without running anything.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def read_table(spark: SparkSession, path: str, types: dict[str, str], required: Sequence[str] = (),
               columns: Sequence[str] | None = None, others: str = "string") -> DataFrame:
    """A CSV with a header (quoted multi-line text), columns bound by name in any order and case.

    ``types`` gives the type of each known column, ``others`` that of the rest.  A missing
    required (or selected) column is refused; a file of the folder with another header, a
    row with too few or too many fields and a value that does not fit its type fail the job.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "FAILFAST"}
    names = spark.read.options(**options).csv(path).columns
    have = {n.strip().lower(): n for n in names}
    missing = [c for c in (*required, *(columns or ())) if c.lower() not in have]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {names}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).options(**options, enforceSchema=False).csv(path)
    cols = []
    for low, name in have.items():
        c, kind = F.col(f"`{name}`"), types.get(low, others)
        if kind in ("bigint", "int"):
            c = c.cast("double").cast(kind)                  # "123" or "123.0"
        cols.append(c.cast(kind).alias(low))
    df = raw.select(*cols)
    return df.select(*columns) if columns else df


def read_notes(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               num_partitions: int | None = None) -> DataFrame:
    """A notes CSV, raw or cleaned: any subset and order of the NOTEEVENTS columns; optional selection."""
    df = read_table(spark, path, NOTE_COLUMNS, ["text"], columns)
    return df.repartition(num_partitions) if num_partitions else spread(df)


def read_codes(spark: SparkSession, path: str, code_col: str = "icd9_code") -> DataFrame:
    """Diagnosis / procedure code events; the code column (ICD-9 or ICD-10) is a string."""
    return read_table(spark, path, CODE_COLUMNS, ["hadm_id", "seq_num", code_col])


def read_named(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """S1/S2 for the other source tables (``TABLE_COLUMNS``): annotations, studies, records, DICOM
    metadata, diagnoses, dictionary and orders.  Annotation label columns are integers."""
    types = TABLE_COLUMNS[table]
    required = [c for c in types if c not in ("hospital_admission_id", "subject_id", "path", "order_type")]
    if table == "studies":
        required = ["study_id", "path"]
    return read_table(spark, path, types, required, columns, "int" if table == "annotations" else "string")


def read_pairs_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S3: one JSON object per line; missing ``gold_label`` -> null; a bad line fails the job."""
    df = spark.read.schema(PAIR_SCHEMA).option("mode", "FAILFAST").json(path)
    return df.withColumnRenamed("pairID", "pair_id")


def load_pair_splits(spark: SparkSession, directory: str, files: dict[str, str] = PAIR_FILES) -> DataFrame:
    """The train / dev / test files read in one scan, ``split`` from the file name."""
    paths = [f"{directory.rstrip('/')}/{name}" for name in files.values()]
    df = spark.read.schema(PAIR_SCHEMA).option("mode", "FAILFAST").json(paths)
    split = None
    for s, name in files.items():
        # a split may be a single file or a folder of part files with that name
        cond = F.col("_metadata.file_path").rlike("/" + re.escape(name) + "(/|$)")
        split = F.when(cond, F.lit(s)) if split is None else split.when(cond, F.lit(s))
    return df.select(F.col("pairID").alias("pair_id"), "sentence1", "sentence2", "gold_label", split.alias("split"))


def flatten_struct(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """Expand a struct column into one column per leaf, named ``a.b`` like json_normalize."""
    def leaves(dt: T.StructType, prefix: list[str]):
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path)
            else:
                yield path
    struct_type = df.schema[column].dataType
    others = [F.col(c) for c in df.columns if c != column]
    cols = []
    for path in leaves(struct_type, []):
        ref = F.col(column)
        for p in path:
            ref = ref.getField(p)
        cols.append(ref.alias(sep.join(path)))
    return df.select(*others, *cols)


def flatten_json(df: DataFrame, column: str, schema: T.StructType | str, sep: str = ".") -> DataFrame:
    """Parse a JSON string column with a fixed schema and flatten nested objects."""
    parsed = df.withColumn(column, F.from_json(F.col(column), schema))
    return flatten_struct(parsed, column, sep)


# Spark's name for the most tasks that list the folders below a path
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# files that Hadoop's readers unpack, by the end of their name
_PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
# small files that one task reads, and rows of an Arrow batch of names or texts
FILES_PER_TASK, BATCH_ROWS = 1024, 4096
_FOUND = pa.schema([("path", pa.binary()), ("folder", pa.bool_())])
_READ = pa.schema([("_fp", pa.string()), ("text", pa.binary())])


def local_folder(root: str) -> str | None:
    """The folder of a ``file:`` path, which every executor shares; None for other stores, files and patterns."""
    local = re.match(r"file:(?://[^/]*)?(/.*)$", root)
    folder = re.sub("/+", "/", local[1]) if local else ""
    return folder if os.path.isdir(folder) and not re.search(r"[{}\[\]*?\\]", folder) else None


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark leaves out as it lists a folder."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(folder: bytes, whole: bool) -> Iterator[tuple[bytes, bool]]:
    """(path, is a folder) of what Spark sees in ``folder``; ``whole`` gives the files below it, at any depth."""
    with os.scandir(folder) as found:
        for e in found:
            below = e.is_dir()
            if _hidden(os.fsdecode(e.name), below) or e.is_symlink() and not os.path.exists(e.path):
                continue
            if below and whole:
                yield from _entries(e.path, True)
            else:
                yield e.path, below


def _arrow(rows: Iterable[tuple], schema: pa.Schema, nbytes: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``BATCH_ROWS`` rows and ``PIECE_BYTES`` bytes (one row at least)."""
    held, size = [], 0
    for row in rows:
        if held and (len(held) == BATCH_ROWS or size + nbytes(row) > PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
        held.append(row)
        size += nbytes(row)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _list_folders(whole: bool) -> Callable[[Iterable], Iterator]:
    """Folders among (path, folder) rows give way to their entries, files stay."""
    def work(batches):
        def rows():
            for batch in batches:
                for path, folder in zip(*(c.to_pylist() for c in batch.columns)):
                    if folder:
                        yield from _entries(path, whole)
                    else:
                        yield path, False
        return _arrow(rows(), _FOUND, lambda r: len(r[0]))
    return work


def _read_whole(batches: Iterable) -> Iterator:
    """(_fp, text as bytes) of each path; empty files have no row, as in Spark."""
    def rows():
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    text = f.read()
                if text:
                    yield "file:" + quote(path), text
    return _arrow(rows(), _READ, lambda r: len(r[1]))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` (bytes) of every file below a shared folder, written by the tasks that list it.

    Two levels are dealt out folder by folder, what is deeper is walked by the task that has it.
    """
    tasks = 8 * spark.sparkContext.defaultParallelism
    schema = "path binary, folder boolean"
    found = spark.createDataFrame([(os.fsencode(folder), True)], schema).coalesce(1)
    for _ in range(2):
        found = found.mapInArrow(_list_folders(False), schema).repartition(tasks, "path")
    return materialise(found.mapInArrow(_list_folders(True), schema).select("path"), "listing")


def read_small_files(spark: SparkSession, root: str) -> DataFrame:
    """The whole text of every file under ``root``, for folders of many small files.

    Below a ``file:`` folder the tasks list the folders and read the files: Spark's scan holds
    every file's status, path and split on the driver, more than a kilobyte each.  In other stores
    the scan lists them, by a few tasks per core (Spark takes one per folder, up to 10,000); it counts
    4 MB for opening a file, however small, so its partitions hold a handful of small files, and up
    to 32 of them are read by one task, as long as each core has 8 tasks.
    """
    folder = local_folder(root)
    if folder is not None:
        files = list_files(spark, folder)
        packed = F.col("path").cast("string").rlike(_PACKED)
        n, some_packed = files.agg(F.count("path"), F.max(packed)).first()
        if not some_packed:
            tasks = max(8 * spark.sparkContext.defaultParallelism, n // FILES_PER_TASK)
            return (files.repartition(tasks, "path").mapInArrow(_read_whole, "_fp string, text binary")
                    .select("_fp", F.col("text").cast("string").alias("text")))
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 8 * cores)))
    try:
        df = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    finally:
        spark.conf.set(LISTING_TASKS, before)
    parts = df.rdd.getNumPartitions()
    tasks = max(8 * cores, parts // 32)
    df = df.select(F.col("_metadata.file_path").alias("_fp"), F.col("value").alias("text"))
    return df.coalesce(tasks) if tasks < parts else df


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` as one row (path relative to root, whole text).

    File paths arrive as encoded URIs; names are decoded, so blanks, ``%`` and ``+`` read as
    written.  A file outside ``root`` fails the job.
    """
    df = read_small_files(spark, root)
    plain = F.url_decode(F.regexp_replace("_fp", r"\+", "%2B"))
    folder = urlparse(root.replace("#", "%23").replace("?", "%3F")).path if "://" in root else root
    folder = unquote(folder) if "://" in root else folder
    pattern = ("(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?/*"
               + re.escape(folder.strip("/")) + "/(.*)$")
    found = F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, 1)).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {root}: "), plain)).cast("string"))
    return df.select(found.alias("path"), "text")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, quote: str | None = None) -> DataFrame:
    """Tab-separated, no header; ``quote=None`` turns quoting off."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", False)
            .option("quote", quote if quote is not None else "").option("mode", "FAILFAST").csv(path))


def read_corpus_lines(spark: SparkSession, path: str, min_chars: int = 10) -> DataFrame:
    """S8 + P11: one document per line; keep lines longer than ``min_chars`` and not blank."""
    df = spark.read.text(path).withColumnRenamed("value", "text")
    return df.where(is_corpus_line(F.col("text"), min_chars))


def run_query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Standard SQL over registered views (the warehouse step of the reference)."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
