"""Notes arriving as files: clean them continuously (T8), drop annotated notes (J4 as a
stream-static anti-join), keep a category (P4), or apply any other stateless operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.functions.text import clean_text
from clinloom.operators.filters import filter_category
from clinloom.operators.joins import exclude_annotated


def on_files(spark: SparkSession, source_dir: str, schema: T.StructType | str,
             *steps: Callable[[DataFrame], DataFrame], max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of the Parquet files under ``source_dir`` after ``steps``, applied in order.

    A step is any stateless operator of the library with its other arguments bound: filters
    (P), text functions (T), and joins with a static table on the right (J4-J7, E3, E4).
    Static tables are read anew by every micro-batch; those read from files that change show
    their state at that time.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(source_dir)
    for step in steps:
        df = step(df)
    return df


def clean_note_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str,
                      profile: str = "icd", annotations: DataFrame | None = None,
                      category: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of cleaned notes read from Parquet files under ``source_dir``."""
    notes = on_files(spark, source_dir, schema, max_files_per_trigger=max_files_per_trigger)
    if category is not None:
        notes = filter_category(notes, category)
    if annotations is not None:
        notes = exclude_annotated(notes, annotations)
    return notes.withColumn("text", clean_text(F.col("text"), profile))


def write_stream(df: DataFrame, sink_dir: str, checkpoint_location: str, available_now: bool = True):
    """Append to Parquet with a checkpoint (exactly-once file sink); returns the query."""
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
