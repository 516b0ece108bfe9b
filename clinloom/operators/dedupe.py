"""Deduplication.

Keep-first is expressed as an aggregate (``min`` / ``min_by`` on the order key), not a
``row_number`` window: the aggregate combines map-side, so a text shared by a third
of all rows (empty or boilerplate notes) is reduced to one row per map task before the
shuffle instead of being sorted in a single window task.  ``dropDuplicates`` is not
used because which row it keeps is unspecified.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Keep, for each value of ``by``, the row with the smallest ``order`` (unique key)."""
    others = [c for c in df.columns if c not in by and c != order]
    aggs = [F.min(order).alias(order)] + [F.min_by(c, order).alias(c) for c in others]
    return df.groupBy(*by).agg(*aggs).select(*df.columns)


def dedupe_text(df: DataFrame, text: str = "text", order: str = "row_id") -> DataFrame:
    """Global keep-first on the text (the first note by ``order`` survives).

    Keyed by a 256-bit hash of the text: rows are compared and sorted by the hash, never
    by whole texts.
    """
    hashed = df.withColumn("_text_hash", F.sha2(F.col(text).cast("binary"), 256))
    return keep_first(hashed, ["_text_hash"], order).drop("_text_hash")


def first_rows(df: DataFrame, text: str = "text", order: str = "row_id", carry: str = "hadm_id") -> DataFrame:
    """W1 without the text: (order, carry) of each different text's first row.

    Fixed-width aggregation buffers (hash aggregates); nothing but the hash, the order
    and the carried key is shuffled.
    """
    return (df.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("_text_hash"))
              .agg(F.min(order).alias(order), F.min_by(carry, order).alias(carry)).drop("_text_hash"))


def dedupe_studies(df: DataFrame, path: str = "text_path",
                   order: Sequence[str] = ("ordertime", "hadm_id", "dicom_id")) -> DataFrame:
    """One row per report path, choosing the first by an explicit order."""
    rank_key = F.struct(*[F.col(c) for c in order])
    others = [c for c in df.columns if c != path]
    picked = df.groupBy(path).agg(F.min_by(F.struct(*[F.col(c) for c in others]), rank_key).alias("_r"))
    return picked.select(path, *[F.col("_r")[c].alias(c) for c in others]).select(*df.columns)


def distinct_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """Exact-text distinct of a corpus (payload is the text only)."""
    return df.select(text).distinct()
