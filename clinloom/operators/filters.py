"""Projections, filters and expectations.

Filters are plain ``where`` clauses so Catalyst pushes them into the Parquet scan;
membership tests against data (label sets) are semi-joins, not literal IN lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clinloom.functions.text import NOTE_CATEGORIES, is_corpus_line, trim_category


def select_renamed(df: DataFrame, columns: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Keep ``columns`` (in order) and rename some of them."""
    out = df.select(*columns)
    return out.withColumnsRenamed(renames) if renames else out


def cast_to_string(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """String columns; null stays null (never the text 'nan')."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``subset`` is null.

    Written as explicit ``IS NOT NULL`` predicates (not ``dropna``) so the optimizer can
    turn a following outer join into an inner one and infer join filters.
    """
    cond = None
    for c in subset:
        term = F.col(c).isNotNull()
        cond = term if cond is None else cond & term
    return df.where(cond) if cond is not None else df


def filter_category(df: DataFrame, name: str, column: str = "category") -> DataFrame:
    """P4 + T12: keep one note category, compared after trimming; ``'all'`` keeps every row."""
    if name == "all":
        return df
    if name not in NOTE_CATEGORIES:
        raise ValueError(f"category must be one of {NOTE_CATEGORIES} or 'all', got {name!r}")
    # ``contains`` is implied by the trimmed equality and, unlike ``trim``, can be pushed
    # into a Parquet scan (StringContains), so non-matching data is skipped early.
    return df.where(F.col(column).contains(name) & (trim_category(F.col(column)) == F.lit(name)))


def filter_seq(df: DataFrame, seq: int | str, column: str = "seq_num") -> DataFrame:
    """P5: keep one sequence number, or everything for ``'all'``."""
    if seq == "all":
        return df
    return df.where(F.col(column) == F.lit(int(seq)))


def filter_in(df: DataFrame, column: str, values: DataFrame, values_column: str | None = None) -> DataFrame:
    """Membership in a set held as data -> left-semi join.

    The value set is usually small (a label list); the planner broadcasts it when its
    size estimate is under the broadcast threshold and shuffles otherwise.
    """
    vc = values_column or column
    keys = values.select(F.col(vc).alias(column)).distinct()
    return df.join(keys, on=column, how="left_semi")


def where_all(df: DataFrame, *conditions: Column) -> DataFrame:
    """Conjunctive predicate."""
    cond = conditions[0]
    for c in conditions[1:]:
        cond = cond & c
    return df.where(cond)


def drop_unsure(df: DataFrame, unsure: str = "unsure",
                bookkeeping: Sequence[str] = ("subject_id", "hadm_id", "batch_id", "operator")) -> DataFrame:
    """Keep sure annotations only and drop the bookkeeping columns."""
    present = [c for c in bookkeeping if c in df.columns]
    return df.where(F.col(unsure) == 0).drop(unsure, *present)


def corpus_lines(df: DataFrame, column: str = "text", min_chars: int = 10) -> DataFrame:
    """Keep lines longer than ``min_chars`` that are not blank."""
    return df.where(is_corpus_line(F.col(column), min_chars))


def expectations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """P10: one aggregate pass evaluating named boolean row checks.

    Returns ``(name, passed, observed)`` where ``observed`` is the number of rows that
    fail the check; ``passed`` is ``observed == 0``.  Add a check of the form
    ``F.lit(True)`` and compare ``rows`` for a row-count expectation.
    """
    aggs = [F.count_if(~F.coalesce(cond, F.lit(False))).alias(name) for name, cond in checks.items()]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in checks)
    return (wide.selectExpr(f"stack({len(checks)}, {stack}) AS (name, observed)")
            .select("name", (F.col("observed") == 0).alias("passed"), F.col("observed").cast("bigint").alias("observed")))


def observed_expectations(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """P10 in the pass that uses the rows: (``df`` with its checks observed, the report).

    The counts are collected while an action runs over the returned frame (or over
    anything built on it that reads all its rows), so no second scan is needed.  ``report()``
    then gives the rows of ``expectations``; called before an action it waits for one.  The
    frame may also be the input of several actions: the first one is reported.
    """
    seen = Observation()
    aggs = [F.count_if(~F.coalesce(cond, F.lit(False))).alias(name) for name, cond in checks.items()]

    def report() -> DataFrame:
        rows = [(name, seen.get[name] == 0, seen.get[name]) for name in checks]
        return df.sparkSession.createDataFrame(rows, "name string, passed boolean, observed bigint")

    return df.observe(seen, *aggs), report


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """P10: row-count expectation ``(name, passed, observed)``."""
    return df.agg(F.count(F.lit(1)).alias("observed")).select(
        F.lit("rows").alias("name"), (F.col("observed") == n).alias("passed"), F.col("observed").cast("bigint").alias("observed"))


def assert_expectations(result: DataFrame) -> None:
    """Raise when any expectation failed (one small collect of the check table)."""
    failed = [r for r in result.collect() if not r["passed"]]
    if failed:
        raise AssertionError("expectations failed: " + ", ".join(f"{r['name']}={r['observed']}" for r in failed))
