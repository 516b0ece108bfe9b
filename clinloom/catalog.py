"""Query catalog helpers: one registered query per operator of the inventory, each with a DuckDB oracle.

Every query reads the given tables through the fixture views (whole tables, whole
texts).  Output columns are aliased identically on both sides; integers are BIGINT,
floats are rounded to 6 digits, temporal values are rendered as ISO strings, and
arrays of numbers are rendered as comma strings so both engines hash them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinloom.functions import text as T
from clinloom.sources import fixtures as fx

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = fx.oracle(sql)
        return fn
    return deco


def V(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fx.view(spark, sf_dir, name)


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fx.table(spark, sf_dir, name)


CLEAN_ICD_SQL = T.duckdb_clean_sql("text", "icd")
CLEAN_MLM_SQL = T.duckdb_clean_sql("text", "mlm")
