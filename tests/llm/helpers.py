"""Rows that every operator must bear, and plain versions of what the operators define."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 4999}" for i in range(60_000))
ODD = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "same id, other text"), (2, ""), (3, None), (4, " \t\n\r\x0b\x0c"),
       (None, "no id at all here"), (None, None), (5, "x"), (6, LONG), (7, "é ü   日本語 \x1c . !"),
       (8, "<|endoftext|> and <|startoftext|>"), (9, "a b c d e f g h"), (-20, "negative id")]


def odd_docs(spark, clash=()):
    """ODD with an empty row's worth of extra columns, some named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("score", "rank", "k1", "k2", "node", "path", "held_out", *clash)})


def words(text):
    return WORD.findall(text or "")


def rows_of(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
