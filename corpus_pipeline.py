"""Training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame; between stages the rows are written as Parquet in the shared folder and read
again, so a lost executor never reaches back beyond the stage at hand.

1. ``toxicity``        documents predicted toxic go (operator 6);
2. ``near_duplicates`` one document of each class of near copies stays (operator 10);
3. ``repeated_spans``  repeated 35-word windows are cut from the texts (operator 7);
4. ``decontamination`` documents that hold a benchmark passage go (operator 8);
5. ``packing``         what is left is packed into sequences (operator 2).

All but the last return the columns of ``documents``; the last returns the packing.  The
learned first stage cannot be put into SQL, so there is no ``ORACLE_SQL``; the tests hold
``run`` against the brute-force versions of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinloom.llm import (
    op2_best_fit_packing,
    op6_toxicity_mil,
    op7_substring_dedup,
    op8_spaced_seeds,
    op10_jaccard_join,
)
from clinloom.llm.shared import materialise

STAGES = [
    ("toxicity", op6_toxicity_mil.stage),
    ("near_duplicates", op10_jaccard_join.stage),
    ("repeated_spans", op7_substring_dedup.stage),
    ("decontamination", op8_spaced_seeds.stage),
    ("packing", op2_best_fit_packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
