"""Codes of admissions without notes go before they are numbered and sorted."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from clinloom.plans.icd_dataset import IcdParams, icd_labelled


def _tables(spark):
    notes = spark.createDataFrame(
        [(1, 1, "Discharge summary", "first"), (2, 1, "Discharge summary", "second"), (3, 2, "Discharge summary", "first"),
         (4, None, "Discharge summary", "lost"), (5, 3, "Radiology", "scan"), (6, 4, "Discharge summary", "fourth")],
        "row_id long, hadm_id long, category string, text string")
    raw = spark.createDataFrame([(h, n, f"{h}{n}") for h in [None, *range(1, 60)] for n in (2, 1)] + [(1, 3, None)],
                                "hadm_id long, line int, icd9_code string")
    seq = F.row_number().over(Window.partitionBy("hadm_id").orderBy("line"))
    return notes, raw.select("hadm_id", seq.alias("seq_num"), "icd9_code")


def test_rows_are_those_of_the_whole_code_tables(spark):
    notes, codes = _tables(spark)
    got = icd_labelled(notes, codes, codes.where("hadm_id <> 4"), IcdParams(one_or_all_icds="all"))
    assert sorted(map(tuple, got.collect())) == [(1, "first second", "Discharge summary Discharge summary", "11,12")]
    one = icd_labelled(notes, codes, codes, IcdParams(one_or_all_icds=2, require_both=False))
    assert sorted((r["hadm_id"], r["icd9_code"]) for r in one.collect()) == [(1, "12"), (4, "42")]


def test_the_semi_join_is_below_the_numbering(spark):
    notes, codes = _tables(spark)
    plan = icd_labelled(notes, codes, codes, IcdParams(one_or_all_icds="all"))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = [re.search(r"[A-Z]", x).start() for x in lines]
    windows = [i for i, x in enumerate(lines) if re.search(r"[-:+ ]Window \[row_number", x)]
    assert windows
    for i in windows:
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert any("LeftSemi" in x for x in lines[i + 1:end])
