"""G1 and its parts on hand-written notes and codes."""

from pyspark.sql import functions as F

from clinloom.operators import aggregates as A
from clinloom.operators import dedupe as W
from clinloom.plans.icd_dataset import IcdParams, icd_dataset, icd_labelled

NOTES = [
    (1, 10, "Discharge summary", "same text"),
    (2, 11, "Discharge summary", "same text"),        # duplicate of row 1 in another admission: dropped
    (3, 10, "Discharge summary ", "second note"),     # trailing space category still matches
    (4, None, "Discharge summary", "no admission"),   # null admission dropped
    (5, 12, "Discharge summary", None),               # null text dropped
    (6, 12, "Radiology", "other category"),
    (7, 13, "Discharge summary", "admission without procedure"),
]
DIAG = [(10, 1, "00123"), (10, 2, "99999"), (11, 1, "00456"), (13, 1, "00789"), (12, 1, "00001")]
PROC = [(10, 1, "0042"), (11, 1, "0043"), (12, 1, "0044")]


def frames(spark):
    n = spark.createDataFrame(NOTES, "row_id long, hadm_id long, category string, text string")
    d = spark.createDataFrame(DIAG, "hadm_id long, seq_num int, icd9_code string")
    p = spark.createDataFrame(PROC, "hadm_id long, seq_num int, icd9_code string")
    return n, d, p


def test_labelled_admissions(spark):
    n, d, p = frames(spark)
    rows = {r["hadm_id"]: r for r in icd_labelled(n, d, p, cleaned=True).collect()}
    assert set(rows) == {10}                     # 11 lost its only text, 12 has no discharge text, 13 no procedure
    assert rows[10]["text"] == "same text second note"
    assert rows[10]["category"] == "Discharge summary Discharge summary"
    assert rows[10]["icd9_code"] == "00123"      # leading zeros kept, primary code only


def test_all_codes_and_proc_target(spark):
    n, d, p = frames(spark)
    out = icd_labelled(n, d, p, IcdParams(one_or_all_icds="all", diag_or_proc="diag"), cleaned=True).collect()
    assert out[0]["icd9_code"] == "00123,99999"
    out = icd_labelled(n, d, p, IcdParams(diag_or_proc="proc"), cleaned=True).collect()
    assert out[0]["icd9_code"] == "0042"


def test_keep_first_is_by_row_id(spark):
    df = spark.createDataFrame([(5, 1, "x"), (2, 2, "x"), (9, 3, "y")], "row_id long, hadm_id long, text string")
    got = sorted(tuple(r) for r in W.dedupe_text(df).collect())
    assert got == [(2, 2, "x"), (9, 3, "y")]


def test_pivot_codes_pads_with_null(spark):
    d = spark.createDataFrame(DIAG, "hadm_id long, seq_num int, icd9_code string")
    wide = {r["hadm_id"]: r for r in A.pivot_codes(A.codes_by_admission(d), "DIAG_CODE").collect()}
    assert (wide[10]["DIAG_CODE1"], wide[10]["DIAG_CODE2"]) == ("00123", "99999")
    assert wide[11]["DIAG_CODE2"] is None


def test_icd_dataset_split_sizes_on_fixture(spark):
    from clinloom.sources.fixtures import view
    sf = "/root/testdata/sf0.01"
    out = icd_dataset(view(spark, sf, "v_notes"), view(spark, sf, "v_diag"), view(spark, sf, "v_proc"))
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    n = sum(counts.values())
    pool = round(n * 0.8)
    assert counts["test"] == n - pool and counts["validate"] == round(pool * 0.25)
    assert out.select("hadm_id").distinct().count() == n


def test_concat_and_codes_on_a_hot_admission(spark):
    rows = [(i, 1 if i % 3 else 2, None if i % 5 == 0 else f"t{i}") for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "row_id long, hadm_id long, text string").repartition(7)
    got = {r["hadm_id"]: (r["text"], r["n_notes"]) for r in A.concat_by_admission(df, category_value="c").collect()}
    for h in (1, 2):
        mine = [t for _, k, t in rows if k == h]
        assert got[h] == (" ".join(t for t in mine if t is not None), len(mine))
    codes = spark.createDataFrame([(1, 1, "A,B"), (1, 1, "C"), (1, 1, "A"), (1, 0, None)],
                                  "hadm_id long, seq_num int, icd9_code string")
    row = A.codes_by_admission(codes).first()
    assert row["code_list"] == ["A", "A,B", "C"] and row["codes"] == "A,A,B,C"


def test_all_categories_mode(spark):
    n, d, p = frames(spark)
    rows = {r["hadm_id"]: r for r in icd_labelled(n, d, p, IcdParams(note_category="all"), cleaned=True).collect()}
    assert rows[12]["text"] == "other category"              # radiology note counts in 'all' mode
    assert rows[12]["category"] == "Radiology"
    assert rows[10]["category"] == "Discharge summary Discharge summary"


def test_params_validation():
    import pytest
    with pytest.raises(ValueError):
        IcdParams(note_category="Nonsense")
    with pytest.raises(ValueError):
        IcdParams(diag_or_proc="both")


def test_notes_per_admission_keeps_first_rows_only(spark):
    from clinloom.plans.icd_dataset import notes_per_admission
    rows = [(i, i % 4, "\tDischarge summary\n", f"note {i % 10}") for i in range(1, 41)]
    n = spark.createDataFrame(rows, "row_id long, hadm_id long, category string, text string").repartition(5)
    got = {r["hadm_id"]: (r["text"], r["category"]) for r in notes_per_admission(n, "Discharge summary").collect()}
    assert got == {h: (" ".join(f"note {i % 10}" for i in range(1, 11) if i % 4 == h),
                       " ".join("Discharge summary" for i in range(1, 11) if i % 4 == h)) for h in range(4)}


def test_icd10_code_column(spark):
    n, d, p = frames(spark)
    d, p = (c.withColumnRenamed("icd9_code", "icd10_code") for c in (d, p))
    out = icd_labelled(n, d, p, IcdParams(code_column="icd10_code"), cleaned=True)
    assert out.columns == ["hadm_id", "text", "category", "icd10_code"] and out.count() > 0
