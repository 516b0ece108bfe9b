"""Cleaning semantics on hand-written rows (the 2020 pandas rules)."""

import re

import pytest
from pyspark.sql import functions as F

from clinloom.functions import text as T


def clean(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def py_icd(text):
    """Reference semantics written with Python's re (regex for >1 char, literal for 1 char)."""
    if text is None:
        return None
    text = re.sub(r"\[.*?\]", "", text)
    for p in T.ADMIN_PHRASES_ICD:
        text = text.replace(p, "") if len(p) == 1 else re.sub(p, "", text)
    for a, b in T.SUBSTITUTIONS:
        text = text.replace(a, b) if len(a) == 1 else re.sub(a, b, text)
    text = re.sub(r"\d+", "", text)
    text = re.sub(r"\s+", " ", text)
    return text.strip()


CASES = [
    "Admission Date: [**2101-1-1**] ok",
    "bracket [**a\rb**] spans CR",          # Java '.' would stop at \r without (?d)
    "bracket [**a\nb**] spans LF",          # '.' stops at \n: not removed
    "Pt with XRAY VIII and amount",         # over-deletion is defined behaviour
    "JOB#: cc 123 and # Code and w/ x_y",
    "Lidocaine 5 %(700 mg/patch) Adhesive Patch stays",
    "Lidocaine 5 %700 mg/patch Adhesive Patch goes",
    "Dr. X M.D. Phone 555",                 # 'Phone' removed first, so ' M.D. Phone' cannot fire
    "nbsp here\x1cand\x1fthere em",
    "digits ١٢٣ arabic and 456",
    "PhIDone emerges",                      # deleting 'ID' creates 'Phone' after its pass
    "",
    None,
]


def test_icd_profile_matches_python_reference(spark):
    got = clean(spark, CASES, lambda c: T.clean_text(c, "icd"))
    assert got == [py_icd(c) for c in CASES]


def test_mlm_profile_keeps_leading_space_and_strips_marks(spark):
    got = clean(spark, ['FINAL REPORT "x": y'], lambda c: T.clean_text(c, "mlm"))
    assert got == ["FINAL REPORT x y"]


def test_single_char_rules_are_literal(spark):
    assert clean(spark, ["a)b.c"], lambda c: T.strip_phrases(c, [")", "."])) == ["abc"]


def test_deid_does_not_cross_newline(spark):
    assert clean(spark, ["a[x\ny]b", "a[x\ry]b"], T.strip_deid) == ["a[x\ny]b", "ab"]


def test_collapse_ws_python_set(spark):
    assert clean(spark, ["a \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 b"], T.collapse_ws) == ["a b"]


def test_lower_flag(spark):
    assert clean(spark, ["ID Abc"], lambda c: T.clean_text(c, "icd", lower=True)) == ["id abc"]


def test_pair_text_and_prefix(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert df.select(T.pair_text(F.col("x"), F.col("y"))).first()[0] == "ab"
    assert df.select(T.pair_text(F.col("x"), F.col("y"), " ")).first()[0] == "a b"
    assert df.select(T.prefix_path("/root/", F.col("x"))).first()[0] == "/root/a"


@pytest.mark.parametrize("line,keep", [("short", False), ("           ", False), ("a long enough line", True)])
def test_corpus_line(spark, line, keep):
    df = spark.createDataFrame([(line,)], "t string")
    assert df.where(T.is_corpus_line(F.col("t"))).count() == int(keep)


def test_word_boundary_extension(spark):
    got = clean(spark, ["XRAY X ray amount am"], lambda c: T.strip_phrases(c, [" X", " am"], word_boundary=True))
    assert got == ["XRAY  ray amount "]
    assert clean(spark, ["XRAY X ray"], lambda c: T.strip_phrases(c, [" X"])) == ["XRAY ray"]


def test_pattern_shortcut_helpers():
    assert T._group_only_literal("a(b)c") == "abc"
    assert T._group_only_literal("a(b)*c") is None and T._group_only_literal("(?:b)") is None
    assert T._group_only_literal("a.b") is None and T._group_only_literal("a(b") is None
