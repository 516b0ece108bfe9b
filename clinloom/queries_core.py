"""Registered queries: text cleaning, filters, the ICD dataset (G1) and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinloom.functions import text as T
from clinloom.operators import aggregates as A
from clinloom.operators import dedupe as W
from clinloom.operators import filters as P
from clinloom.operators import joins as J
from clinloom.operators.ranking import global_rank
from clinloom.plans.icd_dataset import IcdParams, clean_notes, icd_dataset, icd_labelled, notes_per_admission
from clinloom.catalog import CLEAN_ICD_SQL, CLEAN_MLM_SQL, V, register

# --------------------------------------------------------------------------- text (T)


def _text_query(fn):
    def q(spark, sf):
        n = V(spark, sf, "v_notes")
        return n.select("row_id", fn(F.col("text")).alias("text"))
    return q


def _phrases_sql(expr: str, phrases) -> str:
    for p in phrases:
        if T.is_literal(p):
            expr = f"replace({expr}, {T.sql_literal(p)}, '')"
        else:
            expr = f"regexp_replace({expr}, {T.sql_literal(p)}, '', 'g')"
    return expr


def _subst_sql(expr: str) -> str:
    for pat, rep in T.SUBSTITUTIONS:
        expr = f"replace({expr}, {T.sql_literal(pat)}, {T.sql_literal(rep)})"
    return expr


register("t1_strip_deid", r"SELECT row_id, regexp_replace(text, '\[.*?\]', '', 'g') AS text FROM v_notes")(
    _text_query(T.strip_deid))
register("t2_strip_phrases", f"SELECT row_id, {_phrases_sql('text', T.ADMIN_PHRASES_ICD)} AS text FROM v_notes")(
    _text_query(T.strip_phrases))
register("t3_substitute", f"SELECT row_id, {_subst_sql('text')} AS text FROM v_notes")(_text_query(T.substitute))
register("t4_strip_digits", "SELECT row_id, regexp_replace(text, '[0-9]+', '', 'g') AS text FROM v_notes")(
    _text_query(T.strip_digits))
register("t5_collapse_ws", r"SELECT row_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM v_notes")(
    _text_query(T.collapse_ws))
register("t6_trim", r"SELECT row_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM v_notes")(
    _text_query(lambda c: T.trim_text(T.collapse_ws(c))))
register("t7_strip_marks", "SELECT row_id, replace(replace(text, '\"', ''), ':', '') AS text FROM v_notes")(
    _text_query(T.strip_marks))
register("t8_clean_notes_icd", f"SELECT row_id, {CLEAN_ICD_SQL} AS text FROM v_notes")(
    _text_query(lambda c: T.clean_text(c, "icd")))
register("t8_clean_notes_mlm", f"SELECT row_id, {CLEAN_MLM_SQL} AS text FROM v_notes")(
    _text_query(lambda c: T.clean_text(c, "mlm")))
register("t9_append_newline", "SELECT row_id, text || chr(10) AS text FROM v_notes")(_text_query(T.append_newline))
register("t11_clean_lower",
         f"SELECT row_id, {T.duckdb_clean_sql('lower(text)', 'icd')} AS text FROM v_notes")(
    _text_query(lambda c: T.clean_text(c, "icd", lower=True)))


@register("t10_pair_text", "SELECT pair_id, sentence1 || sentence2 AS text FROM v_pairs")
def t10(spark, sf):
    p = V(spark, sf, "v_pairs")
    return p.select("pair_id", T.pair_text(F.col("sentence1"), F.col("sentence2")).alias("text"))


@register("t12_trim_category", "SELECT row_id, trim(category) AS category FROM v_notes")
def t12(spark, sf):
    return V(spark, sf, "v_notes").select("row_id", T.trim_category(F.col("category")).alias("category"))


@register("t13_prefix_path", "SELECT concat('/content/', path) AS path FROM v_reports")
def t13(spark, sf):
    return V(spark, sf, "v_reports").select(T.prefix_path("/content/", F.col("path")).alias("path"))


# --------------------------------------------------------------------------- filters (P)


@register("p1_select_rename", "SELECT row_id, hadm_id AS admission, text AS note_text FROM v_notes")
def p1(spark, sf):
    return P.select_renamed(V(spark, sf, "v_notes"), ["row_id", "hadm_id", "text"],
                            {"hadm_id": "admission", "text": "note_text"})


@register("p2_cast_string",
          "SELECT CAST(hadm_id AS VARCHAR) AS hadm_id, CAST(seq_num AS VARCHAR) AS seq_num, icd9_code FROM v_diag")
def p2(spark, sf):
    return P.cast_to_string(V(spark, sf, "v_diag"), ["hadm_id", "seq_num"])


@register("p3_drop_missing", "SELECT row_id, hadm_id FROM v_notes WHERE hadm_id IS NOT NULL AND text IS NOT NULL")
def p3(spark, sf):
    return P.drop_missing(V(spark, sf, "v_notes"), ["hadm_id", "text"]).select("row_id", "hadm_id")


@register("p4_filter_category", "SELECT row_id, category FROM v_notes WHERE trim(category) = 'Physician'")
def p4(spark, sf):
    return P.filter_category(V(spark, sf, "v_notes"), "Physician").select("row_id", "category")


@register("p5_filter_seq", "SELECT hadm_id, icd9_code FROM v_diag WHERE seq_num = 1")
def p5(spark, sf):
    return P.filter_seq(V(spark, sf, "v_diag"), 1).select("hadm_id", "icd9_code")


@register("p6_filter_in", """
SELECT pair_id, gold_label FROM v_pairs
WHERE gold_label IN (SELECT gold_label FROM v_pairs WHERE split = 'train' AND gold_label <> 'neutral')""")
def p6(spark, sf):
    pairs = V(spark, sf, "v_pairs")
    allowed = pairs.where((F.col("split") == "train") & (F.col("gold_label") != "neutral")).select("gold_label")
    return P.filter_in(pairs, "gold_label", allowed).select("pair_id", "gold_label")


@register("p7_where_all", """
SELECT subject_id, hadm_id, CAST(seq_num AS BIGINT) AS seq_num, icd_code, CAST(icd_version AS BIGINT) AS icd_version
FROM v_dx WHERE seq_num = 1 AND icd_version = 10""")
def p7(spark, sf):
    dx = V(spark, sf, "v_dx")
    return P.where_all(dx, F.col("seq_num") == 1, F.col("icd_version") == 10).select(
        "subject_id", "hadm_id", F.col("seq_num").cast("bigint").alias("seq_num"), "icd_code",
        F.col("icd_version").cast("bigint").alias("icd_version"))


@register("p8_filter_orders", """
SELECT subject_id, hadm_id, strftime(ordertime, '%Y-%m-%d %H:%M:%S.%f') AS ordertime
FROM v_poe WHERE order_subtype = 'General Xray'""")
def p8(spark, sf):
    poe = V(spark, sf, "v_poe")
    return P.where_all(poe, F.col("order_subtype") == "General Xray").select(
        "subject_id", "hadm_id", F.date_format("ordertime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ordertime"))


@register("p9_drop_unsure", """
SELECT row_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM v_ann WHERE unsure = 0""")
def p9(spark, sf):
    out = P.drop_unsure(V(spark, sf, "v_ann"))
    return out.select("row_id", F.col("quality").cast("bigint").alias("quality"),
                      F.col("toxic").cast("bigint").alias("toxic"))


@register("p10_expectations", """
SELECT 'has_admission' AS name, count_if(hadm_id IS NULL) = 0 AS passed, CAST(count_if(hadm_id IS NULL) AS BIGINT) AS observed FROM v_notes
UNION ALL
SELECT 'has_text', count_if(NOT coalesce(length(text) > 0, false)) = 0, CAST(count_if(NOT coalesce(length(text) > 0, false)) AS BIGINT) FROM v_notes
UNION ALL
SELECT 'known_category', count_if(NOT coalesce(trim(category) IN ('Discharge summary', 'Physician', 'Radiology'), false)) = 0,
       CAST(count_if(NOT coalesce(trim(category) IN ('Discharge summary', 'Physician', 'Radiology'), false)) AS BIGINT) FROM v_notes""")
def p10(spark, sf):
    n = V(spark, sf, "v_notes")
    return P.expectations(n, {
        "has_admission": F.col("hadm_id").isNotNull(),
        "has_text": F.length("text") > 0,
        "known_category": F.trim("category").isin("Discharge summary", "Physician", "Radiology"),
    })


@register("p11_corpus_lines", r"""
SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE length(line) > 10 AND trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''""")
def p11(spark, sf):
    from clinloom.catalog import tbl
    docs = tbl(spark, sf, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return P.corpus_lines(lines, "line")


# --------------------------------------------------------------------------- G1 pieces

_CLEANED_SQL = f"""cleaned AS (SELECT row_id, hadm_id, category, {CLEAN_ICD_SQL} AS text FROM v_notes)"""
_FILTERED_SQL = """filt AS (SELECT row_id, hadm_id, trim(category) AS category, text FROM cleaned
                 WHERE hadm_id IS NOT NULL AND text IS NOT NULL AND trim(category) = 'Discharge summary')"""
_DEDUP_SQL = """dedup AS (SELECT text, min(row_id) AS row_id, arg_min(hadm_id, row_id) AS hadm_id,
                 arg_min(category, row_id) AS category FROM filt GROUP BY text)"""
_PER_ADM_SQL = """per_adm AS (SELECT hadm_id, string_agg(text, ' ' ORDER BY row_id) AS text,
                 string_agg(category, ' ' ORDER BY row_id) AS category FROM dedup GROUP BY hadm_id)"""
_CODES_SQL = """dc AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes
                 FROM v_diag WHERE seq_num = 1 AND icd9_code IS NOT NULL GROUP BY hadm_id),
pc AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes
                 FROM v_proc WHERE seq_num = 1 AND icd9_code IS NOT NULL GROUP BY hadm_id)"""
_LABELLED_SQL = """lab AS (SELECT n.hadm_id, n.text, n.category, dc.codes AS icd9_code
                 FROM per_adm n JOIN dc ON n.hadm_id = dc.hadm_id JOIN pc ON n.hadm_id = pc.hadm_id)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@register("w1_dedupe_text", _with(_CLEANED_SQL, _FILTERED_SQL, _DEDUP_SQL) + "SELECT row_id, hadm_id, text FROM dedup")
def w1(spark, sf):
    n = P.filter_category(P.drop_missing(V(spark, sf, "v_notes"), ["hadm_id", "text"]), "Discharge summary")
    n = clean_notes(n.select("row_id", "hadm_id", "text"))
    return W.dedupe_text(n).select("row_id", "hadm_id", "text")


@register("a1_concat_by_admission", _with(_CLEANED_SQL, _FILTERED_SQL, _DEDUP_SQL, _PER_ADM_SQL)
          + "SELECT hadm_id, text, category FROM per_adm")
def a1(spark, sf):
    return notes_per_admission(V(spark, sf, "v_notes"), "Discharge summary", cleaned=False)


@register("a2_codes_by_admission", """
SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes, CAST(count(*) AS BIGINT) AS n_codes
FROM v_diag WHERE icd9_code IS NOT NULL GROUP BY hadm_id""")
def a2(spark, sf):
    c = A.codes_by_admission(V(spark, sf, "v_diag"))
    return c.select("hadm_id", "codes", F.size("code_list").cast("bigint").alias("n_codes"))


@register("a3_pivot_codes", """
WITH c AS (SELECT hadm_id, list(icd9_code ORDER BY seq_num, icd9_code) AS l FROM v_proc GROUP BY hadm_id)
SELECT hadm_id, l[1] AS PRCD_CODE1, l[2] AS PRCD_CODE2, l[3] AS PRCD_CODE3, l[4] AS PRCD_CODE4,
       l[5] AS PRCD_CODE5, l[6] AS PRCD_CODE6, l[7] AS PRCD_CODE7 FROM c""")
def a3(spark, sf):
    c = A.codes_by_admission(V(spark, sf, "v_proc"))
    return A.pivot_codes(c, "PRCD_CODE", 7)


@register("j1_combine_codes", """
WITH d AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS diag_codes FROM v_diag GROUP BY hadm_id),
p AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS proc_codes FROM v_proc GROUP BY hadm_id)
SELECT d.hadm_id, diag_codes, proc_codes FROM d JOIN p ON d.hadm_id = p.hadm_id""")
def j1(spark, sf):
    d = A.codes_by_admission(V(spark, sf, "v_diag")).select("hadm_id", F.col("codes").alias("diag_codes"))
    p = A.codes_by_admission(V(spark, sf, "v_proc")).select("hadm_id", F.col("codes").alias("proc_codes"))
    return J.combine_codes(d, p)


@register("j1_combine_codes_outer", """
WITH d AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS diag_codes FROM v_diag GROUP BY hadm_id),
p AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS proc_codes FROM v_proc GROUP BY hadm_id)
SELECT coalesce(d.hadm_id, p.hadm_id) AS hadm_id, diag_codes, proc_codes FROM d FULL OUTER JOIN p ON d.hadm_id = p.hadm_id""")
def j1o(spark, sf):
    d = A.codes_by_admission(V(spark, sf, "v_diag")).select("hadm_id", F.col("codes").alias("diag_codes"))
    p = A.codes_by_admission(V(spark, sf, "v_proc")).select("hadm_id", F.col("codes").alias("proc_codes"))
    return J.combine_codes(d, p, strict=False)


@register("j3_labelled_admissions", _with(_CLEANED_SQL, _FILTERED_SQL, _DEDUP_SQL, _PER_ADM_SQL, _CODES_SQL, _LABELLED_SQL)
          + "SELECT hadm_id, text, category, icd9_code FROM lab")
def j3(spark, sf):
    return icd_labelled(V(spark, sf, "v_notes"), V(spark, sf, "v_diag"), V(spark, sf, "v_proc"))


@register("j3_labelled_admissions_proc", _with(_CLEANED_SQL, _FILTERED_SQL, _DEDUP_SQL, _PER_ADM_SQL, _CODES_SQL)
          + """SELECT n.hadm_id, n.text, n.category, pc.codes AS icd9_code
               FROM per_adm n JOIN dc ON n.hadm_id = dc.hadm_id JOIN pc ON n.hadm_id = pc.hadm_id""")
def j3p(spark, sf):
    return icd_labelled(V(spark, sf, "v_notes"), V(spark, sf, "v_diag"), V(spark, sf, "v_proc"),
                        IcdParams(diag_or_proc="proc"))


_SPLIT_SQL = """r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(hadm_id AS VARCHAR)), hadm_id) - 1 AS rk,
                  count(*) OVER () AS n FROM lab),
s AS (SELECT *, CAST(round_even(CAST(n AS DOUBLE) * 0.8, 0) AS BIGINT) AS pool FROM r)"""

G1_SQL = (_with(_CLEANED_SQL, _FILTERED_SQL, _DEDUP_SQL, _PER_ADM_SQL, _CODES_SQL, _LABELLED_SQL, _SPLIT_SQL)
          + """SELECT hadm_id, text, category, icd9_code,
       CASE WHEN rk < CAST(round_even(CAST(pool AS DOUBLE) * 0.25, 0) AS BIGINT) THEN 'validate'
            WHEN rk < pool THEN 'train' ELSE 'test' END AS split
FROM s""")


def g1_query(spark, sf):
    return icd_dataset(V(spark, sf, "v_notes"), V(spark, sf, "v_diag"), V(spark, sf, "v_proc"))


register("g1_icd_dataset", G1_SQL)(g1_query)


@register("j2_attach_codes", _with(_CLEANED_SQL, _FILTERED_SQL, _DEDUP_SQL, _PER_ADM_SQL, _CODES_SQL)
          + "SELECT n.hadm_id, n.text, dc.codes AS icd9_code FROM per_adm n JOIN dc ON n.hadm_id = dc.hadm_id")
def j2(spark, sf):
    per_adm = notes_per_admission(V(spark, sf, "v_notes"), "Discharge summary", cleaned=False)
    codes = A.codes_by_admission(P.filter_seq(V(spark, sf, "v_diag"), 1)).select("hadm_id", F.col("codes").alias("icd9_code"))
    return J.attach_codes(per_adm.select("hadm_id", "text"), codes)


@register("w4_code_positions", """
SELECT hadm_id, icd9_code, row_number() OVER (PARTITION BY hadm_id ORDER BY seq_num, icd9_code) AS position FROM v_proc""")
def w4(spark, sf):
    out = A.code_positions(V(spark, sf, "v_proc"))
    return out.select("hadm_id", "icd9_code", F.col("position").cast("bigint").alias("position"))


@register("f4_join_non_null", """
SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes FROM v_proc
WHERE icd9_code IS NOT NULL GROUP BY hadm_id""")
def f4(spark, sf):
    """F4 over every code column of the wide table (as many as the longest list needs)."""
    wide = A.pivot_codes(A.codes_by_admission(V(spark, sf, "v_proc")), "PRCD_CODE")
    return wide.select("hadm_id", A.join_non_null([c for c in wide.columns if c != "hadm_id"]).alias("codes"))


@register("l1_order_by", """
SELECT hadm_id, seq_num, icd9_code, row_number() OVER (ORDER BY hadm_id, seq_num, icd9_code) - 1 AS position FROM v_diag""")
def l1(spark, sf):
    """L1: ORDER BY as a range-partitioned sort (no single-task ordering), with each row's place in it."""
    d = V(spark, sf, "v_diag").select("hadm_id", "seq_num", "icd9_code")
    return global_rank(d, ["hadm_id", "seq_num", "icd9_code"], rank_col="position")


# One admission that holds a third of all rows, with null texts, commas in codes and equal
# sequence numbers.
_HOT_NOTES = """hn AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 1 ELSE hadm_id END AS hadm_id,
    CASE WHEN row_id % 7 = 0 THEN NULL ELSE text END AS text FROM v_notes)"""
_HOT_CODES = """hc AS (SELECT CASE WHEN hadm_id % 3 = 0 THEN 1 ELSE hadm_id END AS hadm_id, CAST(seq_num % 5 AS INTEGER) AS seq_num,
    CASE WHEN hadm_id % 11 = 0 THEN NULL WHEN hadm_id % 7 = 0 THEN icd9_code || ',x' ELSE icd9_code END AS icd9_code FROM v_diag)"""


def _hot_notes(spark, sf):
    n = V(spark, sf, "v_notes")
    return n.select("row_id", F.when(F.col("row_id") % 3 == 0, F.lit(1)).otherwise(F.col("hadm_id")).alias("hadm_id"),
                    F.lit("c").alias("category"), F.when(F.col("row_id") % 7 != 0, F.col("text")).alias("text"))


def _hot_codes(spark, sf):
    d, h = V(spark, sf, "v_diag"), F.col("hadm_id")
    code = F.when(h % 11 == 0, None).when(h % 7 == 0, F.concat("icd9_code", F.lit(",x"))).otherwise(F.col("icd9_code"))
    return d.select(F.when(h % 3 == 0, F.lit(1)).otherwise(h).alias("hadm_id"),
                    (F.col("seq_num") % 5).cast("int").alias("seq_num"), code.alias("icd9_code"))


@register("a1_hot", f"""WITH {_HOT_NOTES}
SELECT hadm_id, coalesce(string_agg(text, ' ' ORDER BY row_id), '') AS text, count(*) AS n_notes
FROM hn WHERE hadm_id IS NOT NULL GROUP BY hadm_id""")
def a1_hot(spark, sf):
    """A1 with a hot admission and null texts (skipped, but counted)."""
    n = _hot_notes(spark, sf).where(F.col("hadm_id").isNotNull())
    return A.concat_by_admission(n).select("hadm_id", "text", "n_notes")


_A2_HOT = f"""WITH {_HOT_CODES}
SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes, count(*) AS n_codes
FROM hc WHERE icd9_code IS NOT NULL GROUP BY hadm_id"""


@register("a2_hot", _A2_HOT)
def a2_hot(spark, sf):
    """A2 with a hot admission, commas within codes, null codes and equal sequence numbers."""
    out = A.codes_by_admission(_hot_codes(spark, sf))
    return out.select("hadm_id", "codes", F.size("code_list").cast("bigint").alias("n_codes"))


_CODES_ALL_SQL = """dc AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes
                 FROM v_diag WHERE icd9_code IS NOT NULL GROUP BY hadm_id),
pc AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes
                 FROM v_proc WHERE icd9_code IS NOT NULL GROUP BY hadm_id)"""


@register("j3_labelled_admissions_all_codes", _with(_CLEANED_SQL, _FILTERED_SQL, _DEDUP_SQL, _PER_ADM_SQL,
                                                    _CODES_ALL_SQL, _LABELLED_SQL)
          + "SELECT hadm_id, text, category, icd9_code FROM lab")
def j3_all(spark, sf):
    """J3 with every code of an admission (one_or_all_icds='all')."""
    return icd_labelled(V(spark, sf, "v_notes"), V(spark, sf, "v_diag"), V(spark, sf, "v_proc"),
                        IcdParams(one_or_all_icds="all"))


@register("a1_concat_all_categories", f"""
WITH cleaned AS (SELECT row_id, hadm_id, trim(category) AS category, {CLEAN_ICD_SQL} AS text FROM v_notes
                 WHERE hadm_id IS NOT NULL AND text IS NOT NULL),
dedup AS (SELECT text, min(row_id) AS row_id, arg_min(hadm_id, row_id) AS hadm_id,
                 arg_min(category, row_id) AS category FROM cleaned GROUP BY text)
SELECT hadm_id, string_agg(text, ' ' ORDER BY row_id) AS text, string_agg(category, ' ' ORDER BY row_id) AS category
FROM dedup GROUP BY hadm_id""")
def a1_all(spark, sf):
    """A1 over every note category (category 'all'): categories joined in note order."""
    return notes_per_admission(V(spark, sf, "v_notes"), "all", cleaned=False)


@register("j3_all_codes_hot", _with(_CLEANED_SQL, _FILTERED_SQL, _DEDUP_SQL, _PER_ADM_SQL, _HOT_CODES)
          + """, dc AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes
                        FROM hc WHERE icd9_code IS NOT NULL GROUP BY hadm_id)
SELECT n.hadm_id, n.text, n.category, dc.codes AS icd9_code FROM per_adm n JOIN dc ON n.hadm_id = dc.hadm_id""")
def j3_all_hot(spark, sf):
    """J3 with every code, diagnoses only, over the skewed code table."""
    return icd_labelled(V(spark, sf, "v_notes"), _hot_codes(spark, sf), V(spark, sf, "v_proc"),
                        IcdParams(one_or_all_icds="all", require_both=False))


@register("g1_icd10",
          "SELECT hadm_id, text, category, icd9_code AS icd10_code, split FROM (" + G1_SQL + ")")
def g1_icd10(spark, sf):
    """G1 over ICD-10 code tables (same rows, code column ``icd10_code``)."""
    d, p = (V(spark, sf, v).withColumnRenamed("icd9_code", "icd10_code") for v in ("v_diag", "v_proc"))
    return icd_dataset(V(spark, sf, "v_notes"), d, p, IcdParams(code_column="icd10_code"))
