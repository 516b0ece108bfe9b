"""Registered queries: dates, radiology linkage (G4) and its joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinloom.functions.dates import iso, study_timestamp, to_day
from clinloom.operators import aggregates as A
from clinloom.operators import joins as J
from clinloom.operators.dedupe import dedupe_studies
from clinloom.plans import radiology as R
from clinloom.catalog import V, register

_TS_SQL = """make_timestamp(CAST(substr(study_date, 1, 4) AS BIGINT), CAST(substr(study_date, 5, 2) AS BIGINT),
    CAST(substr(study_date, 7, 2) AS BIGINT), CAST(substr(study_time, 1, 2) AS BIGINT),
    CAST(substr(study_time, 3, 2) AS BIGINT), CAST(substr(study_time, 5) AS DOUBLE))"""
_ISO = "'%Y-%m-%d %H:%M:%S.%f'"


@register("d1_study_timestamp", f"SELECT dicom, strftime({_TS_SQL}, {_ISO}) AS study_date_time FROM v_metadata")
def d1(spark, sf):
    m = V(spark, sf, "v_metadata")
    return m.select("dicom", iso(study_timestamp(F.col("study_date"), F.col("study_time"))).alias("study_date_time"))


@register("d2_to_day", f"SELECT dicom, strftime(CAST({_TS_SQL} AS DATE), '%Y-%m-%d') AS day FROM v_metadata")
def d2(spark, sf):
    m = V(spark, sf, "v_metadata")
    day = to_day(study_timestamp(F.col("study_date"), F.col("study_time")))
    return m.select("dicom", F.date_format(day, "yyyy-MM-dd").alias("day"))


# The title of each diagnosis row, looked up by code (safe mode: by code and version)
_DESCRIBED = """SELECT c.subject_id, c.hadm_id, c.seq_num::BIGINT AS seq_num, c.icd_code,
       c.icd_version::BIGINT AS icd_version, t.long_title
FROM v_dx AS c, v_d_icd AS t WHERE t.icd_code = c.icd_code"""


def _described_out(df):
    return df.select("subject_id", "hadm_id", F.col("seq_num").cast("bigint").alias("seq_num"), "icd_code",
                     F.col("icd_version").cast("bigint").alias("icd_version"), "long_title")


@register("j7_describe_codes", _DESCRIBED)
def j7(spark, sf):
    return _described_out(J.describe_codes(V(spark, sf, "v_dx"), V(spark, sf, "v_d_icd")))


@register("j7_describe_codes_safe", _DESCRIBED + " AND t.icd_version = c.icd_version")
def j7s(spark, sf):
    return _described_out(J.describe_codes(V(spark, sf, "v_dx"), V(spark, sf, "v_d_icd"), safe=True))


_STUDIES = """SELECT r.subject_id, r.study_id, r.dicom_id, m.study_date, m.study_time, s.path AS text_path
FROM v_records r JOIN v_metadata m ON r.dicom_id = m.dicom JOIN v_studies s ON r.study_id = s.study_id"""


@register("j8_assemble_studies", _STUDIES)
def j8(spark, sf):
    return J.assemble_studies(V(spark, sf, "v_records"), V(spark, sf, "v_metadata"), V(spark, sf, "v_studies"))


_LINKED_CTE = f"""WITH st AS ({_STUDIES}),
sd AS (SELECT *, CAST({_TS_SQL} AS DATE) AS day FROM st),
o AS (SELECT subject_id, hadm_id, ordertime, CAST(ordertime AS DATE) AS day FROM v_poe WHERE order_subtype = 'General Xray'),
lk AS (SELECT o.subject_id, o.hadm_id, o.ordertime, o.day, sd.study_id, sd.dicom_id, sd.text_path
       FROM o JOIN sd ON o.subject_id = sd.subject_id AND o.day = sd.day),
pdx AS (SELECT * FROM ({_DESCRIBED}) WHERE seq_num = 1 AND icd_version = 10),
x AS (SELECT lk.subject_id, lk.hadm_id, lk.study_id, lk.text_path, pdx.seq_num, pdx.icd_code, pdx.icd_version, pdx.long_title
      FROM lk JOIN pdx ON lk.subject_id = pdx.subject_id AND lk.hadm_id = pdx.hadm_id),
xt AS (SELECT x.*, rp.text AS study_text FROM x JOIN v_reports rp ON x.text_path = rp.path),
g4 AS (SELECT text_path, arg_min(subject_id, (hadm_id, study_id, icd_code, long_title)) AS subject_id,
              min((hadm_id, study_id, icd_code, long_title)) AS k,
              arg_min(seq_num, (hadm_id, study_id, icd_code, long_title)) AS seq_num,
              arg_min(icd_version, (hadm_id, study_id, icd_code, long_title)) AS icd_version,
              arg_min(study_text, (hadm_id, study_id, icd_code, long_title)) AS study_text
       FROM xt GROUP BY text_path)
"""


@register("j9_link_same_day", _LINKED_CTE + f"""
SELECT subject_id, hadm_id, study_id, dicom_id, strftime(ordertime, {_ISO}) AS ordertime, strftime(day, '%Y-%m-%d') AS day FROM lk""")
def j9(spark, sf):
    lk = R.linked_orders(V(spark, sf, "v_poe"), V(spark, sf, "v_records"), V(spark, sf, "v_metadata"),
                         V(spark, sf, "v_studies"))
    return lk.select("subject_id", "hadm_id", "study_id", "dicom_id", iso(F.col("ordertime")).alias("ordertime"),
                     F.date_format("day", "yyyy-MM-dd").alias("day"))


def _x(spark, sf):
    lk = R.linked_orders(V(spark, sf, "v_poe"), V(spark, sf, "v_records"), V(spark, sf, "v_metadata"),
                         V(spark, sf, "v_studies")).select("subject_id", "hadm_id", "study_id", "text_path")
    return J.attach_primary_dx(lk, R.primary_dx(V(spark, sf, "v_dx"), V(spark, sf, "v_d_icd")))


def _x_out():
    return ["subject_id", "hadm_id", "study_id", "text_path", F.col("seq_num").cast("bigint").alias("seq_num"),
            "icd_code", F.col("icd_version").cast("bigint").alias("icd_version"), "long_title"]


@register("j10_attach_primary_dx", _LINKED_CTE + "SELECT * FROM x")
def j10(spark, sf):
    return _x(spark, sf).select(*_x_out())


@register("j11_attach_report_text", _LINKED_CTE + "SELECT * FROM xt")
def j11(spark, sf):
    return J.attach_report_text(_x(spark, sf), V(spark, sf, "v_reports")).select(*_x_out(), "study_text")


# every linked study also refers to an addendum beside its report; the reports hold none of these
_ADDENDA_SQL = """SELECT text_path FROM x UNION ALL SELECT regexp_replace(text_path, '[.]txt$', '') || '_addendum.txt' FROM x"""


@register("j11_unmatched_paths", _LINKED_CTE + f"""SELECT text_path FROM ({_ADDENDA_SQL}) WHERE text_path NOT IN (SELECT path FROM v_reports)""")
def j11u(spark, sf):
    """Paths without a report, where each linked study also refers to an addendum; all reports are read."""
    x = _x(spark, sf).select("text_path")
    addenda = x.select(F.concat(F.regexp_replace("text_path", "[.]txt$", ""), F.lit("_addendum.txt")).alias("text_path"))
    return J.unmatched_paths(x.unionByName(addenda), V(spark, sf, "v_reports"))


_G4_SELECT = """SELECT subject_id, k[1] AS hadm_id, k[2] AS study_id, text_path, seq_num, k[3] AS icd_code,
       icd_version, k[4] AS long_title, study_text FROM g4"""


LINKED_G4_SQL = _LINKED_CTE + _G4_SELECT


def g4_columns(out):
    return out.select(*_x_out(), "study_text")


def g4_query(spark, sf):
    out = R.link_radiology(V(spark, sf, "v_dx"), V(spark, sf, "v_d_icd"), V(spark, sf, "v_records"),
                           V(spark, sf, "v_metadata"), V(spark, sf, "v_studies"), V(spark, sf, "v_poe"),
                           V(spark, sf, "v_reports"))
    return g4_columns(out)



@register("w2_dedupe_studies", _LINKED_CTE + f"""
SELECT text_path, subject_id, hadm_id, study_id, dicom_id, strftime(ordertime, {_ISO}) AS ordertime
FROM (SELECT *, row_number() OVER (PARTITION BY text_path ORDER BY ordertime, hadm_id, dicom_id) AS r FROM lk) WHERE r = 1""")
def w2(spark, sf):
    """W2 in its own order (ordertime, hadm_id, dicom_id) over every linked order and image."""
    lk = R.linked_orders(V(spark, sf, "v_poe"), V(spark, sf, "v_records"), V(spark, sf, "v_metadata"),
                         V(spark, sf, "v_studies"))
    lk = lk.select("text_path", "subject_id", "hadm_id", "study_id", "dicom_id", "ordertime")
    return dedupe_studies(lk).withColumn("ordertime", iso(F.col("ordertime")))


register("g4_link_radiology", LINKED_G4_SQL)(g4_query)


@register("a6_label_density", _LINKED_CTE + """
SELECT k[3] AS icd_code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS density FROM g4 GROUP BY k[3]""")
def a6(spark, sf):
    d = R.code_density(g4_query(spark, sf))
    return d.select("icd_code", "n", F.round("density", 6).alias("density"))


@register("j12_translate_codes", """
WITH m AS (SELECT DISTINCT icd9_code AS icd9, 'X' || substr(icd9_code, 2) AS icd10 FROM v_diag WHERE substr(icd9_code, -1) IN ('0', '2', '4', '6', '8'))
SELECT d.hadm_id, CAST(d.seq_num AS BIGINT) AS seq_num, d.icd9_code, m.icd10 FROM v_diag d LEFT JOIN m ON d.icd9_code = m.icd9""")
def j12(spark, sf):
    # The crosswalk fixture covers codes with an even last digit, so that the left join
    # also shows codes without a mapping; every diagnosis row is joined.
    diag = V(spark, sf, "v_diag")
    mapping = (diag.where(F.substring("icd9_code", -1, 1).isin("0", "2", "4", "6", "8")).select(F.col("icd9_code").alias("icd9")).distinct()
                   .withColumn("icd10", F.concat(F.lit("X"), F.substring("icd9", 2, 100))))
    out = J.translate_codes(diag, mapping)
    return out.select("hadm_id", F.col("seq_num").cast("bigint").alias("seq_num"), "icd9_code", "icd10")


@register("a8_row_counts", "SELECT category, count(*) AS n FROM v_notes GROUP BY category")
def a8(spark, sf):
    return A.row_counts(V(spark, sf, "v_notes"), ["category"])


@register("f1_row_expressions", f"""
SELECT dicom, strftime({_TS_SQL}, {_ISO}) AS study_date_time, strftime(CAST({_TS_SQL} AS DATE), '%Y-%m-%d') AS date_object
FROM v_metadata""")
def f1(spark, sf):
    """the per-row ``apply`` helpers (timestamp from DICOM strings, its day) as expressions."""
    m = V(spark, sf, "v_metadata")
    ts = study_timestamp(F.col("study_date"), F.col("study_time"))
    return m.select("dicom", iso(ts).alias("study_date_time"), F.date_format(to_day(ts), "yyyy-MM-dd").alias("date_object"))
