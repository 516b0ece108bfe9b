"""Link chest X-ray studies to same-day orders, primary diagnoses and report text.

  dx --J7 (dictionary, broadcast after size probe)--> P7 primary ICD-10
  records x metadata x studies (J8) --> study timestamp / day (D-1, D-2)
  orders (P8 'General Xray') --> day (D-2)
  orders x studies on (subject, day) (J9, many-to-many; AQE skew join)
  x primary dx on (subject, hadm) (J10) x report text on path (J11)
  --> one row per report path (W2, partial aggregate) --> code density (A6)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.dates import study_timestamp, to_day
from clinloom.operators.aggregates import label_density
from clinloom.operators.dedupe import dedupe_studies
from clinloom.operators.filters import where_all
from clinloom.operators.joins import (assemble_studies, attach_primary_dx, attach_report_text, describe_codes,
                                      link_same_day)


def primary_dx(dx: DataFrame, dictionary: DataFrame, safe: bool = False, version: int = 10) -> DataFrame:
    """J7 + P7: described diagnoses, primary position, one ICD version."""
    described = describe_codes(dx, dictionary, safe=safe)
    return where_all(described, F.col("seq_num") == 1, F.col("icd_version") == version)


def studies_with_day(records: DataFrame, metadata: DataFrame, studies: DataFrame) -> DataFrame:
    """J8 + D-1 + D-2."""
    s = assemble_studies(records, metadata, studies)
    ts = study_timestamp(F.col("study_date"), F.col("study_time"))
    return s.withColumn("study_date_time", ts).withColumn("day", to_day(F.col("study_date_time")))


def xray_orders(poe: DataFrame, subtype: str = "General Xray") -> DataFrame:
    """P8 + D-2 on the order table."""
    o = where_all(poe, F.col("order_subtype") == subtype)
    return o.select("subject_id", "hadm_id", "ordertime", "order_subtype", to_day(F.col("ordertime")).alias("day"))


def linked_orders(poe: DataFrame, records: DataFrame, metadata: DataFrame, studies: DataFrame) -> DataFrame:
    """Same patient, same calendar day."""
    return link_same_day(xray_orders(poe), studies_with_day(records, metadata, studies))


def link_radiology(dx: DataFrame, dictionary: DataFrame, records: DataFrame, metadata: DataFrame,
                   studies: DataFrame, poe: DataFrame, reports: DataFrame, safe: bool = False) -> DataFrame:
    """subject_id, hadm_id, study_id, text_path, seq_num, icd_code, icd_version, long_title, study_text.

    Same result as joining every order row to every study row of the patient-day and
    then keeping one row per report path, but each side is first reduced (partial
    aggregation) to the distinct values the result depends on -- (subject, day,
    admission) and (subject, day, study, path) -- so repeated orders and the several
    images of a study never multiply in the join.  The long report text is joined
    after the per-path dedupe, onto one row per path.
    """
    orders = xray_orders(poe).select("subject_id", "day", "hadm_id").distinct()
    studs = studies_with_day(records, metadata, studies).select("subject_id", "day", "study_id", "text_path").distinct()
    linked = link_same_day(orders, studs).select("subject_id", "hadm_id", "study_id", "text_path")
    x = attach_primary_dx(linked, primary_dx(dx, dictionary, safe))
    x = x.join(reports.select(F.col("path").alias("text_path")).distinct(), "text_path", "left_semi")
    first = dedupe_studies(x, "text_path", order=("hadm_id", "study_id", "icd_code", "long_title"))
    return attach_report_text(first, reports)


def code_density(linked: DataFrame) -> DataFrame:
    """A6 over the linked studies."""
    return label_density(linked, "icd_code")
