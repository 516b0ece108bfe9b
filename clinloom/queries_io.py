"""Registered queries for sources and sinks: each writes fixture data through Spark's
DataFrameWriter into the session's checkpoint folder and reads it back with the source
under test, so the comparison checks the reader's parsing (quoting, nulls, leading
zeros, multi-line text, split names)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.operators import filters as P
from clinloom.operators import joins as J
from clinloom.operators import metrics as M
from clinloom.plans import classification as C
from clinloom.plans import corpora as G
from clinloom.plans import radiology as R
from clinloom.plans.icd_dataset import IcdParams, icd_dataset
from clinloom.queries_core import G1_SQL, g1_query
from clinloom.queries_linkage import LINKED_G4_SQL, g4_columns
from clinloom.queries_ml import G2_CTES, G3_SQL, G7_SQL, g2_corpus, g3_columns
from clinloom.catalog import CLEAN_ICD_SQL, V, register, tbl
from clinloom.session import ensure_checkpoint_dir
from clinloom.sources import readers as S
from clinloom.sources import sinks as K
from clinloom.functions.text import clean_text
from clinloom.streaming import on_files, write_stream


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex[:8]}"


@register("s1_read_notes", "SELECT row_id, subject_id, hadm_id, category, text FROM v_notes")
def s1(spark, sf):
    n = V(spark, sf, "v_notes")
    layout = n.select(F.col("row_id").alias("ROW_ID"), F.col("subject_id").alias("SUBJECT_ID"),
                      F.col("hadm_id").cast("double").alias("HADM_ID"),  # written as "123.0", like pandas
                      *[F.lit(None).cast("string").alias(c) for c in ("CHARTDATE", "CHARTTIME", "STORETIME")],
                      F.col("category").alias("CATEGORY"), F.lit(None).cast("string").alias("DESCRIPTION"),
                      F.lit(None).cast("string").alias("CGID"), F.lit(None).cast("string").alias("ISERROR"),
                      F.col("text").alias("TEXT"))
    path = scratch(spark, "notes")
    (layout.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return S.read_notes(spark, path, ["row_id", "subject_id", "hadm_id", "category", "text"])


@register("s2_read_codes", "SELECT hadm_id, CAST(seq_num AS INTEGER) AS seq_num, icd9_code FROM v_diag")
def s2(spark, sf):
    d = V(spark, sf, "v_diag")
    path = scratch(spark, "codes")
    (d.select(F.lit(None).cast("bigint").alias("ROW_ID"), F.lit(None).cast("bigint").alias("SUBJECT_ID"),
              F.col("hadm_id").alias("HADM_ID"), F.col("seq_num").alias("SEQ_NUM"), F.col("icd9_code").alias("ICD9_CODE"))
      .write.mode("overwrite").option("header", True).csv(path))
    return S.read_codes(spark, path).select("hadm_id", "seq_num", "icd9_code")


def _write_pairs_json(spark, pairs, path):
    (pairs.select(F.col("pair_id").alias("pairID"), "sentence1", "sentence2", "gold_label")
          .write.mode("overwrite").json(path))


@register("s3_read_pairs_jsonl", "SELECT pair_id, sentence1, sentence2, gold_label FROM v_pairs")
def s3(spark, sf):
    path = scratch(spark, "pairs")
    _write_pairs_json(spark, V(spark, sf, "v_pairs"), path)
    return S.read_pairs_jsonl(spark, path)


@register("s4_load_pair_splits", "SELECT pair_id, sentence1, sentence2, gold_label, split FROM v_pairs")
def s4(spark, sf):
    root = scratch(spark, "pair-splits")
    pairs = V(spark, sf, "v_pairs")
    for split, name in S.PAIR_FILES.items():
        _write_pairs_json(spark, pairs.where(F.col("split") == split), f"{root}/{name}")
    return S.load_pair_splits(spark, root)


@register("s5_flatten_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s5(spark, sf):
    ev = tbl(spark, sf, "events").select("event_id", "props")
    return S.flatten_json(ev, "props", T.StructType([T.StructField("k", T.LongType())]))


_TSV_SQL = r"""SELECT pair_id, regexp_replace(sentence1, '[\t\n\r]', ' ', 'g') AS sentence1,
       regexp_replace(sentence2, '[\t\n\r]', ' ', 'g') AS sentence2 FROM v_pairs"""


@register("s7_read_tsv", _TSV_SQL)
def s7(spark, sf):
    p = V(spark, sf, "v_pairs")
    clean = [F.regexp_replace(F.col(c), "[\\t\\n\\r]", " ") for c in ("sentence1", "sentence2")]
    path = scratch(spark, "tsv")
    p.select(F.concat_ws("\t", F.col("pair_id"), *clean).alias("value")).write.mode("overwrite").text(path)
    schema = "pair_id string, sentence1 string, sentence2 string"
    return S.read_tsv(spark, path, schema)


def _written_corpus(spark, sf):
    path = scratch(spark, "corpus")
    K.write_corpus(g2_corpus(spark, sf), path)
    return path


@register("k2_write_corpus", f"WITH {G2_CTES} SELECT text, split FROM g2")
def k2(spark, sf):
    """Every line of every split, as written."""
    return spark.read.text(_written_corpus(spark, sf)).select(F.col("value").alias("text"), "split")


@register("s8_read_corpus_lines", f"""WITH {G2_CTES}
SELECT text, split FROM g2 WHERE length(text) > 10 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def s8(spark, sf):
    return S.read_corpus_lines(spark, _written_corpus(spark, sf)).select("text", "split")


# a warehouse question of our own: how often each described diagnosis occurs, and where it ranks
_S9_SQL = """SELECT title, n, admissions, row_number() OVER (ORDER BY n DESC, title) AS position
FROM (SELECT coalesce(long_title, 'undescribed') AS title, count(*) AS n, count(DISTINCT hadm_id) AS admissions
      FROM v_dx LEFT JOIN v_d_icd USING (icd_code, icd_version) GROUP BY 1) AS titles"""


@register("s9_warehouse_sql", "SELECT title, n, admissions, CAST(position AS INTEGER) AS position FROM (" + _S9_SQL + ")")
def s9(spark, sf):
    views = {v: V(spark, sf, v) for v in ("v_dx", "v_d_icd")}
    return S.run_query(spark, _S9_SQL, views)


@register("k1_write_splits", G1_SQL)
def k1(spark, sf):
    path = scratch(spark, "splits")
    K.write_splits(g1_query(spark, sf), path)
    return K.read_back(spark, path).select("hadm_id", "text", "category", "icd9_code", "split")


@register("k3_write_filtered", f"SELECT row_id, {CLEAN_ICD_SQL} AS text FROM v_notes")
def k3(spark, sf):
    n = V(spark, sf, "v_notes").select("row_id", clean_text(F.col("text"), "icd").alias("text"))
    path = scratch(spark, "filtered")
    K.write_filtered(n, path)
    return K.read_back(spark, path)


@register("k4_checkpoint_table", "SELECT hadm_id, CAST(seq_num AS INTEGER) AS seq_num, icd9_code FROM v_diag")
def k4(spark, sf):
    d = V(spark, sf, "v_diag").select("hadm_id", F.col("seq_num").cast("int").alias("seq_num"), "icd9_code")
    return K.checkpoint_table(d, scratch(spark, "ckpt"))


@register("k4_bucketed_codes", """
WITH d AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes, count(*) AS n
           FROM v_diag WHERE hadm_id IS NOT NULL AND icd9_code IS NOT NULL GROUP BY hadm_id),
p AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes, count(*) AS n
      FROM v_proc WHERE hadm_id IS NOT NULL AND icd9_code IS NOT NULL GROUP BY hadm_id)
SELECT d.hadm_id, d.codes AS diag_codes, p.codes AS proc_codes, d.n + p.n AS n_codes FROM d JOIN p ON d.hadm_id = p.hadm_id""")
def k4b(spark, sf):
    """Both code tables bucketed by admission; their lists and join read the buckets as they lie."""
    lists = []
    for view, name in (("v_diag", "diag"), ("v_proc", "proc")):
        codes = V(spark, sf, view).where("hadm_id IS NOT NULL AND icd9_code IS NOT NULL")
        t = K.write_bucketed(codes.select("hadm_id", "seq_num", "icd9_code"), f"clinloom_{uuid.uuid4().hex}",
                             ["hadm_id"], 16, scratch(spark, f"bucketed-{name}"))
        ordered = F.sort_array(F.collect_list(F.struct(F.col("seq_num").cast("int").alias("s"), F.col("icd9_code").alias("c"))))
        lists.append(t.groupBy("hadm_id").agg(F.concat_ws(",", F.transform(ordered, lambda x: x["c"])).alias(f"{name}_codes"),
                                              F.count(F.lit(1)).alias(f"n_{name}")))
    return lists[0].join(lists[1], "hadm_id").select(
        "hadm_id", "diag_codes", "proc_codes", (F.col("n_diag") + F.col("n_proc")).alias("n_codes"))


@register("p10_expectations_in_pass", """
SELECT 'has_admission' AS name, count_if(hadm_id IS NULL) = 0 AS passed, CAST(count_if(hadm_id IS NULL) AS BIGINT) AS observed FROM v_notes
UNION ALL
SELECT 'has_text', count_if(NOT coalesce(length(text) > 0, false)) = 0, CAST(count_if(NOT coalesce(length(text) > 0, false)) AS BIGINT) FROM v_notes""")
def p10_pass(spark, sf):
    """The checks of all notes, collected while the notes are written (no scan of their own)."""
    notes, report = P.observed_expectations(V(spark, sf, "v_notes"), {
        "has_admission": F.col("hadm_id").isNotNull(), "has_text": F.length("text") > 0})
    K.write_filtered(notes, scratch(spark, "checked"))
    return report()


@register("j6_annotated_stream", """
SELECT n.row_id, trim(n.category) AS category, a.quality FROM v_notes n JOIN v_ann a ON n.row_id = a.row_id""")
def j6_stream(spark, sf):
    """Notes arriving as files: the annotated ones kept (J5), their annotations attached."""
    ann = V(spark, sf, "v_ann").select("row_id", "quality")
    src, out, place = (scratch(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    notes = V(spark, sf, "v_notes").select("row_id", F.trim("category").alias("category"))
    notes.write.parquet(src)
    stream = on_files(spark, src, notes.schema, lambda d: J.only_annotated(d, ann), lambda d: J.attach_annotations(d, ann))
    write_stream(stream, out, place).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@register("k5_write_sample", f"WITH {G2_CTES} SELECT text FROM g2 ORDER BY md5('42|' || text), text LIMIT 100")
def k5w(spark, sf):
    path = scratch(spark, "sample")
    K.write_sample(g2_corpus(spark, sf).select("text"), 100, path, "text")
    return spark.read.schema("text string").option("escape", '"').csv(path)


# K6 reads back exactly what G7 computes (doubles are written in their shortest
# round-trip form), so G7's oracle applies.
@register("k6_write_metrics", f"SELECT *, row_number() OVER (ORDER BY metric) - 1 AS line FROM ({G7_SQL})")
def k6(spark, sf):
    path = scratch(spark, "metrics")
    K.write_metrics(C.evaluate(V(spark, sf, "v_scored")), path)
    lines = spark.read.text(path)                              # one file: row numbers are line numbers
    parts = F.split(F.col("value"), " = ")
    return lines.select(parts[0].alias("metric"), F.round(parts[1].cast("double"), 6).alias("value"),
                        F.monotonically_increasing_id().alias("line"))


@register("k7_write_confusion", "SELECT batch_id, actual, predicted, count(*) AS n FROM v_scored GROUP BY ALL")
def k7(spark, sf):
    path = scratch(spark, "confusion")
    K.write_confusion(M.confusion(V(spark, sf, "v_scored"), by=["batch_id"]), path)
    return K.read_back(spark, path)


@register("s6_read_reports", "SELECT replace(path, '/', ' ') AS path, text FROM v_reports")
def s6(spark, sf):
    """Each report is written as its own file (one folder per report, its name with blanks),
    then read back whole; the folder name is the path."""
    root = scratch(spark, "reports")
    K.write_reports(V(spark, sf, "v_reports").withColumn("path", F.translate("path", "/", " ")), root)
    files = S.read_reports(spark, root)
    # every file ends with one line separator
    return files.select(F.regexp_extract("path", "^path=([^/]*)/", 1).alias("path"),
                        F.expr("substring(text, 1, length(text) - 1)").alias("text"))


@register("s1_read_cleaned_notes", f"SELECT row_id, hadm_id, category, {CLEAN_ICD_SQL} AS text FROM v_notes")
def s1_cleaned(spark, sf):
    """S1 over the cleaned-notes file: four columns, in another order than the raw file's."""
    n = V(spark, sf, "v_notes").select(clean_text(F.col("text"), "icd").alias("TEXT"), F.col("category").alias("CATEGORY"),
                                       F.col("hadm_id").cast("double").alias("HADM_ID"), F.col("row_id").alias("ROW_ID"))
    return S.read_notes(spark, _csv_file(n, scratch(spark, "cleaned")), ["row_id", "hadm_id", "category", "text"])


def _csv_file(df, path):
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').option("quoteAll", True)
       .option("nullValue", None).csv(path))
    return path


# ------------------------------------------------ whole jobs from files, read by the readers above

def _upper(df):
    return df.toDF(*[c.upper() for c in df.columns])


def _notes_file(spark, sf):
    n = V(spark, sf, "v_notes").select("text", "category", "hadm_id", "row_id")
    return S.read_notes(spark, _csv_file(_upper(n), scratch(spark, "job-notes")))


def _named_file(spark, sf, table, view):
    return S.read_named(spark, _csv_file(_upper(V(spark, sf, view)), scratch(spark, f"job-{table}")), table)


@register("g1_from_files", "SELECT hadm_id, text, category, icd9_code AS icd10_code, split FROM (" + G1_SQL + ")")
def g1_files(spark, sf):
    """G1 in ICD-10 mode: the cleaned-notes file and two code files with an ICD10_CODE column."""
    n = V(spark, sf, "v_notes").select(clean_text(F.col("text"), "icd").alias("TEXT"), F.col("category").alias("CATEGORY"),
                                       F.col("hadm_id").alias("HADM_ID"), F.col("row_id").alias("ROW_ID"))
    notes = S.read_notes(spark, _csv_file(n, scratch(spark, "job-cleaned")))
    codes = [S.read_codes(spark, _csv_file(_upper(V(spark, sf, v).withColumnRenamed("icd9_code", "icd10_code")),
                                           scratch(spark, "job-codes")), "icd10_code") for v in ("v_diag", "v_proc")]
    return icd_dataset(notes, *codes, IcdParams(code_column="icd10_code"), cleaned=True)


@register("g2_from_files", f"WITH {G2_CTES} SELECT text, split FROM g2")
def g2_files(spark, sf):
    """G2 from a notes file, an annotation file and a folder of reports."""
    root = scratch(spark, "job-reports")
    K.write_reports(V(spark, sf, "v_reports").withColumn("path", F.translate("path", "/", " ")), root)
    reports = S.read_reports(spark, root).withColumn("text", F.expr("substring(text, 1, length(text) - 1)"))
    return G.mlm_corpus(_notes_file(spark, sf), reports, _named_file(spark, sf, "annotations", "v_ann"))


@register("g3_from_files", G3_SQL)
def g3_files(spark, sf):
    """G3 from a notes file and an annotation file."""
    return g3_columns(G.annotation_dataset(_notes_file(spark, sf), _named_file(spark, sf, "annotations", "v_ann")))


@register("g4_from_files", LINKED_G4_SQL)
def g4_files(spark, sf):
    """G4 from six table files; the reports as read before."""
    views = {"diagnoses": "v_dx", "dictionary": "v_d_icd", "records": "v_records", "metadata": "v_metadata",
             "studies": "v_studies", "orders": "v_poe"}
    t = [_named_file(spark, sf, name, v) for name, v in views.items()]
    return g4_columns(R.link_radiology(*t, V(spark, sf, "v_reports")))
