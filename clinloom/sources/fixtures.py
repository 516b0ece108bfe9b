"""Fixture views: the given synthetic tables re-shaped to the clinical source tables.

Each view is one SQL string that runs unchanged on Spark SQL and DuckDB (the only
difference, ``slice(`` vs ``list_slice(``, is rewritten for DuckDB).  The Spark side
registers the raw parquet tables as temp views and then these views; the DuckDB side
receives the same text as ``WITH`` CTEs in front of each oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed view definitions (the test-fixture contract): names, column names and the
# derivation rules must stay exactly as written.
VIEWS: dict[str, str] = {
    "v_notes": """
SELECT doc_id AS row_id,
       CAST(floor(doc_id / 9) AS BIGINT) AS subject_id,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(floor(doc_id / 3) AS BIGINT) END AS hadm_id,
       CASE WHEN doc_id % 5 < 3 THEN 'Discharge summary' WHEN doc_id % 5 = 3 THEN 'Physician ' ELSE 'Radiology' END AS category,
       CASE WHEN doc_id % 4 = 0 THEN concat('Admission Date [**2101-1-', CAST(doc_id % 28 AS STRING), '**] ID# 12 w/ XRAY VIII ', text)
            WHEN doc_id % 4 = 1 THEN concat('FINAL REPORT Provider: Phone 555 MD am ', text, ' Lidocaine 5 %(700 mg/patch) Adhesive Patch')
            ELSE text END AS text
FROM documents""",
    "v_diag": """
SELECT l_orderkey AS hadm_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq_num,
       lpad(CAST(l_partkey % 120 AS STRING), 5, '0') AS icd9_code
FROM lineitem""",
    "v_proc": """
SELECT l_orderkey AS hadm_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate) AS INT) AS seq_num,
       lpad(CAST(l_suppkey % 40 AS STRING), 4, '0') AS icd9_code
FROM lineitem WHERE l_returnflag = 'R'""",
    "v_ann": """
SELECT doc_id AS row_id, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS unsure, quality, toxic FROM labels
UNION ALL
SELECT doc_id AS row_id, 0 AS unsure, 1 - quality AS quality, toxic FROM labels WHERE doc_id % 13 = 0""",
    "v_reports": """
SELECT concat('files/p', CAST(page_id % 10 AS STRING), '/s', CAST(page_id AS STRING), '.txt') AS path, html AS text FROM pages""",
    "v_studies": """
SELECT user_id AS subject_id, event_id AS study_id,
       concat('files/p', CAST(event_id % 250 % 10 AS STRING), '/s', CAST(event_id % 250 AS STRING), '.txt') AS path
FROM events WHERE event_type = 'view'""",
    "v_records": """
SELECT user_id AS subject_id, event_id AS study_id, concat('d', CAST(event_id AS STRING), '-', k) AS dicom_id,
       concat('img/', CAST(event_id AS STRING), '-', k, '.dcm') AS path
FROM events CROSS JOIN (SELECT 'a' AS k UNION ALL SELECT 'b' AS k) x WHERE event_type = 'view'""",
    "v_metadata": """
SELECT concat('d', CAST(event_id AS STRING), '-', k) AS dicom,
       replace(substr(CAST(ts AS STRING), 1, 10), '-', '') AS study_date,
       concat(replace(substr(CAST(ts AS STRING), 12, 8), ':', ''), CASE WHEN k = 'b' THEN '.25' ELSE '' END) AS study_time
FROM events CROSS JOIN (SELECT 'a' AS k UNION ALL SELECT 'b' AS k) x WHERE event_type = 'view'""",
    "v_poe": """
SELECT user_id AS subject_id, CAST(user_id * 100 + extract(day FROM ts) AS BIGINT) AS hadm_id, ts AS ordertime,
       CASE WHEN event_id % 3 = 0 THEN 'CT Scan' ELSE 'General Xray' END AS order_subtype
FROM events WHERE event_type = 'purchase'""",
    "v_dx": """
SELECT user_id AS subject_id, CAST(user_id * 100 + extract(day FROM ts) AS BIGINT) AS hadm_id,
       CAST(row_number() OVER (PARTITION BY user_id, extract(day FROM ts) ORDER BY event_id) AS INT) AS seq_num,
       concat('C', CAST(event_id % 30 AS STRING)) AS icd_code,
       CASE WHEN event_id % 4 = 0 THEN 9 ELSE 10 END AS icd_version
FROM events WHERE event_type IN ('error', 'click', 'signup')""",
    "v_d_icd": """
SELECT concat('C', CAST(p_partkey % 30 AS STRING)) AS icd_code, v AS icd_version,
       concat(p_name, ' v', CAST(v AS STRING)) AS long_title
FROM part CROSS JOIN (SELECT 9 AS v UNION ALL SELECT 10 AS v) x WHERE p_partkey < 30 AND (v = 10 OR p_partkey % 2 = 0)""",
    "v_pairs": """
SELECT concat(CAST(a.conv_id AS STRING), '-', CAST(a.turn AS STRING)) AS pair_id, a.text AS sentence1, b.text AS sentence2,
       CASE (a.conv_id + a.turn) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'entailment' WHEN 2 THEN 'contradiction' WHEN 3 THEN 'entailment' ELSE 'neutral' END AS gold_label,
       CASE WHEN a.conv_id % 10 = 0 THEN 'test' WHEN a.conv_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'""",
    "v_scored": """
SELECT vec_id, CAST(floor(vec_id / 12) AS BIGINT) AS batch_id, label AS actual,
       CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS predicted,
       slice(embedding, 1, 10) AS logits
FROM embeddings""",
    "v_token_vectors": """
SELECT label AS doc, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS pos,
       vec_id % 7 = 0 AS is_pad, embedding
FROM embeddings""",
}

# Spark-side formulations of the views that pair each row with a constant list: the
# same rows, produced by ``explode`` instead of a join with a constant table.  The
# oracle keeps the published text above.
SPARK_VIEWS: dict[str, str] = {
    "v_records": """
SELECT user_id AS subject_id, event_id AS study_id, concat('d', CAST(event_id AS STRING), '-', k) AS dicom_id,
       concat('img/', CAST(event_id AS STRING), '-', k, '.dcm') AS path
FROM events LATERAL VIEW explode(array('a', 'b')) x AS k WHERE event_type = 'view'""",
    "v_metadata": """
SELECT concat('d', CAST(event_id AS STRING), '-', k) AS dicom,
       replace(substr(CAST(ts AS STRING), 1, 10), '-', '') AS study_date,
       concat(replace(substr(CAST(ts AS STRING), 12, 8), ':', ''), CASE WHEN k = 'b' THEN '.25' ELSE '' END) AS study_time
FROM events LATERAL VIEW explode(array('a', 'b')) x AS k WHERE event_type = 'view'""",
    "v_d_icd": """
SELECT concat('C', CAST(p_partkey % 30 AS STRING)) AS icd_code, v AS icd_version,
       concat(p_name, ' v', CAST(v AS STRING)) AS long_title
FROM part LATERAL VIEW explode(array(9, 10)) x AS v WHERE p_partkey < 30 AND (v = 10 OR p_partkey % 2 = 0)""",
}

_VIEW_REF = re.compile(r"\bv_[a-z_]+\b")


def _dependencies(sql: str) -> list[str]:
    """Fixture views referenced by ``sql`` (transitively), in definition order."""
    found: set[str] = set()
    stack = [m for m in _VIEW_REF.findall(sql) if m in VIEWS]
    while stack:
        name = stack.pop()
        if name not in found:
            found.add(name)
            stack.extend(m for m in _VIEW_REF.findall(VIEWS[name]) if m in VIEWS)
    return [v for v in VIEWS if v in found]


_SLICE = re.compile(r"(?<![\w])slice\(")


def to_duckdb(sql: str) -> str:
    """Spark ``slice(`` -> DuckDB ``list_slice(`` (same result, since the start is 1)."""
    return _SLICE.sub("list_slice(", sql)


def oracle(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it uses as CTEs, in DuckDB dialect.

    ``sql`` may itself start with ``WITH``; its CTEs are appended after the views.
    """
    deps = _dependencies(sql)
    body = sql.strip()
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in deps]
    if body[:4].upper() == "WITH":
        body = body[4:].lstrip()
        text = "WITH " + ",\n".join(ctes + [body]) if ctes else "WITH " + body
    elif ctes:
        text = "WITH " + ",\n".join(ctes) + "\n" + body
    else:
        text = body
    return to_duckdb(text)


# Tables whose rows carry long text: per-row work on them is CPU-heavy, so a scan that
# arrives as a single split is spread over the cores first (no-op for split input).
TEXT_TABLES = {"documents", "pages"}

_TABLE_REF = re.compile(r"\b(" + "|".join(TABLES) + r")\b")
# per session: the folder currently registered and the names registered from it
_STATE: dict[int, dict] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from clinloom.sources.readers import spread
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _state(spark: SparkSession, sf_dir: str) -> dict:
    st = _STATE.get(id(spark))
    if st is None or st["sf"] != sf_dir or st["session"] is not spark:
        st = _STATE[id(spark)] = {"sf": sf_dir, "names": set(), "frames": {}, "session": spark}
    return st


def _ensure(spark: SparkSession, sf_dir: str, name: str, st: dict) -> None:
    """Register ``name`` (a table or a fixture view) and what it depends on, once."""
    if name in st["names"] and spark.catalog.tableExists(name):
        return
    if name in VIEWS:
        sql = SPARK_VIEWS.get(name, VIEWS[name])
        for dep in sorted(set(_TABLE_REF.findall(sql))):
            _ensure(spark, sf_dir, dep, st)
        for dep in _dependencies(sql):
            if dep != name:
                _ensure(spark, sf_dir, dep, st)
        spark.sql(sql).createOrReplaceTempView(name)
    else:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    st["names"].add(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view (or raw table) as a DataFrame; registration happens once per folder."""
    _ensure(spark, sf_dir, name, _state(spark, sf_dir))
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    st = _state(spark, sf_dir)
    df = st["frames"].get(name)
    if df is None:
        df = st["frames"][name] = _read(spark, sf_dir, name)
    return df
