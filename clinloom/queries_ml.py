"""Registered queries: corpora (G2, G3, G8), sampling (U), labels (E, L, G6),
evaluation (A9-A14, M2-M4, G7), sequences (Q, A15, G5), embeddings (M1, M5, M6), hook (F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinloom.functions.text import clean_text
from clinloom.operators import aggregates as A
from clinloom.operators import embeddings as EM
from clinloom.operators import head as HEAD
from clinloom.operators import labels as L
from clinloom.operators import metrics as M
from clinloom.operators import sampling as U
from clinloom.operators import sequences as Q
from clinloom.operators.hooks import apply_tokenizer, whitespace_tokenizer
from clinloom.operators.joins import attach_annotations, exclude_annotated, only_annotated
from clinloom.plans import classification as C
from clinloom.plans import corpora as G
from clinloom.catalog import CLEAN_MLM_SQL, V, register, tbl
from clinloom.session import materialise

TOK = r"regexp_extract_all(lower(coalesce(@, '')), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


def tok_sql(x: str) -> str:
    return TOK.replace("@", x)


def ints(c):
    """Comparison form of an int array: comma string."""
    return F.array_join(c.cast("array<string>"), ",")


def r6(c):
    return F.round(c.cast("double"), 6)


# --------------------------------------------------------------------------- joins / sets used by G2, G3

@register("j4_exclude_annotated", "SELECT row_id FROM v_notes n WHERE NOT EXISTS (SELECT 1 FROM v_ann a WHERE a.row_id = n.row_id)")
def j4(spark, sf):
    return exclude_annotated(V(spark, sf, "v_notes").select("row_id", "text"), V(spark, sf, "v_ann")).select("row_id")


@register("j5_only_annotated", "SELECT row_id FROM v_notes n WHERE EXISTS (SELECT 1 FROM v_ann a WHERE a.row_id = n.row_id)")
def j5(spark, sf):
    return only_annotated(V(spark, sf, "v_notes").select("row_id", "text"), V(spark, sf, "v_ann")).select("row_id")


@register("j6_attach_annotations", """
SELECT n.row_id, CAST(a.quality AS BIGINT) AS quality, CAST(a.toxic AS BIGINT) AS toxic
FROM v_notes n LEFT JOIN v_ann a ON n.row_id = a.row_id""")
def j6(spark, sf):
    out = attach_annotations(V(spark, sf, "v_notes").select("row_id"), V(spark, sf, "v_ann"))
    return out.select("row_id", F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))


@register("x1_union_corpora", """
SELECT row_id, text FROM v_notes UNION ALL SELECT NULL AS row_id, text FROM v_reports""")
def x1(spark, sf):
    return G.union_corpora(V(spark, sf, "v_notes").select("row_id", "text"), V(spark, sf, "v_reports").select("text"))


@register("w3_distinct_corpus", f"SELECT DISTINCT {CLEAN_MLM_SQL} AS text FROM v_notes")
def w3(spark, sf):
    from clinloom.operators.dedupe import distinct_corpus
    n = V(spark, sf, "v_notes").select(clean_text(F.col("text"), "mlm").alias("text"))
    return distinct_corpus(n)


G2_CTES = f"""g2base AS (SELECT text FROM v_notes n WHERE NOT EXISTS (SELECT 1 FROM v_ann a WHERE a.row_id = n.row_id)
           UNION ALL SELECT text FROM v_reports),
g2c AS (SELECT DISTINCT {CLEAN_MLM_SQL} AS text FROM g2base WHERE text IS NOT NULL),
g2r AS (SELECT text, row_number() OVER (ORDER BY md5('42|' || text), text) - 1 AS rk, count(*) OVER () AS n FROM g2c),
g2 AS (SELECT text, CASE WHEN rk < ceil(CAST(n AS DOUBLE) * 0.1) THEN 'validate' ELSE 'train' END AS split FROM g2r)"""


def g2_corpus(spark, sf):
    return G.mlm_corpus(V(spark, sf, "v_notes"), V(spark, sf, "v_reports"), V(spark, sf, "v_ann"))


register("g2_mlm_corpus", f"WITH {G2_CTES} SELECT text, split FROM g2")(g2_corpus)


@register("u3_holdout", """
WITH r AS (SELECT pair_id, row_number() OVER (ORDER BY md5('7|' || pair_id), pair_id) - 1 AS rk, count(*) OVER () AS n FROM v_pairs)
SELECT pair_id, CASE WHEN rk < ceil(CAST(n AS DOUBLE) * 0.25) THEN 'validate' ELSE 'train' END AS split FROM r""")
def u3(spark, sf):
    return U.holdout(V(spark, sf, "v_pairs").select("pair_id"), "pair_id", test_size=0.25, seed=7)


@register("k5_corpus_sample", f"WITH {G2_CTES} SELECT text FROM g2 ORDER BY md5('42|' || text), text LIMIT 100")
def k5(spark, sf):
    return G.corpus_sample(g2_corpus(spark, sf).select("text"), 100)


G3_SQL = f"""
WITH sure AS (SELECT row_id, quality, toxic FROM v_ann WHERE unsure = 0),
n AS (SELECT row_id, {CLEAN_MLM_SQL} AS text FROM v_notes WHERE row_id IN (SELECT row_id FROM sure)),
r AS (SELECT n.row_id, n.text, s.quality, s.toxic FROM n LEFT JOIN sure s ON n.row_id = s.row_id)
SELECT row_id, text, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic,
       CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) AS labels,
       CASE WHEN ('0x' || substr(md5('42|' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < {0.8!r}
            THEN 'train' ELSE 'validate' END AS split
FROM r"""


def g3_columns(out):
    return out.select("row_id", "text", F.col("quality").cast("bigint").alias("quality"),
                      F.col("toxic").cast("bigint").alias("toxic"), ints(F.col("labels")).alias("labels"), "split")


@register("g3_annotation_dataset", G3_SQL)
def g3(spark, sf):
    return g3_columns(G.annotation_dataset(V(spark, sf, "v_notes"), V(spark, sf, "v_ann")))


@register("e5_one_hot_columns", """
SELECT row_id, CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) AS labels FROM v_ann""")
def e5(spark, sf):
    return L.one_hot_columns(V(spark, sf, "v_ann"), ["quality", "toxic"]).select("row_id", ints(F.col("labels")).alias("labels"))


# --------------------------------------------------------------------------- sampling (U)

def _u_sql(key_expr: str, seed: str = "42") -> str:
    return f"md5('{seed}|' || {key_expr})"


@register("u1_split_exact", f"""
WITH r AS (SELECT pair_id, row_number() OVER (ORDER BY {_u_sql('pair_id')}, pair_id) - 1 AS rk,
                  count(*) OVER () AS n FROM v_pairs),
s AS (SELECT *, CAST(round_even(CAST(n AS DOUBLE) * 0.8, 0) AS BIGINT) AS pool FROM r)
SELECT pair_id, CASE WHEN rk < CAST(round_even(CAST(pool AS DOUBLE) * 0.25, 0) AS BIGINT) THEN 'validate'
                     WHEN rk < pool THEN 'train' ELSE 'test' END AS split FROM s""")
def u1(spark, sf):
    return U.split_exact(V(spark, sf, "v_pairs").select("pair_id"), "pair_id")


_U2_CUTS = (0.6, 0.6 + 0.2)


@register("u2_split_hash", f"""
WITH h AS (SELECT row_id, ('0x' || substr({_u_sql('CAST(row_id AS VARCHAR)')}, 1, 8))::BIGINT / 4294967296.0 AS u FROM v_notes)
SELECT row_id, CASE WHEN u < {_U2_CUTS[0]!r} THEN 'train' WHEN u < {_U2_CUTS[1]!r} THEN 'validate' ELSE 'test' END AS split FROM h""")
def u2(spark, sf):
    return U.split_hash(V(spark, sf, "v_notes").select("row_id"), "row_id")


@register("u4_subsample_splits", f"""
SELECT pair_id, split FROM (SELECT pair_id, split,
    row_number() OVER (PARTITION BY split ORDER BY {_u_sql('pair_id')}, pair_id) AS rn FROM v_pairs)
WHERE (split = 'train' AND rn <= 80) OR (split = 'dev' AND rn <= 20) OR (split = 'test' AND rn <= 20)""")
def u4(spark, sf):
    p = V(spark, sf, "v_pairs").select("pair_id", "split")
    return U.subsample_splits(p, {"train": 80, "dev": 20, "test": 20}, "pair_id")


@register("u5_sample_n", f"""
SELECT doc_id FROM documents ORDER BY {_u_sql('CAST(doc_id AS VARCHAR)')}, doc_id LIMIT 100""")
def u5(spark, sf):
    return U.sample_n(tbl(spark, sf, "documents").select("doc_id"), 100, "doc_id")


@register("u7_assign_batches", f"""
SELECT pair_id, position, position // 16 AS batch_id FROM (
  SELECT pair_id, row_number() OVER (ORDER BY {_u_sql('pair_id', '42|0')}, pair_id) - 1 AS position FROM v_pairs)""")
def u7(spark, sf):
    return U.assign_batches(V(spark, sf, "v_pairs").select("pair_id"), 16, "pair_id")


_U8_SQL = """SELECT doc_id, position, position // 16 AS batch_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents)"""


@register("u8_bucket_by_length", _U8_SQL)
def u8(spark, sf):
    return U.bucket_by_length(tbl(spark, sf, "documents").select("doc_id", "n_chars"), 16, "n_chars", "doc_id").select(
        "doc_id", "position", "batch_id")


@register("u8_bucket_by_length_splits", """
SELECT pair_id, split, position, position // CASE split WHEN 'train' THEN 16 ELSE 256 END AS batch_id FROM (
  SELECT pair_id, split, row_number() OVER (PARTITION BY split ORDER BY length(sentence1), pair_id) - 1 AS position FROM v_pairs)""")
def u8_splits(spark, sf):
    """U8 with a batch size per split."""
    p = V(spark, sf, "v_pairs").select("pair_id", "split", F.length("sentence1").alias("n"))
    out = U.bucket_by_length(p, {"train": 16, "dev": 256, "test": 256}, "n", "pair_id")
    return out.select("pair_id", "split", "position", "batch_id")


@register("u9_shard", f"SELECT doc_id, position, batch_id, CAST(position % 4 AS INTEGER) AS worker FROM ({_U8_SQL})")
def u9(spark, sf):
    return U.shard(u8(spark, sf), 4)


# --------------------------------------------------------------------------- labels (E, L, G6)

_DIAG_SPLIT = f"""ds AS (SELECT hadm_id, seq_num, icd9_code AS label,
    CASE WHEN ('0x' || substr({_u_sql('CAST(hadm_id AS VARCHAR)')}, 1, 8))::BIGINT / 4294967296.0 < {0.6!r} THEN 'train'
         WHEN ('0x' || substr({_u_sql('CAST(hadm_id AS VARCHAR)')}, 1, 8))::BIGINT / 4294967296.0 < {_U2_CUTS[1]!r} THEN 'validate'
         ELSE 'test' END AS split FROM v_diag),
top AS (SELECT label, count(*) AS n FROM ds WHERE split = 'train' GROUP BY label ORDER BY n DESC, label LIMIT 50)"""


def _diag_split(spark, sf):
    d = V(spark, sf, "v_diag").select("hadm_id", "seq_num", F.col("icd9_code").alias("label"))
    return U.split_hash(d, "hadm_id")


@register("l2_top_labels", f"WITH {_DIAG_SPLIT} SELECT label, n FROM top")
def l2(spark, sf):
    return L.top_labels(_diag_split(spark, sf).where(F.col("split") == "train"), 50)


@register("l3_filter_top_labels", f"""WITH {_DIAG_SPLIT}
SELECT hadm_id, CAST(seq_num AS BIGINT) AS seq_num, label, split FROM ds WHERE label IN (SELECT label FROM top)""")
def l3(spark, sf):
    ds = _diag_split(spark, sf)
    out = L.filter_top_labels(ds, L.top_labels(ds.where(F.col("split") == "train"), 50))
    return out.select("hadm_id", F.col("seq_num").cast("bigint").alias("seq_num"), "label", "split")


@register("g6_top_label_dataset", f"""WITH {_DIAG_SPLIT},
ids AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM top),
k AS (SELECT ds.*, ids.label_id FROM ds JOIN ids ON ds.label = ids.label),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY
        md5('42|0|' || CAST(hadm_id AS VARCHAR) || '|' || CAST(seq_num AS VARCHAR)), hadm_id, seq_num) - 1 AS position FROM k)
SELECT hadm_id, CAST(seq_num AS BIGINT) AS seq_num, label, label_id, split, position, position // 12 AS batch_id FROM r""")
def g6(spark, sf):
    out = C.top_label_dataset(_diag_split(spark, sf), k=50, batch_size=12, key=["hadm_id", "seq_num"])
    return out.select("hadm_id", F.col("seq_num").cast("bigint").alias("seq_num"), "label", "label_id", "split",
                      "position", "batch_id")


@register("e1_fit_labels", """
SELECT icd9_code AS label, CAST(row_number() OVER (ORDER BY icd9_code) - 1 AS INTEGER) AS label_id
FROM (SELECT DISTINCT icd9_code FROM v_diag)""")
def e1(spark, sf):
    return L.fit_labels(V(spark, sf, "v_diag").select(F.col("icd9_code").alias("label")))


@register("e2_fixed_labels", """
SELECT pair_id, CASE gold_label WHEN 'contradiction' THEN 0 WHEN 'entailment' THEN 1 WHEN 'neutral' THEN 2 END AS label_id FROM v_pairs""")
def e2(spark, sf):
    return V(spark, sf, "v_pairs").select("pair_id", L.label_map_expr(F.col("gold_label")).alias("label_id"))


@register("e3_encode_labels", """
WITH lab AS (SELECT * FROM (VALUES ('contradiction', 0), ('entailment', 1)) t(gold_label, label_id))
SELECT p.pair_id, p.gold_label, l.label_id FROM v_pairs p JOIN lab l ON p.gold_label = l.gold_label""")
def e3(spark, sf):
    lab = L.fixed_labels(spark, ("contradiction", "entailment"), "gold_label", "label_id")
    out = L.encode_labels(V(spark, sf, "v_pairs"), lab, "gold_label", "label_id", on_unknown="drop")
    return out.select("pair_id", "gold_label", "label_id")


@register("e4_decode_labels", """
WITH names AS (SELECT DISTINCT 'L' || CAST(actual AS VARCHAR) AS label FROM v_scored),
ids AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM names)
SELECT s.vec_id, ids.label AS predicted_label FROM v_scored s LEFT JOIN ids ON s.predicted = ids.label_id""")
def e4(spark, sf):
    s = V(spark, sf, "v_scored")
    names = L.fit_labels(s.select(F.concat(F.lit("L"), F.col("actual").cast("string")).alias("label")))
    return L.decode_labels(s, names, "predicted").select("vec_id", "predicted_label")


@register("e6_multi_hot", """
WITH c AS (SELECT hadm_id, string_agg(icd9_code, ',' ORDER BY seq_num, icd9_code) AS codes FROM v_proc GROUP BY hadm_id),
t AS (SELECT icd9_code AS label FROM v_proc GROUP BY icd9_code ORDER BY count(*) DESC, icd9_code LIMIT 10)
SELECT c.hadm_id, string_agg(CASE WHEN list_contains(string_split(c.codes, ','), t.label) THEN '1' ELSE '0' END, ','
       ORDER BY t.label) AS labels
FROM c CROSS JOIN t GROUP BY c.hadm_id""")
def e6(spark, sf):
    proc = V(spark, sf, "v_proc")
    codes = A.codes_by_admission(proc)
    top = L.top_labels(proc.select(F.col("icd9_code").alias("label")), 10)
    out = L.multi_hot(codes, "codes", L.fit_labels(top))
    return out.select("hadm_id", ints(F.col("labels")).alias("labels"))


@register("a4_label_counts", "SELECT gold_label AS label, count(*) AS n FROM v_pairs WHERE gold_label IS NOT NULL GROUP BY gold_label")
def a4(spark, sf):
    p = V(spark, sf, "v_pairs").select(F.col("gold_label").alias("label")).where(F.col("label").isNotNull())
    return A.label_counts(p)


@register("a5_distinct_labels", "SELECT DISTINCT gold_label AS label FROM v_pairs WHERE gold_label IS NOT NULL")
def a5(spark, sf):
    return A.distinct_labels(V(spark, sf, "v_pairs").select(F.col("gold_label").alias("label")))


@register("a7_length_profile", f"""
WITH d AS (SELECT CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0
                       ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS w,
                  length(text) AS c, len({tok_sql('text')}) AS t FROM documents)
SELECT round(avg(w), 6) AS words_mean, round(stddev_samp(w), 6) AS words_std, CAST(max(w) AS BIGINT) AS words_max,
       round(avg(c), 6) AS chars_mean, round(stddev_samp(c), 6) AS chars_std, CAST(max(c) AS BIGINT) AS chars_max,
       round(avg(t), 6) AS tokens_mean, round(stddev_samp(t), 6) AS tokens_std, CAST(max(t) AS BIGINT) AS tokens_max
FROM d""")
def a7(spark, sf):
    d = tbl(spark, sf, "documents")
    prof = A.length_profile(d, "text", F.size(Q.tokenize(F.col("text"))))
    return prof.select(*[(r6(F.col(c)) if not c.endswith("_max") else F.col(c).cast("bigint")).alias(c)
                         for c in prof.columns])


# --------------------------------------------------------------------------- evaluation

@register("a9_confusion", "SELECT actual, predicted, count(*) AS n FROM v_scored GROUP BY actual, predicted")
def a9(spark, sf):
    return M.confusion(V(spark, sf, "v_scored"))


@register("a9_confusion_by_batch", "SELECT batch_id, actual, predicted, count(*) AS n FROM v_scored GROUP BY ALL")
def a9b(spark, sf):
    return M.confusion(V(spark, sf, "v_scored"), by=["batch_id"])


@register("a9_dense_confusion", """
WITH ids AS (SELECT DISTINCT actual AS label_id FROM v_scored),
g AS (SELECT a.label_id AS actual, p.label_id AS predicted FROM ids a CROSS JOIN ids p),
c AS (SELECT actual, predicted, count(*) AS n FROM v_scored GROUP BY actual, predicted)
SELECT g.actual, g.predicted, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.actual = c.actual AND g.predicted = c.predicted""")
def a9d(spark, sf):
    s = V(spark, sf, "v_scored")
    labels = s.select(F.col("actual").alias("label_id")).distinct()
    return M.dense_confusion(M.confusion(s), labels).select("actual", "predicted", "n")


@register("a10_normalise_confusion", """
SELECT actual, predicted, n, round_even(n / sum(n) OVER (PARTITION BY actual), 2) AS share
FROM (SELECT actual, predicted, count(*) AS n FROM v_scored GROUP BY actual, predicted)""")
def a10(spark, sf):
    return M.normalise_confusion(M.confusion(V(spark, sf, "v_scored")))


_CLS_SQL = """c AS (SELECT {by} actual, predicted, count(*) AS n FROM v_scored GROUP BY ALL),
sa AS (SELECT {by} actual AS cls, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM c GROUP BY ALL),
sp AS (SELECT {by} predicted AS cls, sum(n) AS n_pred FROM c GROUP BY ALL),
st AS (SELECT {cols} coalesce(sa.cls, sp.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
              coalesce(n_pred, 0) AS n_pred FROM sa FULL OUTER JOIN sp ON {on}),
pr AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS p,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM st),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr),
m AS (SELECT {by} sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall,
             sum(f1 * support) / sum(support) AS f1, sum(tp) / sum(support) AS accuracy, sum(support) AS n FROM f GROUP BY ALL)"""


def _cls_sql(by: bool) -> str:
    if by:
        return _CLS_SQL.format(by="batch_id,", cols="coalesce(sa.batch_id, sp.batch_id) AS batch_id,",
                               on="sa.batch_id = sp.batch_id AND sa.cls = sp.cls")
    return _CLS_SQL.format(by="", cols="", on="sa.cls = sp.cls")


@register("a11_weighted_metrics", f"""WITH {_cls_sql(False)}
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(accuracy, 6) AS accuracy, CAST(n AS BIGINT) AS n FROM m""")
def a11(spark, sf):
    m = M.weighted_metrics(V(spark, sf, "v_scored"))
    return m.select(*[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "n")


@register("a12_batch_mean_metrics", f"""WITH {_cls_sql(True)}
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
       round(avg(accuracy), 6) AS accuracy, count(*) AS n_batches FROM m""")
def a12(spark, sf):
    m = M.batch_mean_metrics(V(spark, sf, "v_scored"))
    return m.select(*[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "n_batches")


_LOGIT_SQL = """lg AS (SELECT vec_id, actual, batch_id, generate_subscripts(logits, 1) - 1 AS i,
                   CAST(unnest(logits) AS DOUBLE) AS x FROM v_scored),
mx AS (SELECT vec_id, max(x) AS m FROM lg GROUP BY vec_id),
ls AS (SELECT lg.vec_id, any_value(lg.actual) AS actual, any_value(lg.batch_id) AS batch_id, any_value(mx.m) AS m,
              sum(exp(lg.x - mx.m)) AS se, max(CASE WHEN lg.i = lg.actual THEN lg.x END) AS xt,
              min(CASE WHEN lg.x = mx.m THEN lg.i END) AS amax
       FROM lg JOIN mx ON lg.vec_id = mx.vec_id GROUP BY lg.vec_id),
lo AS (SELECT vec_id, actual, batch_id, amax, m + ln(se) - xt AS loss FROM ls)"""


@register("m3_argmax", f"WITH {_LOGIT_SQL} SELECT vec_id, CAST(amax AS INTEGER) AS argmax FROM lo")
def m3(spark, sf):
    return V(spark, sf, "v_scored").select("vec_id", M.argmax(F.col("logits")).alias("argmax"))


@register("m4_cross_entropy", f"WITH {_LOGIT_SQL} SELECT vec_id, round(loss, 6) AS loss FROM lo")
def m4(spark, sf):
    s = V(spark, sf, "v_scored")
    return s.select("vec_id", r6(M.cross_entropy(F.col("logits"), F.col("actual"))).alias("loss"))


@register("m2_softmax_percent", f"""WITH {_LOGIT_SQL},
pc AS (SELECT lg.vec_id, lg.i, CAST(round_even(exp(lg.x - ls.m) / ls.se * 100, 0) AS INTEGER) AS pct
       FROM lg JOIN ls ON lg.vec_id = ls.vec_id)
SELECT vec_id, string_agg(CAST(pct AS VARCHAR), ',' ORDER BY i) AS percent FROM pc GROUP BY vec_id""")
def m2(spark, sf):
    return V(spark, sf, "v_scored").select("vec_id", ints(M.softmax_percent(F.col("logits"))).alias("percent"))


@register("a13_accuracy", f"""WITH {_LOGIT_SQL}
SELECT round(avg(CASE WHEN amax = actual THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM lo""")
def a13(spark, sf):
    s = C.scored_rows(V(spark, sf, "v_scored"))
    return M.accuracy(s, "actual", "argmax").select(r6(F.col("accuracy")).alias("accuracy"), "n")


@register("a14_mean_loss", f"WITH {_LOGIT_SQL} SELECT round(avg(loss), 6) AS mean_loss, round(avg(loss) / ln(2), 6) AS bpc FROM lo")
def a14(spark, sf):
    s = C.scored_rows(V(spark, sf, "v_scored"))
    return M.mean_loss(s).select(r6(F.col("mean_loss")).alias("mean_loss"), r6(F.col("bpc")).alias("bpc"))


@register("a14_batch_mean_loss", f"""WITH {_LOGIT_SQL}
SELECT round(avg(l), 6) AS batch_mean_loss FROM (SELECT avg(loss) AS l FROM lo GROUP BY batch_id)""")
def a14_batches(spark, sf):
    """A14 as the evaluation loss: the mean of the batches' mean losses."""
    s = C.scored_rows(V(spark, sf, "v_scored")).groupBy("batch_id").agg(F.avg("loss").alias("loss"))
    return M.mean_of_batch_losses(s).select(r6(F.col("batch_mean_loss")).alias("batch_mean_loss"))


G7_SQL = f"""WITH {_LOGIT_SQL}, {_cls_sql(False)},
bm AS (SELECT * FROM (WITH {_cls_sql(True)} SELECT avg(precision) AS p, avg(recall) AS r, avg(f1) AS f, avg(accuracy) AS a FROM m))
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'test_precision' AS metric, precision AS value FROM m UNION ALL
  SELECT 'test_recall', recall FROM m UNION ALL SELECT 'test_f1', f1 FROM m UNION ALL
  SELECT 'test_accuracy', accuracy FROM m UNION ALL
  SELECT 'test_batch_precision', p FROM bm UNION ALL SELECT 'test_batch_recall', r FROM bm UNION ALL
  SELECT 'test_batch_f1', f FROM bm UNION ALL SELECT 'test_batch_accuracy', a FROM bm UNION ALL
  SELECT 'test_mean_loss', avg(loss) FROM lo UNION ALL SELECT 'test_bpc', avg(loss) / ln(2) FROM lo UNION ALL
  SELECT 'test_batch_mean_loss', avg(l) FROM (SELECT avg(loss) AS l FROM lo GROUP BY batch_id))"""


@register("g7_evaluate", G7_SQL)
def g7(spark, sf):
    out = C.evaluate(V(spark, sf, "v_scored"))
    return out.select("metric", r6(F.col("value")).alias("value"))


# --------------------------------------------------------------------------- sequences (Q, A15, G5, G8)

@register("q1_tokenize", f"SELECT doc_id, array_to_string({tok_sql('text')}, ' ') AS tokens FROM documents")
def q1(spark, sf):
    d = tbl(spark, sf, "documents")
    return d.select("doc_id", F.array_join(Q.tokenize(F.col("text")), " ").alias("tokens"))


@register("a15_vocab", f"""
WITH t AS (SELECT unnest({tok_sql('text')}) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + 5 AS INTEGER) AS id FROM c""")
def a15(spark, sf):
    d = tbl(spark, sf, "documents").select(Q.tokenize(F.col("text")).alias("tokens"))
    return Q.build_vocab(d, "tokens")


PAIR_CTES = f"""pt AS (SELECT pair_id, split, gold_label, {tok_sql('sentence1')} AS a, {tok_sql('sentence2')} AS b FROM v_pairs),
ptok AS (SELECT unnest(list_concat(a, b)) AS token FROM pt WHERE split = 'train'),
pvoc AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 + 5 AS id
         FROM (SELECT token, count(*) AS n FROM ptok GROUP BY token)),
pae AS (SELECT pair_id, generate_subscripts(a, 1) AS pos, unnest(a) AS token FROM pt),
pbe AS (SELECT pair_id, generate_subscripts(b, 1) AS pos, unnest(b) AS token FROM pt),
pa AS (SELECT pair_id, list(CAST(coalesce(v.id, 1) AS INTEGER) ORDER BY pos) AS ids FROM pae LEFT JOIN pvoc v ON pae.token = v.token GROUP BY pair_id),
pb AS (SELECT pair_id, list(CAST(coalesce(v.id, 1) AS INTEGER) ORDER BY pos) AS ids FROM pbe LEFT JOIN pvoc v ON pbe.token = v.token GROUP BY pair_id),
pf AS (SELECT pt.pair_id, pt.split, pt.gold_label, coalesce(pa.ids, []::INTEGER[]) AS a_ids, coalesce(pb.ids, []::INTEGER[]) AS b_ids,
              len(coalesce(pa.ids, [])) AS la, len(coalesce(pb.ids, [])) AS lb
       FROM pt LEFT JOIN pa ON pt.pair_id = pa.pair_id LEFT JOIN pb ON pt.pair_id = pb.pair_id)"""


def _pair_ids(spark, sf, **bound):
    pairs = V(spark, sf, "v_pairs")
    tok = pairs.select("pair_id", "split", "gold_label", Q.tokenize(F.col("sentence1")).alias("a"),
                       Q.tokenize(F.col("sentence2")).alias("b"))
    vocab = Q.build_vocab(tok.where(F.col("split") == "train").select(F.concat("a", "b").alias("tokens")), "tokens")
    return Q.encode(tok, "pair_id", ["a", "b"], vocab, **bound)


def _arr_sql(x: str) -> str:
    return f"array_to_string({x}, ',')"


@register("q2_encode", f"WITH {PAIR_CTES} SELECT pair_id, {_arr_sql('a_ids')} AS a_ids, {_arr_sql('b_ids')} AS b_ids FROM pf")
def q2(spark, sf):
    e = _pair_ids(spark, sf)
    return e.select("pair_id", ints(F.col("a_ids")).alias("a_ids"), ints(F.col("b_ids")).alias("b_ids"))


@register("q3_truncate", f"WITH {PAIR_CTES} SELECT pair_id, {_arr_sql('list_slice(a_ids, 1, 30)')} AS ids FROM pf")
def q3(spark, sf):
    e = _pair_ids(spark, sf)
    return e.select("pair_id", ints(Q.truncate(F.col("a_ids"), 32, 2)).alias("ids"))


@register("q2_encode_large", f"WITH {PAIR_CTES} SELECT pair_id, {_arr_sql('a_ids')} AS a_ids, {_arr_sql('b_ids')} AS b_ids FROM pf")
def q2_large(spark, sf):
    """Q2 where the vocabulary exceeds the broadcast bound: head in place, distinct misses through the tail join."""
    e = _pair_ids(spark, sf, head_bytes=2000)
    return e.select("pair_id", ints(F.col("a_ids")).alias("a_ids"), ints(F.col("b_ids")).alias("b_ids"))


_Q4 = 61


@register("q4_truncate_pair", f"""WITH {PAIR_CTES}
SELECT pair_id, {_arr_sql(f'list_slice(a_ids, 1, CASE WHEN la + lb > {_Q4} THEN least(la, greatest({_Q4} - lb, {(_Q4 + 1) // 2})) ELSE la END)')} AS a,
       {_arr_sql(f'list_slice(b_ids, 1, CASE WHEN la + lb > {_Q4} THEN least(lb, greatest({_Q4} - la, {_Q4 // 2})) ELSE lb END)')} AS b FROM pf""")
def q4(spark, sf):
    e = _pair_ids(spark, sf)
    a, b = Q.truncate_pair(F.col("a_ids"), F.col("b_ids"), _Q4)
    return e.select("pair_id", ints(a).alias("a"), ints(b).alias("b"))


@register("q6_pad", f"WITH {PAIR_CTES} SELECT pair_id, {_arr_sql('list_resize(list_slice(a_ids, 1, 30), 32, 0)')} AS ids FROM pf")
def q6(spark, sf):
    e = _pair_ids(spark, sf)
    return e.select("pair_id", ints(Q.pad(Q.truncate(F.col("a_ids"), 32, 2), 32)).alias("ids"))


@register("q6_pad_longest", f"""WITH {PAIR_CTES},
b AS (SELECT pair_id, list_slice(a_ids, 1, 40) AS ids, ascii(right(md5(pair_id), 1)) AS batch_id FROM pf)
SELECT pair_id, {_arr_sql('list_resize(ids, max(len(ids)) OVER (PARTITION BY batch_id), 0)')} AS ids FROM b""")
def q6_longest(spark, sf):
    """Q6, longest mode: each batch padded to its longest row (at most 40)."""
    e = _pair_ids(spark, sf).withColumn("batch_id", F.ascii(F.substring(F.md5("pair_id"), 32, 1)))
    return Q.pad_longest(e, "a_ids", max_len=40).select("pair_id", ints(F.col("input_ids")).alias("ids"))


@register("q7_only_first", f"WITH {PAIR_CTES} SELECT pair_id, {_arr_sql(f'list_slice(a_ids, 1, greatest({_Q4} - lb, 0))')} AS a FROM pf")
def q7(spark, sf):
    e = _pair_ids(spark, sf)
    return e.select("pair_id", ints(Q.truncate_only_first(F.col("a_ids"), F.col("b_ids"), _Q4)).alias("a"))


@register("q8_length_mask", f"""WITH {PAIR_CTES}
SELECT pair_id, {_arr_sql('list_resize(list_resize([]::INTEGER[], least(la, 64), 1), 64, 0)')} AS mask FROM pf""")
def q8(spark, sf):
    e = _pair_ids(spark, sf)
    return e.select("pair_id", ints(Q.length_mask(F.size("a_ids"), 64)).alias("mask"))


_Q5_L = 128


def _q5_sql(_Q5_L: int = _Q5_L) -> str:
    m = _Q5_L - 3
    return f"""WITH {PAIR_CTES},
tr AS (SELECT *, CASE WHEN lb = 0 THEN least(la, {_Q5_L - 2})
                      WHEN la + lb > {m} THEN least(la, greatest({m} - lb, {(m + 1) // 2})) ELSE la END AS na,
                 CASE WHEN lb = 0 THEN 0 WHEN la + lb > {m} THEN least(lb, greatest({m} - la, {m // 2})) ELSE lb END AS nb FROM pf),
fx AS (SELECT *, [2] || list_slice(a_ids, 1, na) || [3] AS first,
              CASE WHEN lb > 0 THEN list_slice(b_ids, 1, nb) || [3] ELSE []::INTEGER[] END AS second FROM tr)
SELECT pair_id, split, gold_label,
       CASE gold_label WHEN 'contradiction' THEN 0 WHEN 'entailment' THEN 1 WHEN 'neutral' THEN 2 END AS label_id,
       {_arr_sql(f'list_resize(first || second, {_Q5_L}, 0)')} AS input_ids,
       {_arr_sql(f'list_resize(list_resize(list_resize([]::INTEGER[], len(first), 0), len(first) + len(second), 1), {_Q5_L}, 0)')} AS segment_ids,
       {_arr_sql(f'list_resize(list_resize([]::INTEGER[], len(first) + len(second), 1), {_Q5_L}, 0)')} AS input_mask,
       CAST(la + lb AS INTEGER) AS seq_len
FROM fx"""


def g5_query(spark, sf):
    feats, _ = C.pair_dataset(V(spark, sf, "v_pairs"), max_len=_Q5_L)
    return feats.select("pair_id", "split", "gold_label", "label_id", ints(F.col("input_ids")).alias("input_ids"),
                        ints(F.col("segment_ids")).alias("segment_ids"), ints(F.col("input_mask")).alias("input_mask"),
                        "seq_len")


@register("q5_pair_features", f"SELECT pair_id, input_ids, segment_ids, input_mask, seq_len FROM ({_q5_sql(48)})")
def q5(spark, sf):
    """Q5 by itself, with sequences short enough that both sides are cut."""
    f = Q.pair_features(_pair_ids(spark, sf), "a_ids", "b_ids", 48)
    return f.select("pair_id", ints(F.col("input_ids")).alias("input_ids"), ints(F.col("segment_ids")).alias("segment_ids"),
                    ints(F.col("input_mask")).alias("input_mask"), "seq_len")


register("g5_pair_dataset", _q5_sql())(g5_query)


_LINES_CTES = f"""ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
                  unnest(string_split(text, chr(10))) AS line FROM documents),
lk AS (SELECT doc_id, line_no, {tok_sql('line')} AS t FROM ln
       WHERE length(line) > 10 AND trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''),
lv AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 + 5 AS id
       FROM (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM lk) GROUP BY token)),
le AS (SELECT doc_id, line_no, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM lk),
li AS (SELECT lk.doc_id, lk.line_no, coalesce(list(CAST(v.id AS INTEGER) ORDER BY le.pos) FILTER (WHERE le.pos IS NOT NULL), []::INTEGER[]) AS ids
       FROM lk LEFT JOIN le ON lk.doc_id = le.doc_id AND lk.line_no = le.line_no LEFT JOIN lv v ON le.token = v.token
       GROUP BY lk.doc_id, lk.line_no)"""


@register("q10_line_blocks", f"""WITH {_LINES_CTES}
SELECT doc_id, line_no, {_arr_sql('list_resize([2] || list_slice(ids, 1, 30) || [3], 32, 0)')} AS input_ids FROM li""")
def q10(spark, sf):
    from clinloom.operators.filters import corpus_lines
    d = tbl(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn(
        "line_no", (F.col("line_no") + 1).cast("bigint"))
    lines = corpus_lines(lines, "line").select("doc_id", "line_no", Q.tokenize(F.col("line")).alias("t"))
    vocab = Q.build_vocab(lines, "t")
    ids = Q.encode(lines, ["doc_id", "line_no"], ["t"], vocab)
    out = Q.line_blocks(ids, "t_ids", 32)
    return out.select("doc_id", "line_no", ints(F.col("input_ids")).alias("input_ids"))


_G8_BLOCK = 64


def _g8_sql(final: str) -> str:
    size = _G8_BLOCK - 2
    return f"""WITH {G2_CTES},
g8d AS (SELECT md5(text) AS k, {tok_sql('text')} AS t FROM g2 WHERE split = 'train'),
g8t AS (SELECT k, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM g8d),
g8v AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + 5 AS INTEGER) AS id
        FROM (SELECT token, count(*) AS n FROM g8t GROUP BY token)),
g8g AS (SELECT v.id, row_number() OVER (ORDER BY g8t.k, g8t.pos) - 1 AS g FROM g8t JOIN g8v v ON g8t.token = v.token),
g8b AS (SELECT g // {size} AS block_id, [2] || list(id ORDER BY g) || [3] AS ids FROM g8g GROUP BY g // {size}
        HAVING count(*) = {size}),
g8e AS (SELECT block_id, generate_subscripts(ids, 1) - 1 AS i, unnest(ids) AS x FROM g8b),
g8h AS (SELECT block_id, i, x, (('0x' || substr(md5('42|' || CAST(block_id AS VARCHAR)), 1, 7))::BIGINT + (i + 1) * 48271) % 2147483647 AS a FROM g8e),
g8k AS (SELECT block_id, i, x, (a * a + 12345) % 2147483647 AS b FROM g8h),
g8s AS (SELECT block_id, i, x, (b * b + i) % 2147483647 AS u FROM g8k),
g8u AS (SELECT block_id, i, x, u, (u * 48271) % 2147483647 AS v, ((u * 48271) % 2147483647 * 69621) % 2147483647 AS r FROM g8s),
g8m AS (SELECT block_id,
          string_agg(CAST(CASE WHEN NOT (u < {int(0.15 * 2147483647)} AND x >= 5) THEN x WHEN v < {int(0.8 * 2147483647)} THEN 4
                               WHEN v < {int(0.9 * 2147483647)} THEN 5 + r % ((SELECT max(id) + 1 FROM g8v) - 5) ELSE x END AS VARCHAR), ',' ORDER BY i) AS masked_ids,
          string_agg(CAST(CASE WHEN u < {int(0.15 * 2147483647)} AND x >= 5 THEN x ELSE -100 END AS VARCHAR), ',' ORDER BY i) AS labels
        FROM g8u GROUP BY block_id)
{final}"""


def _g8(spark, sf, mask):
    corpus = g2_corpus(spark, sf).where(F.col("split") == "train").select("text")
    blocks, _ = G.pretraining_blocks(corpus, block=_G8_BLOCK, mask=mask)
    return blocks


@register("q9_pack_blocks", _g8_sql(f"SELECT block_id, {_arr_sql('ids')} AS input_ids FROM g8b"))
def q9(spark, sf):
    return _g8(spark, sf, False).select("block_id", ints(F.col("input_ids")).alias("input_ids"))


def g8_query(spark, sf):
    b = _g8(spark, sf, True)
    return b.select("block_id", ints(F.col("input_ids")).alias("input_ids"), ints(F.col("masked_ids")).alias("masked_ids"),
                    ints(F.col("labels")).alias("labels"))


_G8_FINAL = f"""SELECT g8b.block_id, {_arr_sql('g8b.ids')} AS input_ids, g8m.masked_ids, g8m.labels
FROM g8b JOIN g8m ON g8b.block_id = g8m.block_id"""
register("g8_pretraining_blocks", _g8_sql(_G8_FINAL))(g8_query)


# --------------------------------------------------------------------------- embeddings (M1, M5, M6), hook

@register("m1_mean_pool", """
WITH e AS (SELECT doc, NOT is_pad AS real, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v FROM v_token_vectors),
d AS (SELECT doc, dim, sum(CASE WHEN real THEN CAST(v AS DOUBLE) ELSE 0.0 END) AS s, count_if(real) AS nt FROM e GROUP BY doc, dim)
SELECT doc, CAST(dim AS INTEGER) AS dim, round(CASE WHEN nt > 0 THEN s / nt END, 6) AS value, CAST(nt AS BIGINT) AS n_tokens FROM d""")
def m1(spark, sf):
    pooled = EM.mean_pool(V(spark, sf, "v_token_vectors"))
    return pooled.select("doc", F.posexplode("pooled").alias("dim", "value"), "n_tokens").select(
        "doc", "dim", r6(F.col("value")).alias("value"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


@register("m1_mean_pool_padded", """
WITH e AS (SELECT doc, NOT is_pad AS real, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v FROM v_token_vectors),
d AS (SELECT doc, dim, sum(CASE WHEN real THEN CAST(v AS DOUBLE) ELSE 0.0 END) AS s, count(*) AS na FROM e GROUP BY doc, dim)
SELECT doc, CAST(dim AS INTEGER) AS dim, round(s / na, 6) AS value FROM d""")
def m1p(spark, sf):
    pooled = EM.mean_pool(V(spark, sf, "v_token_vectors"), denominator="padded")
    return pooled.select("doc", F.posexplode("pooled").alias("dim", "value")).select(
        "doc", "dim", r6(F.col("value")).alias("value"))


def _head_data(spark, sf):
    e = tbl(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return U.split_hash(e, "vec_id", 3, (("train", 0.8), ("test", 0.2)))


_HEAD_SPLIT_SQL = """hs AS (SELECT vec_id, label, ('0x' || substr(md5('3|' || CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT
       / 4294967296.0 < 0.8 AS train FROM embeddings)"""


def _head_facts(spark, sf, kind, grid):
    """What must hold of a trained head: size of the test part, classes, valid predictions, and a
    training fit no worse than the majority class."""
    data = _head_data(spark, sf)
    train, test = (data.where(F.col("split") == s) for s in ("train", "test"))
    model = EM.train_head(train, "embedding", "label", kind=kind, grid=grid)
    known = EM.predict(test, model, "embedding").join(
        data.select(F.col("label").alias("predicted")).distinct().withColumn("_known", F.lit(True)), "predicted", "left")
    right = EM.predict(train, model, "embedding")
    most = train.groupBy("label").count().agg(F.max("count")).first()[0]
    hits = right.where(F.col("predicted") == F.col("label")).count()
    return (known.agg(F.count(F.lit(1)).alias("n_test"), F.count("_known").alias("n_known"))
            .withColumn("classes", F.lit(data.select("label").distinct().count()).cast("bigint"))
            .withColumn("beats_majority", F.lit(hits >= most)).withColumn("head", F.lit(kind)))


def _head_facts_sql(kind: str) -> str:
    return f"""WITH {_HEAD_SPLIT_SQL}
SELECT count(*) AS n_test, count(*) AS n_known, (SELECT count(DISTINCT label) FROM embeddings) AS classes,
       true AS beats_majority, '{kind}' AS head FROM hs WHERE NOT train"""


@register("m6_train_head", _head_facts_sql("logistic"))
def m6(spark, sf):
    """M6 with the linear head: a grid over regularisation and iterations."""
    return _head_facts(spark, sf, "logistic", {"regParam": [0.0, 0.01], "maxIter": [10, 30]})


@register("m6_train_head_mlp", _head_facts_sql("mlp"))
def m6_mlp(spark, sf):
    """M6 with the two-layer head: a grid over iterations, step and block size."""
    return _head_facts(spark, sf, "mlp", {"maxIter": [20, 40], "stepSize": [0.03, 0.1], "blockSize": [64, 128]})


@register("m6_tanh_head_grid", f"""WITH {_HEAD_SPLIT_SQL}
SELECT 18 AS n_runs, 1 AS n_best, count(*) AS n_test, count(*) AS n_known, (SELECT count(DISTINCT label) FROM embeddings) AS classes,
       true AS beats_majority FROM hs WHERE NOT train""")
def m6_tanh(spark, sf):
    """M6 with the tanh head: eighteen runs (epochs x rate x batch) trained together, compared on the
    training part in one pass; facts of the best one.  Rates are those for a head on frozen vectors."""
    data = _head_data(spark, sf)
    train, test = (data.where(F.col("split") == s) for s in ("train", "test"))
    heads = HEAD.train_heads(train, "embedding", "label", "vec_id", HEAD.grid(rates=(2e-3, 3e-3, 5e-3)),
                             classes=data.agg(F.max("label")).first()[0] + 1)
    runs = HEAD.compare_runs(train, heads, "embedding", "label")
    rows = runs.collect()
    best = next(r for r in rows if r["best"])
    most = train.groupBy("label").count().agg(F.max("count")).first()[0]
    scored = HEAD.predict_head(test.select("vec_id", "embedding"), heads[HEAD.Run(best["epochs"], best["rate"], best["batch"])],
                               "embedding")
    known = scored.join(data.select(F.col("label").alias("predicted")).distinct().withColumn("_known", F.lit(True)),
                        "predicted", "left")
    return (known.agg(F.count(F.lit(1)).alias("n_test"), F.count("_known").alias("n_known"))
            .withColumn("n_runs", F.lit(len(rows))).withColumn("n_best", F.lit(sum(r["best"] for r in rows)))
            .withColumn("classes", F.lit(data.select("label").distinct().count()).cast("bigint"))
            .withColumn("beats_majority", F.lit(round(best["accuracy"] * best["rows"]) >= most)))


@register("m5_predict", f"""WITH {_HEAD_SPLIT_SQL}
SELECT vec_id, label, true AS known, true AS named FROM hs WHERE NOT train""")
def m5(spark, sf):
    """M5: every test row gets a known class and that class's name."""
    data = _head_data(spark, sf)
    model = EM.train_head(data.where(F.col("split") == "train"), "embedding", "label")
    names = L.fit_labels(data.select(F.concat(F.lit("L"), F.lpad(F.col("label").cast("string"), 6, "0")).alias("label")))
    scored = EM.predict(data.where(F.col("split") == "test"), model, "embedding")
    out = L.decode_labels(scored, names, "predicted")
    name = F.concat(F.lit("L"), F.lpad(F.col("predicted").cast("string"), 6, "0"))
    return out.select("vec_id", "label", F.col("predicted_label").isNotNull().alias("known"),
                      F.coalesce(F.col("predicted_label") == name, F.lit(False)).alias("named"))


@register("f3_tokenizer_hook", r"""
SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0
                    ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS n_words FROM documents""")
def f3(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", "text")
    out = apply_tokenizer(d, "text", whitespace_tokenizer)
    return out.select("doc_id", F.size("tokens").cast("bigint").alias("n_words"))


@register("u6_shuffle", f"""
SELECT pair_id, row_number() OVER (ORDER BY {_u_sql('pair_id', '42|1')}, pair_id) - 1 AS position FROM v_pairs""")
def u6(spark, sf):
    """The order of epoch 1 (a different permutation from epoch 0)."""
    out = U.assign_batches(V(spark, sf, "v_pairs").select("pair_id"), 16, "pair_id", seed=42, epoch=1)
    return out.select("pair_id", "position")


@register("f2_concat_aggregate", """
SELECT hadm_id, string_agg(text, ' ' ORDER BY row_id) AS text FROM v_notes WHERE hadm_id IS NOT NULL GROUP BY hadm_id""")
def f2(spark, sf):
    """the custom ' '.join aggregate, as an ordered collect + array_join expression."""
    n = V(spark, sf, "v_notes").where(F.col("hadm_id").isNotNull())
    return A.concat_by_admission(n.withColumn("category", F.lit("")), "hadm_id", "row_id", "text").select("hadm_id", "text")


@register("f5_batched_map", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def f5(spark, sf):
    from clinloom.operators.hooks import apply_batches, char_count_batch
    d = tbl(spark, sf, "documents").select("doc_id", "text")
    return apply_batches(d, char_count_batch, "doc_id long, n_chars long")


@register("q9_pack_blocks_doc_order", f"""
WITH t AS (SELECT doc_id, {tok_sql('text')} AS tk FROM documents),
e AS (SELECT doc_id, generate_subscripts(tk, 1) AS pos, unnest(tk) AS token FROM t),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + 5 AS INTEGER) AS id
      FROM (SELECT token, count(*) AS n FROM e GROUP BY token)),
g AS (SELECT v.id, row_number() OVER (ORDER BY e.doc_id, e.pos) - 1 AS g FROM e JOIN v ON e.token = v.token),
b AS (SELECT g // 62 AS block_id, [2] || list(id ORDER BY g) || [3] AS ids FROM g GROUP BY g // 62 HAVING count(*) = 62)
SELECT block_id, array_to_string(ids, ',') AS input_ids FROM b""")
def q9_doc(spark, sf):
    """Q9 in document-id order (not a hash): offsets from the range-partitioned rank with
    its per-partition prefix sums."""
    d = tbl(spark, sf, "documents").select("doc_id", Q.tokenize(F.col("text")).alias("tokens"))
    vocab = Q.build_vocab(d, "tokens")
    ids = Q.encode(d, "doc_id", ["tokens"], vocab)
    blocks = Q.pack_blocks(ids, "doc_id", "tokens_ids", 64)
    return blocks.select("block_id", ints(F.col("input_ids")).alias("input_ids"))


@register("q11_mask_tokens", f"""
WITH t AS (SELECT doc_id, {tok_sql('text')} AS tk FROM documents),
e AS (SELECT doc_id, generate_subscripts(tk, 1) - 1 AS i, unnest(tk) AS token FROM t),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + 5 AS INTEGER) AS id
      FROM (SELECT token, count(*) AS n FROM e GROUP BY token)),
x AS (SELECT e.doc_id, e.i, v.id AS x, (('0x' || substr(md5('7|' || CAST(e.doc_id AS VARCHAR)), 1, 7))::BIGINT + (e.i + 1) * 48271) % 2147483647 AS a
      FROM e JOIN v ON e.token = v.token),
b AS (SELECT doc_id, i, x, (a * a + 12345) % 2147483647 AS b FROM x),
u AS (SELECT doc_id, i, x, (b * b + i) % 2147483647 AS u FROM b),
d AS (SELECT doc_id, i, x, u, (u * 48271) % 2147483647 AS v FROM u)
SELECT doc_id, string_agg(CAST(CASE WHEN u >= {int(0.3 * 2147483647)} THEN x WHEN v < {int(0.8 * 2147483647)} THEN 4
           WHEN v < {int(0.9 * 2147483647)} THEN 5 + (v * 69621) % 2147483647 % ((SELECT max(id) + 1 FROM v) - 5) ELSE x END AS VARCHAR), ',' ORDER BY i) AS masked_ids
FROM d GROUP BY doc_id""")
def q11(spark, sf):
    """Q11 by itself: whole documents masked at 30 %."""
    # tokenised once: the filter, the vocabulary and the encoding read the tokens
    d = materialise(tbl(spark, sf, "documents").select("doc_id", Q.tokenize(F.col("text")).alias("tokens")), "tokens")
    d = d.where(F.size("tokens") > 0)
    vocab = Q.build_vocab(d, "tokens")
    size = (vocab.agg(F.max("id")).first()[0] or 0) + 1
    out = Q.mask_tokens(Q.encode(d, "doc_id", ["tokens"], vocab), "tokens_ids", "doc_id", size, seed=7, p=0.3)
    return out.select("doc_id", ints(F.col("masked_ids")).alias("masked_ids"))
