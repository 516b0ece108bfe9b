"""M2-M4, A9-A14, E1-E6, L2-L3, M1, M6 on hand-made scores."""

import math

import pytest
from pyspark.sql import functions as F

from clinloom.operators import embeddings as EM
from clinloom.operators import labels as L
from clinloom.operators import metrics as M

SCORED = [  # (batch, actual, predicted)
    (0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 2, 2),
    (1, 1, 1), (1, 2, 0), (1, 2, 2), (1, 0, 0), (1, 1, 2),
]


def scored(spark):
    return spark.createDataFrame(SCORED, "batch_id int, actual int, predicted int")


def sk_weighted(rows):
    classes = sorted({a for _, a, _ in rows} | {p for _, _, p in rows})
    n = len(rows)
    prec = rec = f1 = 0.0
    for c in classes:
        tp = sum(1 for _, a, p in rows if a == c and p == c)
        sup = sum(1 for _, a, _ in rows if a == c)
        pred = sum(1 for _, _, p in rows if p == c)
        pc = tp / pred if pred else 0.0
        rc = tp / sup if sup else 0.0
        fc = 2 * pc * rc / (pc + rc) if pc + rc else 0.0
        prec += pc * sup / n
        rec += rc * sup / n
        f1 += fc * sup / n
    return prec, rec, f1


def test_weighted_metrics_and_recall_equals_accuracy(spark):
    r = M.weighted_metrics(scored(spark)).first()
    p, rc, f = sk_weighted(SCORED)
    assert r["precision"] == pytest.approx(p) and r["recall"] == pytest.approx(rc) and r["f1"] == pytest.approx(f)
    assert r["recall"] == pytest.approx(r["accuracy"])


def test_batch_mean_metrics(spark):
    r = M.batch_mean_metrics(scored(spark)).first()
    per = [sk_weighted([x for x in SCORED if x[0] == b]) for b in (0, 1)]
    assert r["f1"] == pytest.approx(sum(x[2] for x in per) / 2) and r["n_batches"] == 2


def test_confusion_normalised_half_even(spark):
    cm = M.confusion(spark.createDataFrame([(0, 0)] * 1 + [(0, 1)] * 7, "actual int, predicted int"))
    shares = {r["predicted"]: r["share"] for r in M.normalise_confusion(cm).collect()}
    assert shares == {0: 0.12, 1: 0.88}       # 0.125 -> 0.12 (half to even)


def test_dense_confusion_zero_fills(spark):
    labels = spark.createDataFrame([(0,), (1,), (2,)], "label_id int")
    dense = M.dense_confusion(M.confusion(scored(spark)), labels)
    assert dense.count() == 9 and dense.where("actual = 0 AND predicted = 2").first()["n"] == 0


def test_softmax_argmax_loss(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0], 1)], "l array<double>, y int")
    r = df.select(M.softmax(F.col("l")).alias("p"), M.argmax(F.col("l")).alias("a"),
                  M.cross_entropy(F.col("l"), F.col("y")).alias("ce"), M.softmax_percent(F.col("l")).alias("pc")).first()
    assert sum(r["p"]) == pytest.approx(1.0) and r["a"] == 1
    lse = math.log(sum(math.exp(x) for x in [1.0, 3.0, 3.0, -2.0]))
    assert r["ce"] == pytest.approx(lse - 3.0)
    assert abs(sum(r["pc"]) - 100) <= 2


def test_label_encoding(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "label string")
    fit = {r["label"]: r["label_id"] for r in L.fit_labels(df).collect()}
    assert fit == {"a": 0, "b": 1, "c": 2}
    lab = L.fixed_labels(spark, ("a", "b"))
    assert L.encode_labels(df, lab, on_unknown="drop").count() == 2
    assert L.encode_labels(df, lab, on_unknown="keep").where("label_id IS NULL").count() == 1
    with pytest.raises(Exception):
        L.encode_labels(df, lab, on_unknown="error").collect()


def test_top_labels_ties_and_multi_hot(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("z",), ("w",)], "label string")
    assert [r["label"] for r in L.top_labels(df, 2).collect()] == ["y", "w"]
    codes = spark.createDataFrame([(1, "y,w"), (2, "q"), (3, None)], "hadm_id int, codes string")
    table = L.fit_labels(spark.createDataFrame([("y",), ("w",), ("x",)], "label string"))
    got = {r["hadm_id"]: r["labels"] for r in L.multi_hot(codes, "codes", table).collect()}
    assert got == {1: [1, 0, 1], 2: [0, 0, 0], 3: [0, 0, 0]}


def test_dense_confusion_of_any_ids_and_null_predictions(spark):
    df = spark.createDataFrame([(3, 3), (3, 7), (7, 7), (7, None), (3, 9)], "actual int, predicted int")
    labels = spark.createDataFrame([(3,), (7,)], "label_id int")
    got = {(r["actual"], r["predicted"]): r["n"] for r in M.dense_confusion(M.confusion(df), labels).collect()}
    assert got == {(3, 3): 1, (3, 7): 1, (7, 3): 0, (7, 7): 1, (7, None): 1, (3, 9): 1}
    with pytest.raises(ValueError):
        M.dense_confusion(M.confusion(df), labels, max_labels=1)
    some = spark.createDataFrame([(1, 1), (2, 2), (1, None)], "actual int, predicted int")
    assert M.accuracy(some).first()["accuracy"] == pytest.approx(2 / 3)
    assert M.weighted_metrics(some).first()["accuracy"] == pytest.approx(2 / 3)


def test_study_times_of_any_length(spark):
    from clinloom.functions.dates import iso, study_timestamp
    df = spark.createDataFrame([("20200102", t) for t in ("03", "0315", "031545", "031545.5", "031545.1234567", None)],
                               "d string, t string")
    got = [r[0] for r in df.select(iso(study_timestamp(df.d, df.t))).collect()]
    day = "2020-01-02 "
    assert got == [day + "03:00:00.000000", day + "03:15:00.000000", day + "03:15:45.000000",
                   day + "03:15:45.500000", day + "03:15:45.123456", None]
    bad = spark.createDataFrame([("20200102", "3:15"), ("2020-1-2", "031500")], "d string, t string")
    with pytest.raises(Exception):
        bad.select(study_timestamp(bad.d, bad.t)).collect()
    assert bad.select(study_timestamp(bad.d, bad.t, "null").alias("x")).where("x IS NULL").count() == 2


def test_mean_pool_masks_padding(spark):
    rows = [(0, 0, False, [1.0, 2.0]), (0, 1, False, [3.0, 4.0]), (0, 2, True, [100.0, 100.0]), (1, 0, True, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "doc int, pos int, is_pad boolean, embedding array<float>")
    got = {r["doc"]: r["pooled"] for r in EM.mean_pool(df).collect()}
    assert got[0] == [2.0, 3.0] and got[1] == [None, None]
    padded = {r["doc"]: r["pooled"] for r in EM.mean_pool(df, denominator="padded").collect()}
    assert padded[0] == pytest.approx([4.0 / 3, 2.0])


def test_train_head_and_predict(spark):
    rows = [(i, [float(i % 2), float((i + 1) % 2)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int")
    model = EM.train_head(df, "v", "label", grid={"regParam": [0.0, 0.1]})
    pred = EM.predict(df, model, "v")
    assert pred.where("predicted = label").count() == 40


def test_weighted_metrics_match_mllib(spark):
    from pyspark.mllib.evaluation import MulticlassMetrics
    rows = [(0, a, p) for a, p in [(0, 0), (0, 1), (1, 1), (2, 2), (1, 2), (2, 0), (2, 2), (3, 1)]]
    df = spark.createDataFrame(rows, "batch_id int, actual int, predicted int")
    ours = M.weighted_metrics(df).first()
    ref = MulticlassMetrics(df.rdd.map(lambda r: (float(r["predicted"]), float(r["actual"]))))
    assert ours["precision"] == pytest.approx(ref.weightedPrecision)
    assert ours["recall"] == pytest.approx(ref.weightedRecall)
    assert ours["f1"] == pytest.approx(ref.weightedFMeasure())
    assert ours["accuracy"] == pytest.approx(ref.accuracy)


def test_length_profile_quantiles(spark):
    from clinloom.operators.aggregates import length_profile
    df = spark.createDataFrame([("a b c",), ("a",), ("a b",)], "text string")
    r = length_profile(df, quantiles=[0.5]).first()
    assert r["words_max"] == 3 and r["words_p50"] == 2 and r["chars_mean"] == pytest.approx(3.0)
