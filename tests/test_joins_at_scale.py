"""Hot keys of the many-to-many join, bitmap filters before the text shuffle, worker-held objects."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from clinloom.operators import joins as J
from clinloom.operators.worker import LIMIT, fresh_key, resident
from clinloom.plans import icd_dataset as G


def skewed():
    """One patient-day holds a third of all rows on both sides."""
    rnd = random.Random(2)
    days = [f"2110-01-{d:02d}" for d in range(1, 29)]
    orders = [(1, days[0], i) for i in range(600)] + [(rnd.randint(2, 200), rnd.choice(days), i) for i in range(600, 1800)]
    studies = [(1, days[0], f"s{i}") for i in range(300)] + [(rnd.randint(2, 200), rnd.choice(days), f"s{i}") for i in range(300, 900)]
    return orders + [(None, days[0], -1), (1, None, -2)], studies + [(None, days[0], "n"), (1, days[0], "s0")]


@pytest.mark.parametrize("pairs", [1, 50, 5000, 1 << 40])
def test_salted_join_equals_plain(spark, pairs):
    o, s = skewed()
    left = spark.createDataFrame(o, "subject_id int, day string, hadm_id int")
    right = spark.createDataFrame(s, "subject_id int, day string, study_id string")
    out = J.link_same_day(left, right, pairs=pairs)
    plain = left.join(right, ["subject_id", "day"])
    assert out.columns == plain.columns
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(map(tuple, plain.collect()))


def test_no_task_above_five_medians(spark):
    """Pairs by the cell that writes them: the hot patient-day is spread as evenly as the rest."""
    o, s = skewed()
    left = spark.createDataFrame(o, "subject_id int, day string, hadm_id int")
    right = spark.createDataFrame(s, "subject_id int, day string, study_id string")
    hot = {(r.subject_id, r.day): (r._a, r._b) for r in J.hot_keys(left, right, ["subject_id", "day"], 2500).collect()}
    assert hot == {(1, "2110-01-01"): (12, 7)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")

        def sizes(df):
            per = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            return sorted(r["count"] for r in per)
        spread = sizes(J.link_same_day(left, right, pairs=2500))
        plain = sizes(left.join(right, ["subject_id", "day"]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert spread[-1] <= 5 * spread[len(spread) // 2]
    assert plain[-1] > 5 * plain[len(plain) // 2]


def test_one_sided_hot_key(spark):
    left = spark.createDataFrame([(1, i) for i in range(1000)], "k int, a int")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, b string")
    row = J.hot_keys(left, right, ["k"], 100).first()
    assert row._a == 20 and row._b == 1
    assert J.salted_join(left, right, ["k"], 100).distinct().count() == 2000


def test_bitmap_keeps_every_match(spark):
    df = spark.createDataFrame([(i if i % 7 else None, str(i)) for i in range(3000)], "k long, v string")
    keys = df.where("k % 3 = 0").select("k")
    kept = J.might_hold(df, "k", J.key_bitmap(keys, "k", 20), 20)
    got = {r.k for r in kept.collect()}
    want = {r.k for r in keys.collect()} - {None}
    assert want <= got and None not in got and len(got) < len(want) + 40
    assert kept.columns == df.columns
    assert J.might_hold(df, "k", J.key_bitmap(keys.limit(0), "k")).count() == 0


def _notes(spark):
    rows = [(i, i % 40 if i % 9 else None, "Radiology", f"note {i % 150}") for i in range(600)]
    notes = spark.createDataFrame(rows, "row_id long, hadm_id long, category string, text string")
    diag = spark.createDataFrame([(h, 1, f"D{h}") for h in range(0, 40, 2)], "hadm_id long, seq_num int, icd9_code string")
    proc = spark.createDataFrame([(h, 1, f"P{h}") for h in range(0, 40, 3)], "hadm_id long, seq_num int, icd9_code string")
    return notes, diag, proc


@pytest.mark.parametrize("both", [True, False])
def test_g1_prunes_notes_before_the_shuffle(spark, monkeypatch, both):
    notes, diag, proc = _notes(spark)
    params = G.IcdParams(note_category="Radiology", require_both=both)
    kept = []
    thin = G.thin_notes
    monkeypatch.setattr(G, "thin_notes", lambda n, *a: kept.append((n, thin(n, *a))) or kept[-1][1])
    pruned = sorted(map(tuple, G.icd_labelled(notes, diag, proc, params, cleaned=True).collect()))
    monkeypatch.setattr(G, "thin_notes", lambda n, *a: n)
    assert pruned == sorted(map(tuple, G.icd_labelled(notes, diag, proc, params, cleaned=True).collect()))
    before, after = (x.agg(F.sum(F.octet_length("text"))).first()[0] for x in kept[0])
    assert pruned and after < before / 4                          # duplicates and admissions without codes go


def test_worker_objects_are_keyed_per_call():
    first, second = fresh_key(), fresh_key()
    assert first != second
    assert resident(first, lambda: 1) == 1 and resident(second, lambda: 2) == 2 and resident(first, lambda: 3) == 1
    for _ in range(LIMIT):
        resident(fresh_key(), object)
    assert resident(second, lambda: 4) == 4                       # only the latest are kept


def test_hook_of_another_call_is_another_function(spark):
    from clinloom.operators.hooks import apply_tokenizer
    df = spark.createDataFrame([("a b c",)], "text string").repartition(1)
    out = []
    for sep in ("a", "b", "c"):
        def factory(sep=sep):
            return lambda t: t.split(sep)
        out.append(apply_tokenizer(df, "text", factory).first().tokens)
        del factory
    assert out == [["", " b c"], ["a ", " c"], ["a b ", ""]]
