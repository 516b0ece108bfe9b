"""Bucketed tables, checks collected in the pass, stateless operators on a stream."""

import uuid

import pytest
from pyspark.sql import functions as F

from clinloom.operators import filters as P
from clinloom.operators import joins as J
from clinloom.operators import labels as L
from clinloom.sources.sinks import write_bucketed
from clinloom.streaming import on_files, write_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labelled_admissions_from_buckets_need_no_exchange(spark, tmp_path, shuffled_joins):
    notes = spark.createDataFrame([(i, f"note {i}", "Radiology") for i in range(200)] + [(None, "x", "y")],
                                  "hadm_id long, text string, category string")
    diag = spark.createDataFrame([(i, f"d{i}") for i in range(0, 200, 2)], "hadm_id long, codes string")
    proc = spark.createDataFrame([(i, f"p{i}") for i in range(0, 200, 3)], "hadm_id long, codes string")
    want = J.labelled_admissions(notes, diag, proc)
    assert "Exchange" in plan(want)
    kept = [write_bucketed(df, f"b{uuid.uuid4().hex}", ["hadm_id"], 4, str(tmp_path / name))
            for name, df in (("notes", notes), ("diag", diag), ("proc", proc))]
    got = J.labelled_admissions(*kept)
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 34
    assert len(list((tmp_path / "notes").glob("part-*.parquet"))) <= 4          # a bucket is one file
    counts = kept[0].groupBy("hadm_id").count()
    assert "Exchange" not in plan(counts)


def test_bucketed_table_of_no_rows_and_replaced(spark, tmp_path):
    name = f"b{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "k long, v string")
    assert write_bucketed(df, name, ["k"], 3, str(tmp_path / "t")).count() == 3
    assert write_bucketed(df.limit(0), name, ["k"], 3, str(tmp_path / "t")).count() == 0


def test_checks_are_collected_while_rows_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (None, "")], "id long, text string")
    checks = {"has_id": F.col("id").isNotNull(), "has_text": F.length("text") > 0, "any": F.lit(True)}
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    seen, report = P.observed_expectations(df.mapInArrow(counted, df.schema), checks)
    seen.write.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, report().collect())) == sorted(map(tuple, P.expectations(df, checks).collect()))
    assert reads.value == 4                                                     # every row was read once
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(AssertionError, match="has_id=2"):
        P.assert_expectations(report())
    empty, report = P.observed_expectations(df.limit(0), checks)
    assert empty.count() == 0 and all(r.passed and r.observed == 0 for r in report().collect())


def steps(spark):
    ann = spark.createDataFrame([(2, 1), (2, 0), (4, 1)], "row_id long, quality int")
    titles = spark.createDataFrame([("a", 9, "Title A"), ("a", 10, "Other A"), ("b", 9, "Title B")],
                                   "icd_code string, icd_version int, long_title string")
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "label string, label_id int")
    return {
        "J4": [lambda d: J.exclude_annotated(d, ann)],
        "J5": [lambda d: J.only_annotated(d, ann)],
        "J6": [lambda d: J.attach_annotations(d, ann)],
        "J7": [lambda d: J.describe_codes(d, titles)],
        "J7 safe": [lambda d: J.describe_codes(d, titles, safe=True)],
        "E3 drop": [lambda d: L.encode_labels(d, ids, on_unknown="drop")],
        "E3 keep": [lambda d: L.encode_labels(d, ids, on_unknown="keep")],
        "P4": [lambda d: P.filter_category(d, "Radiology")],
        "P3, P4, J4, E3": [lambda d: P.drop_missing(d, ["label"]), lambda d: P.filter_category(d, "Radiology"),
                           lambda d: J.exclude_annotated(d, ann), lambda d: L.encode_labels(d, ids, on_unknown="keep")],
    }


def test_stream_equals_batch_for_each_operator(spark, tmp_path):
    notes = spark.createDataFrame(
        [(1, "Radiology ", "a", 9, "a"), (2, "Radiology", "b", 9, "b"), (3, "Physician", "a", 10, "zz"),
         (4, "Radiology", None, 9, None), (None, None, "a", 9, "a"), (2, "Radiology", "b", 9, "b")],
        "row_id long, category string, icd_code string, icd_version int, label string")
    src = str(tmp_path / "in")
    notes.repartition(3).write.parquet(src)
    for name, chain in steps(spark).items():
        want = notes
        for step in chain:
            want = step(want)
        out = tmp_path / name
        q = write_stream(on_files(spark, src, notes.schema, *chain, max_files_per_trigger=1), str(out / "rows"), str(out / "ckpt"))
        assert q.awaitTermination(120)
        got = spark.read.schema(want.schema).parquet(str(out / "rows"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_unknown_label_fails_the_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([("zz",)], "label string")
    rows.write.parquet(src)
    ids = spark.createDataFrame([("a", 0)], "label string, label_id int")
    q = write_stream(on_files(spark, src, rows.schema, lambda d: L.encode_labels(d, ids)), str(tmp_path / "o"), str(tmp_path / "c"))
    with pytest.raises(Exception, match="unknown label: zz"):
        q.awaitTermination(120)
