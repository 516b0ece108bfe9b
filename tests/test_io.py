"""Sources and sinks on files written by the tests."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from clinloom.sources import readers as S
from clinloom.sources import sinks as K

NOTES_CSV = (
    'ROW_ID,SUBJECT_ID,HADM_ID,CHARTDATE,CHARTTIME,STORETIME,CATEGORY,DESCRIPTION,CGID,ISERROR,TEXT\n'
    '1,9,100.0,2101-01-01,,,Discharge summary ,Report,,,"line one\nline ""two"""\n'
    '2,9,,2101-01-02,,,Radiology,Report,,,plain\n'
)


def test_read_notes_multiline_and_float_ids(spark, tmp_path):
    p = tmp_path / "notes.csv"
    p.write_text(NOTES_CSV)
    rows = sorted(S.read_notes(spark, str(p), ["row_id", "hadm_id", "category", "text"]).collect())
    assert rows[0]["text"] == 'line one\nline "two"' and rows[0]["hadm_id"] == 100
    assert rows[0]["category"] == "Discharge summary " and rows[1]["hadm_id"] is None


def test_read_codes_keeps_leading_zeros(spark, tmp_path):
    p = tmp_path / "dx.csv"
    p.write_text("ROW_ID,SUBJECT_ID,HADM_ID,SEQ_NUM,ICD9_CODE\n1,2,3,1,0041\n2,2,3,2,\n")
    rows = S.read_codes(spark, str(p)).orderBy("row_id").collect()
    assert rows[0]["icd9_code"] == "0041" and rows[1]["icd9_code"] is None


def test_pairs_jsonl_null_label_and_failfast(spark, tmp_path):
    d = tmp_path / "nli"
    d.mkdir()
    (d / "mli_train_v1.jsonl").write_text('{"pairID": "a", "sentence1": "x", "sentence2": "y", "gold_label": "neutral"}\n')
    (d / "mli_dev_v1.jsonl").write_text('{"pairID": "b", "sentence1": "x", "sentence2": "y"}\n')
    (d / "mli_test_v1.jsonl").write_text('{"pairID": "c", "sentence1": "x", "sentence2": "y", "gold_label": "entailment"}\n')
    rows = {r["pair_id"]: r for r in S.load_pair_splits(spark, str(d)).collect()}
    assert rows["b"]["gold_label"] is None and rows["b"]["split"] == "dev" and rows["c"]["split"] == "test"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"pairID": "a"\n')
    with pytest.raises(Exception):
        S.read_pairs_jsonl(spark, str(bad)).collect()


def test_flatten_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 2}, "c": "x"}')], "id int, j string")
    out = S.flatten_json(df, "j", "a struct<b: int>, c string")
    assert out.columns == ["id", "a.b", "c"] and tuple(out.first()) == (1, 2, "x")


def test_read_reports_relative_paths(spark, tmp_path):
    root = tmp_path / "reports"
    (root / "files" / "p1").mkdir(parents=True)
    (root / "files" / "p1" / "s1.txt").write_text("FINDINGS:\n none\n")
    (root / "files" / "p1" / "s2.txt").write_text("IMPRESSION: ok")
    rows = {r["path"]: r["text"] for r in S.read_reports(spark, str(root)).collect()}
    assert rows == {"files/p1/s1.txt": "FINDINGS:\n none\n", "files/p1/s2.txt": "IMPRESSION: ok"}


def test_tsv_and_corpus_lines(spark, tmp_path):
    t = tmp_path / "x.tsv"
    t.write_text('a\t"quoted\tb\n')
    r = S.read_tsv(spark, str(t), "c1 string, c2 string, c3 string").first()
    assert tuple(r) == ("a", '"quoted', "b")
    c = tmp_path / "corpus.txt"
    c.write_text("short\n            \nthis line is long enough\n")
    assert [r["text"] for r in S.read_corpus_lines(spark, str(c)).collect()] == ["this line is long enough"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, " a\nb", "train"), (2, "c", "test")], "k int, text string, split string")
    K.write_splits(df, str(tmp_path / "splits"))
    back = K.read_back(spark, str(tmp_path / "splits")).where(F.col("split") == "test")
    assert [r["k"] for r in back.collect()] == [2]
    K.write_corpus(df, str(tmp_path / "corpus"))
    lines = spark.read.text(str(tmp_path / "corpus" / "split=train")).collect()
    assert [r[0] for r in lines] == [" a b"]
    out = K.checkpoint_table(df, str(tmp_path / "ckpt"))
    assert out.count() == 2
    K.write_sample(df, 1, str(tmp_path / "sample"), "k")
    assert len([f for f in os.listdir(tmp_path / "sample") if f.startswith("part-")]) == 1
    m = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "metric string, value double")
    K.write_metrics(m, str(tmp_path / "metrics"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "metrics")).collect()] == ["a = 1.0", "b = 2.0"]


def test_spread_only_under_split(spark, tmp_path):
    one = spark.range(10).coalesce(1)
    one.write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    assert S.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.read.parquet(str(tmp_path / "one"))
    assert S.spread(many, 1).rdd.getNumPartitions() == 1


def test_write_splits_csv_keeps_text_exact(spark, tmp_path):
    df = spark.createDataFrame([(1, ' lead "q"\nnext ', "train"), (2, "x", "test")], "k int, text string, split string")
    K.write_splits(df, str(tmp_path / "csv"), fmt="csv")
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema("k int, text string").csv(str(tmp_path / "csv" / "split=train")))
    assert [tuple(r) for r in back.collect()] == [(1, ' lead "q"\nnext ')]


def test_size_check_of_broadcasts(spark):
    from clinloom.operators.joins import is_small, stored_bytes
    df = spark.createDataFrame([("abc", 1, [1, 2]), (None, None, None)], "s string, i long, a array<int>")
    assert 50 < stored_bytes(df) < 200 and is_small(df) and not is_small(df, 10)
    assert stored_bytes(df.limit(0)) == 0


def test_readers_bind_columns_by_name(spark, tmp_path):
    p = tmp_path / "codes.csv"
    p.write_text("HADM_ID,ICD10_CODE,ROW_ID,SEQ_NUM,SUBJECT_ID\n10,0041,30,1,20\n")
    r = S.read_codes(spark, str(p), "icd10_code").first()
    assert (r["hadm_id"], r["row_id"], r["icd10_code"], r["seq_num"]) == (10, 30, "0041", 1)
    q = tmp_path / "cleaned.csv"
    q.write_text('Text,hadm_id,CATEGORY,ROW_ID\n"a ""b""\nc",7.0,Radiology,1\n')
    assert tuple(S.read_notes(spark, str(q), ["row_id", "hadm_id", "category", "text"]).first()) == \
        (1, 7, "Radiology", 'a "b"\nc')
    with pytest.raises(ValueError):
        S.read_codes(spark, str(q))
    with pytest.raises(ValueError):
        S.read_notes(spark, str(q), ["row_id", "chartdate"])
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "a.csv").write_text("HADM_ID,SEQ_NUM,ICD9_CODE\n1,1,a\n")
    (d / "b.csv").write_text("SEQ_NUM,HADM_ID,ICD9_CODE\n1,2,b\n")
    with pytest.raises(Exception):
        S.read_codes(spark, str(d)).collect()


def test_named_tables(spark, tmp_path):
    p = tmp_path / "ann.csv"
    p.write_text("Hospital_Admission_ID,Row_ID,Pain,Unsure\n5,1,1,0\n")
    r = S.read_named(spark, str(p), "annotations").first()
    assert (r["row_id"], r["pain"], r["unsure"]) == (1, 1, 0)
    o = tmp_path / "poe.csv"
    o.write_text("poe_id,ordertime,subject_id,hadm_id,order_type,order_subtype\n1-1,2150-01-02 03:04:05,1,2,Radiology,General Xray\n")
    assert str(S.read_named(spark, str(o), "orders").first()["ordertime"]) == "2150-01-02 03:04:05"


def test_linkage_job_from_files(spark, tmp_path):
    from clinloom.plans import radiology as R
    from clinloom.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    views = {"diagnoses": "v_dx", "dictionary": "v_d_icd", "records": "v_records", "metadata": "v_metadata",
             "studies": "v_studies", "orders": "v_poe"}
    read = {}
    for name, v in views.items():
        fx.view(spark, sf, v).write.option("header", True).option("escape", '"').csv(str(tmp_path / name))
        read[name] = S.read_named(spark, str(tmp_path / name), name)
    rep = fx.view(spark, sf, "v_reports")
    got = R.link_radiology(read["diagnoses"], read["dictionary"], read["records"], read["metadata"], read["studies"],
                           read["orders"], rep)
    exp = R.link_radiology(*[fx.view(spark, sf, views[k]) for k in
                             ("diagnoses", "dictionary", "records", "metadata", "studies", "orders")], rep)
    assert sorted(map(str, got.collect())) == sorted(map(str, exp.select(*got.columns).collect())) and got.count() > 0


def test_reports_with_blanks_and_percent_signs(spark, tmp_path):
    root = tmp_path / "re ports%20x"
    (root / "a b").mkdir(parents=True)
    (root / "a b" / "c+d%2F.txt").write_text("one")
    (root / "e.txt").write_text("two\nlines")
    got = {r["path"]: r["text"] for r in S.read_reports(spark, str(root)).collect()}
    assert got == {"a b/c+d%2F.txt": "one", "e.txt": "two\nlines"}


def _files(root):
    """(folder, content) of every file below ``root`` that Spark reads."""
    return sorted((os.path.basename(d), open(os.path.join(d, f), "rb").read())
                  for d, _, names in os.walk(root) for f in names if not f.startswith((".", "_")))


def test_report_files_are_those_of_the_text_writer(spark, tmp_path):
    rows = [("a b", "x\ny"), ("a b", "again"), ("ü%/:[1]='\"#{^}\\*?\x7f", "odd\r\n"), ("-1", None), ("-1", ""), (None, "no path"), ("", "empty path")]
    df = spark.createDataFrame(rows, "path string, text string").coalesce(1)
    ours, theirs = tmp_path / "ours", tmp_path / "theirs"
    K.write_reports(df, f"file://{ours}")
    df.write.partitionBy("path").text(str(theirs))
    assert _files(ours) == _files(theirs) and len(_files(ours)) == 4
    with pytest.raises(FileExistsError):
        K.write_reports(df, f"file://{ours}")
    K.write_reports(df, str(tmp_path / "default store"))             # no scheme: Spark's writer decides where
    assert _files(tmp_path / "default store") == _files(theirs)
    K.write_reports(df.limit(0), f"file:{tmp_path}/none")
    assert S.read_reports(spark, f"file:{tmp_path}/none").collect() == []


@pytest.mark.parametrize("query", ["s6_read_reports", "g2_from_files"])
def test_report_files_start_no_process_each(spark, tmp_path, query):
    import __spark_entry__
    from clinloom.session import ensure_checkpoint_dir
    tables = {"pages": ("page_id long, html string", [(i, f"<p>report {i}\nend") for i in range(30)]),
              "documents": ("doc_id long, text string", [(i, f"note {i}") for i in range(3)]),
              "labels": ("doc_id long, quality int, toxic int", [(2, 1, 0)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    out = __spark_entry__.queries()[query](spark, str(tmp_path))
    assert any("report" in r["text"] and "end" in r["text"] for r in out.collect())
    roots = [f"{shared}/{x}" for x in set(os.listdir(shared)) - before if "reports" in x]
    names = [f for root in roots for _, _, files in os.walk(root) for f in files]
    # a checksum file is what Hadoop's local file system leaves, at five processes a report
    assert len(roots) == 1 and len(names) == 30 and not [f for f in names if f.endswith(".crc")]


def test_many_reports_are_listed_and_read_by_few_tasks(spark, tmp_path):
    root, cores = tmp_path / "many", spark.sparkContext.defaultParallelism
    n = 20 * cores
    for i in range(n):
        (root / f"path={i}").mkdir(parents=True)
        (root / f"path={i}" / "r.txt").write_text(f"text {i}")
    before = spark.conf.get(S.LISTING_TASKS)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    spark.sparkContext.setJobGroup("reports", "listing")
    try:
        df = S.read_reports(spark, str(root))
        parts = df.rdd.getNumPartitions()
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("reports") for s in tracker.getJobInfo(j).stageIds]
    assert parts == 8 * cores and max(tasks) == 8 * cores and len(tasks) >= 2    # one a folder before
    assert {r["text"] for r in rows} == {f"text {i}" for i in range(n)}
    assert spark.conf.get(S.LISTING_TASKS) == before


def test_local_reports_are_listed_and_read_by_the_tasks(spark, tmp_path):
    root = tmp_path / "re ports%20+"
    names = ["a.txt", "_a.txt", "_a=1.txt", ".a.txt", "_metadata", "b._COPYING_", "d/._x=1", "d/e/f/g/i.txt", "_hid/x.txt", "_p=1/x.txt",
             "_metadatax/x.txt", "_metadatax/_m", "path=a b/q=2/\u00fc%/+ &.txt", ".hid/x.txt", "l\nm/x.txt", "'\"#?.txt", "w[1]*{}.txt"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}\n")
    (root / "empty.txt").write_text("")
    (root / "bytes.txt").write_bytes(b"\xef\xbb\xbf\xff\r\n")
    (root / "link").symlink_to(root / "d")
    (root / "broken").symlink_to(root / "none")

    def rows(path):
        return sorted((r[0], bytes(r[1])) for r in S.read_reports(spark, path).select("path", F.col("text").cast("binary")).collect())

    theirs = rows(str(root))                                         # no scheme: listed and read by Spark
    assert rows(f"file:{root}") == rows(f"file:{root}/") == theirs and len(theirs) > 9
    # Spark's scan holds the status and path of each file on the driver
    assert not [f for f in S.read_reports(spark, f"file:{root}").inputFiles() if "re%20ports" in f]
    with gzip.open(root / "z.txt.gz", "wt") as f:
        f.write("packed")
    assert rows(f"file:{root}") == rows(str(root)) == sorted([*theirs, ("z.txt.gz", b"packed")])


def test_batches_of_texts_are_cut_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(S, "BATCH_ROWS", 3)
    monkeypatch.setattr(S, "PIECE_BYTES", 10)
    texts = [b"1" * n for n in (4, 4, 4, 25, 1, 1, 1, 1, 10)]
    cut = list(S._arrow([("p", x) for x in texts], S._READ, lambda r: len(r[1])))
    assert [b.num_rows for b in cut] == [2, 1, 1, 3, 1, 1]
    assert [x for b in cut for x in b.column("text").to_pylist()] == texts
    assert list(S._arrow([], S._READ, len)) == []
