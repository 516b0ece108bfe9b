"""The stateless cleaning chain on a file stream (availableNow trigger)."""

from clinloom.streaming import clean_note_stream, write_stream


def test_stream_cleans_and_excludes(spark, tmp_path):
    src = tmp_path / "in"
    notes = spark.createDataFrame(
        [(1, "Discharge summary", "[**x**] ID 12 a  b"), (2, "Discharge summary", "keep me"), (3, "Radiology", "z")],
        "row_id long, category string, text string")
    notes.write.parquet(str(src))
    ann = spark.createDataFrame([(2,)], "row_id long")
    stream = clean_note_stream(spark, str(src), notes.schema, annotations=ann, category="Discharge summary")
    q = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["row_id"], r["text"]) for r in rows] == [(1, "a b")]


def test_stream_resumes_from_checkpoint_without_duplicates(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    schema = "row_id long, category string, text string"
    spark.createDataFrame([(1, "Radiology", "a  b")], schema).write.mode("append").parquet(str(src))
    q = write_stream(clean_note_stream(spark, str(src), schema), str(out), str(ckpt))
    q.awaitTermination(120)
    spark.createDataFrame([(2, "Radiology", "c\n\nd")], schema).write.mode("append").parquet(str(src))
    q = write_stream(clean_note_stream(spark, str(src), schema), str(out), str(ckpt))
    q.awaitTermination(120)
    rows = sorted((r["row_id"], r["text"]) for r in spark.read.parquet(str(out)).collect())
    assert rows == [(1, "a b"), (2, "c d")]
