"""Batches are worked on in runs of bounded size, whatever the rows of a task."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from clinloom.operators import sequences as Q


def test_pieces_hold_all_rows_in_order_within_the_bound():
    from clinloom.operators.worker import pieces
    rows = [None if i % 13 == 0 else [f"{i}-{j}" * 5 for j in range(i % 40)] for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(rows, pa.list_(pa.string()))], names=["k", "t"])
    cut = list(pieces(batch, 4096))
    assert len(cut) > 10 and all(p.nbytes <= 4096 for p in cut)
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in pieces(batch, 1)] == [1] * 500


def test_text_pieces_hold_all_rows_in_order_within_the_bound():
    from clinloom.operators.hooks import text_pieces
    texts = ["x" * (i % 300) if i % 7 else None for i in range(1000)] + ["y" * 5000, "z"]
    pdf = pd.DataFrame({"k": range(len(texts)), "t": texts})
    cut = list(text_pieces(pdf, "t", 1000))
    assert [k for p in cut for k in p["k"]] == list(range(len(texts)))
    assert all(len(p) == 1 or sum(len(t or "") for t in p["t"]) <= 1000 for p in cut)


def test_head_table_built_in_runs_finds_every_token(monkeypatch):
    monkeypatch.setattr(Q, "HASH_ROWS", 7)
    words = pa.array([f"w{i}" for i in range(50)] + ["", "é", "日本"])
    import numpy as np
    table = Q.HeadTable(words, np.arange(53) + 5)
    assert list(table(words)) == list(range(5, 58)) and list(table(pa.array(["w50", "w1"]))) == [-1, 6]


def test_encode_over_several_pieces(spark):
    rows = spark.range(60, numPartitions=1).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(20000)), lambda i: F.concat(
        F.lit("t"), ((i * 7 + F.col("id")) % 1000).cast("string"))).alias("a"), F.array(F.lit("t5"), F.lit("none")).alias("b"))
    vocab = spark.range(1000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"), (F.col("id") + 5).cast("int").alias("id"))
    for bound in (Q.HEAD_BYTES, 2000):
        got = Q.encode(rows, "k", ["a", "b"], vocab, head_bytes=bound)
        want = F.transform(F.sequence(F.lit(0), F.lit(20000)), lambda i: ((i * 7 + F.col("k")) % 1000 + 5).cast("int"))
        bad = got.where((F.col("a_ids") != want) | (F.col("b_ids") != F.array(F.lit(10), F.lit(1))))
        assert got.count() == 60 and bad.count() == 0


def draws(key, ids, size, seed, p):
    """Q11 position by position."""
    import hashlib
    prime, masked, labels = 2147483647, [], []
    start = int(hashlib.md5("|".join([str(seed)] + ([] if key is None else [str(key)])).encode()).hexdigest()[:7], 16)
    for i, x in enumerate(ids):
        b = (((start + (i + 1) * 48271) % prime) ** 2 + 12345) % prime
        s = (b * b + i) % prime
        v = s * 48271 % prime
        drawn = s < int(p * prime) and (x is None or x >= 5)
        labels.append(x if drawn and x is not None else -100)
        masked.append(x if not drawn or v >= int(0.9 * prime) else 4 if v < int(0.8 * prime)
                      else 5 + v * 69621 % prime % (size - 5))
    return masked, labels


def test_mask_tokens_equals_the_loop_and_runs_on_batches(spark):
    rows = [(k, None if k == 3 else [None if (i + (k or 0)) % 11 == 0 else (i * 31 + (k or 0)) % 90 for i in range(40 * ((k or 0) % 5))])
            for k in [None, *range(40)]]
    df = spark.createDataFrame(rows, "k long, ids array<int>").coalesce(1)
    out = Q.mask_tokens(df, "ids", "k", 90, seed=9, p=0.4)
    assert out.columns == ["k", "ids", "masked_ids", "labels"] and out.schema["labels"].dataType == df.schema["ids"].dataType
    for r in out.collect():
        assert (r["masked_ids"], r["labels"]) == ((None, None) if r["ids"] is None else draws(r["k"], r["ids"], 90, 9, 0.4))
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_masking_reads_tokens_made_once(spark):
    from clinloom.registry import QUERIES
    plan = QUERIES["q11_mask_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
