"""Empty inputs flow through the jobs without errors."""

from clinloom.operators import sequences as Q
from clinloom.operators.ranking import global_rank, hash_rank, seeded_hash
from clinloom.operators.sampling import holdout, split_exact
from clinloom.plans.classification import evaluate
from clinloom.plans.icd_dataset import icd_dataset


def test_empty_icd_dataset(spark):
    n = spark.createDataFrame([], "row_id long, hadm_id long, category string, text string")
    c = spark.createDataFrame([], "hadm_id long, seq_num int, icd9_code string")
    assert icd_dataset(n, c, c).count() == 0


def test_empty_splits_and_ranks(spark):
    df = spark.createDataFrame([], "k long")
    assert split_exact(df, "k").count() == 0 and holdout(df, "k").count() == 0
    assert hash_rank(df.withColumn("h", seeded_hash(1, "k")), "h", ["k"]).count() == 0
    assert global_rank(df, ["k"]).count() == 0
    w = spark.createDataFrame([], "k long, w long")
    assert global_rank(w, ["k"], weight="w", offset_col="o").count() == 0


def test_empty_packing_and_vocab(spark):
    docs = spark.createDataFrame([], "k string, ids array<int>")
    assert Q.pack_blocks(docs, "k", "ids", 8).count() == 0
    assert Q.pack_blocks(docs, "k", "ids", 8, order_is_hash=True).count() == 0
    tok = spark.createDataFrame([], "k long, tokens array<string>")
    assert Q.build_vocab(tok, "tokens").count() == 0


def test_empty_evaluation(spark):
    s = spark.createDataFrame([], "batch_id long, actual int, predicted int, logits array<float>")
    rows = {r["metric"]: r["value"] for r in evaluate(s).collect()}
    assert set(rows) >= {"test_f1", "test_mean_loss"}
