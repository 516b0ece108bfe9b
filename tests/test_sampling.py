"""Split properties, exact sizes, determinism under repartitioning."""

from pyspark.sql import functions as F

from clinloom.operators import sampling as U
from clinloom.operators.ranking import global_rank, hash_rank, seeded_hash


def keys(spark, n, parts=1):
    return spark.range(n).select(F.col("id").alias("k")).repartition(parts)


def test_split_exact_sizes_disjoint_cover(spark):
    for n in (0, 1, 7, 10, 233, 1001):
        out = U.split_exact(keys(spark, n, 3), "k").collect()
        by = {}
        for r in out:
            by.setdefault(r["split"], set()).add(r["k"])
        assert sum(len(v) for v in by.values()) == n == len(out)
        pool = round(n * 0.8)
        assert len(by.get("test", ())) == n - pool
        assert len(by.get("validate", ())) == round(pool * 0.25)


def test_split_is_partitioning_independent(spark):
    a = {(r["k"], r["split"]) for r in U.split_exact(keys(spark, 500, 1), "k").collect()}
    b = {(r["k"], r["split"]) for r in U.split_exact(keys(spark, 500, 7), "k").collect()}
    assert a == b


def test_hash_rank_is_a_permutation(spark):
    df = keys(spark, 3000, 5).withColumn("h", seeded_hash(1, "k"))
    ranks = sorted(r["rank"] for r in hash_rank(df, "h", ["k"], bucket_chars=2).collect())
    assert ranks == list(range(3000))


def test_global_rank_and_weighted_offsets(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(200)], "k long, w long").repartition(4)
    out = sorted(global_rank(df, ["k"], weight="w", offset_col="off").collect(), key=lambda r: r["k"])
    assert [r["rank"] for r in out] == list(range(200))
    run = 0
    for r in out:
        assert r["off"] == run
        run += r["w"]


def test_holdout_ceil(spark):
    out = U.holdout(keys(spark, 95, 2), "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"validate": 10, "train": 85}


def test_split_hash_fractions_stable(spark):
    a = U.split_hash(keys(spark, 2000), "k").groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in a}
    assert abs(counts["train"] - 1200) < 120 and sum(counts.values()) == 2000


def test_sample_and_subsample(spark):
    assert U.sample_n(keys(spark, 100, 3), 10, "k").count() == 10
    df = U.split_hash(keys(spark, 500), "k")
    sub = U.subsample_splits(df, {"train": 8, "validate": 2, "test": 2}, "k")
    assert {r["split"]: r["count"] for r in sub.groupBy("split").count().collect()} == {"train": 8, "validate": 2, "test": 2}


def test_batches_and_shards(spark):
    out = U.assign_batches(keys(spark, 50, 3), 16, "k").collect()
    assert sorted(r["position"] for r in out) == list(range(50))
    assert max(r["batch_id"] for r in out) == 3
    lengths = spark.createDataFrame([(i, 100 - i // 2) for i in range(40)], "k long, n long")
    b = U.bucket_by_length(lengths, 8, "n", "k").orderBy("position").collect()
    assert [r["n"] for r in b] == sorted(r["n"] for r in b)
    s = U.shard(U.bucket_by_length(lengths, 8, "n", "k"), 4)
    assert sorted(r["count"] for r in s.groupBy("worker").count().collect()) == [10, 10, 10, 10]


def test_scale_conf_sizes():
    from clinloom.session import scale_conf
    conf = scale_conf(100 * (1 << 40), 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "24"
