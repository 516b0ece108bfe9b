"""M6: the tanh head's gradient, its training on shards and the comparison of runs."""

import numpy as np
import pytest

from clinloom.operators import head as H


def rings(n, seed=0):
    """Two classes that no straight line divides."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    angle, r = rng.uniform(0, 2 * np.pi, n), 0.4 + y + rng.normal(0, 0.05, n)
    return [(i, [float(a), float(b), float(a * a)], int(c)) for i, (a, b, c) in
            enumerate(zip(r * np.cos(angle), r * np.sin(angle), y, strict=True))]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(parts)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    w = [a + rng.normal(0, 0.1, a.shape) for a in H.initial_weights(4, 3, 5)]
    assert [a.shape for a in w] == [(4, 8), (8,), (8, 4), (4,), (4, 3), (3,)]
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    _, g = H.loss_and_gradient(w, x, y)
    for i, a in enumerate(w):
        for at in list(np.ndindex(a.shape))[:: max(1, a.size // 5)]:
            up, down = ([b.copy() for b in w] for _ in range(2))
            up[i][at] += 1e-6
            down[i][at] -= 1e-6
            slope = (H.loss_and_gradient(up, x, y)[0] - H.loss_and_gradient(down, x, y)[0]) / 2e-6
            assert slope == pytest.approx(g[i][at], abs=1e-7)


def test_the_grid_has_eighteen_runs():
    runs = H.grid()
    assert len(runs) == len(set(runs)) == 18
    assert {r.epochs for r in runs} == {3, 4, 5} and {r.rate for r in runs} == {2e-5, 3e-5, 5e-5} and {r.batch for r in runs} == {16, 32}


def test_partitioning_does_not_matter_and_epochs_share_weights(spark):
    rows = rings(150)
    runs = [H.Run(1, 0.01, 16), H.Run(2, 0.01, 16), H.Run(2, 0.01, 64)]
    a = H.train_heads(frame(spark, rows, 1), "v", "label", "id", runs, shard=60)
    b = H.train_heads(frame(spark, rows, 7), "v", "label", "id", runs[1:], shard=60)
    for run in runs[1:]:
        for x, y in zip(a[run], b[run], strict=True):
            assert np.allclose(x, y, atol=1e-12)
    assert not np.allclose(a[runs[0]][0], a[runs[1]][0]) and not np.allclose(a[runs[1]][0], a[runs[2]][0])


def test_summed_updates_equal_the_plain_average(spark):
    """One epoch over shards is the row-weighted mean of the shards' own epochs."""
    from pyspark.sql import functions as F
    rows = rings(90)
    df = frame(spark, rows)
    run = H.Run(1, 0.02, 8)
    got = H.train_heads(df, "v", "label", "id", [run], shard=40)[run]
    key = df.select("id", F.xxhash64(F.lit(3), F.col("id")).alias("key"))
    key = {r.id: (r.key, r.place) for r in key.withColumn("place", F.xxhash64(F.lit(0), F.col("key"))).collect()}
    start = H.initial_weights(3, 2, 3)
    total = [np.zeros_like(a) for a in start]
    for s in range(3):
        mine = sorted((r for r in rows if key[r[0]][0] % 3 == s), key=lambda r: key[r[0]][::-1])
        new = H.train_shard(start, np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), 0.02, 8)
        total = [t + len(mine) * (b - a) for t, a, b in zip(total, start, new, strict=True)]
    for a, t, g in zip(start, total, got, strict=True):
        assert np.allclose(a + t / len(rows), g, atol=1e-10)


def test_learns_what_a_line_cannot(spark):
    df = frame(spark, rings(400))
    runs = H.grid(epochs=(1, 12), rates=(1e-4, 0.02), batches=(16,))
    heads = H.train_heads(df, "v", "label", "id", runs, shard=200)
    table = H.compare_runs(df, heads, "v", "label").collect()
    assert len(table) == 4 and sum(r.best for r in table) == 1 and all(r.rows == 400 for r in table)
    best = next(r for r in table if r.best)
    assert (best.epochs, best.rate) == (12, 0.02) and best.accuracy > 0.95 and best.f1 == max(r.f1 for r in table)
    said = {r.id: r.predicted for r in H.predict_head(df, heads[H.Run(12, 0.02, 16)], "v").collect()}
    assert sum(said[i] == c for i, _, c in rings(400)) / 400 == pytest.approx(best.accuracy)


def test_nulls_and_empty_tables(spark):
    rows = [*rings(40), (90, None, 1), (91, [1.0, 2.0, 3.0], None)]
    df = frame(spark, rows)
    run = H.Run(1, 0.01, 16)
    w = H.train_heads(df, "v", "label", "id", [run])[run]
    plain = H.train_heads(frame(spark, rings(40)), "v", "label", "id", [run])[run]
    assert all(np.allclose(a, b) for a, b in zip(w, plain, strict=True))
    out = {r.id: r.predicted for r in H.predict_head(df, w, "v").collect()}
    assert out[90] is None and out[91] in (0, 1)
    assert H.compare_runs(df, {run: w}, "v", "label").first().rows == 40
    with pytest.raises(ValueError):
        H.train_heads(df.limit(0), "v", "label", "id", [run])
    with pytest.raises(ValueError):
        H.train_heads(frame(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 1)]), "v", "label", "id", [run])
