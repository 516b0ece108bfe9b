"""M6: the two-layer tanh head (d -> 2d -> d -> classes) on frozen vectors, and its training grid.

Training is mini-batch gradient descent (Adam, softmax cross-entropy) distributed over
shards of the data: in one epoch every shard takes its mini-batches in a seeded order from
the same weights, and the summed updates of all shards, weighted by their rows, move the
weights.  With one shard this is the plain loop.  One Spark job an epoch trains all runs of
the grid at once: the vectors are read once for all, not once a run, and the number of jobs
does not grow with the data.  Runs that differ only in their number of epochs share a
sequence of weights.  What returns to the driver is one summed update per sequence.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.session import materialise

SLICE = 1 << 16                      # numbers of an update in one row


@dataclass(frozen=True, order=True)
class Run:
    """One combination of the grid; ``batch`` rows a step on each shard."""
    epochs: int
    rate: float
    batch: int


def grid(epochs: Iterable[int] = (3, 4, 5), rates: Iterable[float] = (2e-5, 3e-5, 5e-5),
         batches: Iterable[int] = (16, 32)) -> list[Run]:
    """All combinations; the defaults are the eighteen runs of the reference's sentence-pair task."""
    return [Run(*x) for x in product(epochs, rates, batches)]


def initial_weights(n_in: int, n_out: int, seed: int) -> list[np.ndarray]:
    """Uniform weights in +-1/sqrt(inputs) of the layers n_in -> 2 n_in -> n_in -> n_out, zero biases."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in ((n_in, 2 * n_in), (2 * n_in, n_in), (n_in, n_out)):
        out += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b)]
    return out


def logits(w: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]) @ w[4] + w[5]


def loss_and_gradient(w: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the batch and its gradient."""
    h1 = np.tanh(x @ w[0] + w[1])
    h2 = np.tanh(h1 @ w[2] + w[3])
    z = h2 @ w[4] + w[5]
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[rows, y], 1e-300)).mean())
    p[rows, y] -= 1
    d3 = p / len(y)
    d2 = (d3 @ w[4].T) * (1 - h2 * h2)
    d1 = (d2 @ w[2].T) * (1 - h1 * h1)
    return loss, [x.T @ d1, d1.sum(axis=0), h1.T @ d2, d2.sum(axis=0), h2.T @ d3, d3.sum(axis=0)]


def train_shard(w: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray, rate: float, batch: int) -> list[np.ndarray]:
    """Weights after one epoch of mini-batches in the order of the rows (Adam, moments from zero)."""
    w = [a.copy() for a in w]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step, lo in enumerate(range(0, len(y), batch), 1):
        _, g = loss_and_gradient(w, x[lo:lo + batch], y[lo:lo + batch])
        for i, d in enumerate(g):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            w[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return w


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _shard_updates(table, weights, rates: Sequence[tuple[float, int]]):
    """Per sequence and slice: the shard's update times its rows."""
    import pyarrow as pa
    order = np.lexsort((np.asarray(table.column("key")), np.asarray(table.column("place"))))
    x, y = _matrix(table.column("vec"))[order], np.asarray(table.column("label"))[order]
    out = []
    for s, (rate, batch) in enumerate(rates):
        new = train_shard(weights.value[s], x, y, rate, batch)
        flat = np.concatenate([(b - a).ravel() for a, b in zip(weights.value[s], new, strict=True)]) * len(y)
        out += [(s, i, flat[lo:lo + SLICE].tolist(), len(y)) for i, lo in enumerate(range(0, len(flat), SLICE))]
    s, i, delta, rows = (list(c) for c in zip(*out, strict=True))
    return pa.table({"seq": pa.array(s, pa.int32()), "slice": pa.array(i, pa.int32()),
                     "delta": pa.array(delta, pa.list_(pa.float64())), "rows": pa.array(rows, pa.int64())})


def _updates(weights, rates):
    def one(table):
        return _shard_updates(table, weights, rates)
    return one


def train_heads(df: DataFrame, vec: str, label: str, key: str, runs: Sequence[Run], classes: int | None = None,
                shard: int = 4096, seed: int = 3) -> dict[Run, list[np.ndarray]]:
    """Weights of every run.  Labels are class ids from 0; rows with a null vector or label are left out.

    ``key`` orders the rows (hashed anew for each epoch), so results do not depend on the
    partitioning.  A shard holds about ``shard`` rows; each is one task's group.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    spark = df.sparkSession
    rows = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(
        F.xxhash64(F.lit(seed), F.col(key)).alias("key"), F.col(vec).cast("array<double>").alias("vec"),
        F.col(label).cast("long").alias("label"))
    stat = rows.agg(F.count(F.lit(1)), F.max("label"), F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if not stat[0]:
        raise ValueError("no row has both a vector and a label")
    if stat[2] != stat[3]:
        raise ValueError("vectors differ in length")
    shards = -(-stat[0] // shard)
    data = materialise(rows.withColumn("shard", F.pmod("key", F.lit(shards))), "head-rows")
    rates = sorted({(r.rate, r.batch) for r in runs})
    start = initial_weights(stat[2], classes or stat[1] + 1, seed)
    now = [[a.copy() for a in start] for _ in rates]
    shapes, total = [a.shape for a in start], sum(a.size for a in start)
    done: dict[Run, list[np.ndarray]] = {}
    for epoch in range(max(r.epochs for r in runs)):
        weights = spark.sparkContext.broadcast(now)
        moved = (data.withColumn("place", F.xxhash64(F.lit(epoch), F.col("key"))).groupBy("shard")
                 .applyInArrow(_updates(weights, rates), "seq int, slice int, delta array<double>, rows long")
                 .groupBy("seq", "slice").agg(Summarizer.sum(array_to_vector("delta")).alias("d"), F.sum("rows").alias("rows"))
                 .select("seq", "slice", vector_to_array("d").alias("d"), "rows").collect())
        updates = [np.zeros(total) for _ in rates]
        for r in moved:
            updates[r["seq"]][r["slice"] * SLICE:r["slice"] * SLICE + len(r["d"])] = np.array(r["d"]) / r["rows"]
        weights.unpersist()
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        now = [[a + d.reshape(s) for a, d, s in zip(w, np.split(u, cuts), shapes, strict=True)]
               for w, u in zip(now, updates, strict=True)]
        for run in runs:
            if run.epochs == epoch + 1:
                done[run] = now[rates.index((run.rate, run.batch))]
    return done


def _classes(batches, weights, vec: str, out_col: str):
    import pyarrow as pa
    for batch in batches:
        some = np.flatnonzero(batch.column(vec).is_valid().to_numpy(zero_copy_only=False))
        got = np.zeros(batch.num_rows, np.int32)
        if len(some):
            got[some] = logits(weights.value, _matrix(batch.column(vec).take(pa.array(some)))).argmax(axis=1)
        mask = np.ones(batch.num_rows, bool)
        mask[some] = False
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, mask=mask)], names=[*batch.schema.names, out_col])


def predict_head(df: DataFrame, weights: list[np.ndarray], vec: str, out_col: str = "predicted") -> DataFrame:
    """M5 with a tanh head: the class id of each row; null for a null vector."""
    from pyspark.sql import types as T
    shared = df.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.IntegerType())])
    return df.mapInArrow(partial(_classes, weights=shared, vec=vec, out_col=out_col), schema)


def _tables(batches, weights, vec: str, label: str):
    import pyarrow as pa
    total: dict[tuple[int, int, int], int] = {}
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch.column(vec)), np.asarray(batch.column(label)).astype(np.int64)
            for i, w in enumerate(weights.value):
                got = logits(w, x).argmax(axis=1)
                pair, n = np.unique(np.stack([y, got]), axis=1, return_counts=True)
                for (a, b), k in zip(pair.T.tolist(), n.tolist(), strict=True):
                    total[i, a, b] = total.get((i, a, b), 0) + k
    if total:
        keys = np.array(list(total), np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, j]) for j in range(3)), pa.array(list(total.values()), pa.int64())],
                                         names=["run", "actual", "predicted", "n"])


def compare_runs(df: DataFrame, heads: dict[Run, list[np.ndarray]], vec: str, label: str) -> DataFrame:
    """(epochs, rate, batch, rows, accuracy, f1, best): all runs scored in one pass over ``df``.

    ``f1`` weighs the classes by their rows.  ``best``: highest f1, then accuracy, then the first in
    the order (epochs, rate, batch).
    """
    from pyspark.sql import Window
    spark = df.sparkSession
    runs = sorted(heads)
    shared = spark.sparkContext.broadcast([heads[r] for r in runs])
    rows = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(vec, label)
    counts = (rows.mapInArrow(partial(_tables, weights=shared, vec=vec, label=label),
                              "run long, actual long, predicted long, n long")
              .groupBy("run", "actual", "predicted").agg(F.sum("n").alias("n")))
    side = F.explode(F.array(F.struct(F.col("actual").alias("c"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
                             F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"))))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    per = (counts.select("run", side.alias("s"), hit.alias("hit")).groupBy("run", F.col("s.c").alias("c"))
           .agg(F.sum("s.real").alias("real"), F.sum("s.said").alias("said"), (F.sum("hit") / 2).alias("hit")))
    scored = per.groupBy("run").agg(F.sum("real").alias("rows"), (F.sum("hit") / F.sum("real")).alias("accuracy"),
                                    (F.sum(F.col("real") * 2 * F.col("hit") / (F.col("real") + F.col("said"))) / F.sum("real")).alias("f1"))
    names = spark.createDataFrame([(i, r.epochs, r.rate, r.batch) for i, r in enumerate(runs)],
                                  "run long, epochs int, rate double, batch int")
    order = Window.orderBy(F.desc("f1"), F.desc("accuracy"), "epochs", "rate", "batch")      # one row a run
    return (names.join(scored, "run").withColumn("best", F.row_number().over(order) == 1).drop("run"))
