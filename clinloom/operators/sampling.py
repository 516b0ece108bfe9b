"""Sampling, splitting, batching.

Randomness is a seeded md5 of the row key, so every result is reproducible, identical
under any partitioning, and computable by DuckDB for the oracle.  pandas' Mersenne
draws cannot be reproduced; sizes and seeding discipline are what carry over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.operators.ranking import global_rank, hash_rank, hash_unit, bucket_counts, lex_less, row_at_rank, seeded_hash


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def split_exact(df: DataFrame, key: str | Sequence[str], seed: int = 42, test_frac: float = 0.2,
                val_frac_of_pool: float = 0.25, split_col: str = "split",
                names: tuple[str, str, str] = ("train", "validate", "test")) -> DataFrame:
    """Exact-size train / validate / test split (60/20/20 by default), key must be unique.

    Rows are ordered by md5(seed|key); the first ``val`` ranks are validation, the rest
    of the pool is training, the remainder test.  Only the two rows at the cut ranks
    are located (:func:`row_at_rank`: bucket counts, then one bucket each); every row
    then compares itself with them -- a map-only pass, the rows are never shuffled.
    Read twice, so pass a materialised table.
    """
    ks = _keys(key)
    h = "_h"
    hashed = df.withColumn(h, seeded_hash(seed, *ks))
    counts = bucket_counts(hashed, h)
    n = sum(c for _, c in counts)
    pool = round(n * (1.0 - test_frac))          # Python round: half to even, like pandas
    val = round(pool * val_frac_of_pool)
    cut_val, cut_pool = (row_at_rank(hashed, h, ks, counts, k) for k in (val, pool))
    train_name, val_name, test_name = names
    order = [h, *ks]
    part = (F.when(lex_less(order, cut_val), F.lit(val_name))
             .when(lex_less(order, cut_pool), F.lit(train_name))
             .otherwise(F.lit(test_name)))
    return hashed.withColumn(split_col, part).drop(h)


def split_hash(df: DataFrame, key: str | Sequence[str], seed: int = 42,
               fractions: Sequence[tuple[str, float]] = (("train", 0.6), ("validate", 0.2), ("test", 0.2)),
               split_col: str = "split") -> DataFrame:
    """Approximate-size split from a hash bucket; stable as the data grows, no shuffle."""
    u = hash_unit(seeded_hash(seed, *_keys(key)))
    expr = None
    cum = 0.0
    for i, (name, frac) in enumerate(fractions):
        cum += frac
        if i == len(fractions) - 1:
            expr = F.lit(name) if expr is None else expr.otherwise(F.lit(name))
        else:
            expr = F.when(u < F.lit(cum), F.lit(name)) if expr is None else expr.when(u < F.lit(cum), F.lit(name))
    return df.withColumn(split_col, expr)


def holdout(df: DataFrame, key: str | Sequence[str], test_size: float = 0.10, seed: int = 42,
            split_col: str = "split", names: tuple[str, str] = ("train", "validate")) -> DataFrame:
    """Two-way exact split; the held-out part has ceil(n * test_size) rows (sklearn rule).

    Same cut-row method as :func:`split_exact` (no shuffle of the rows); ties of the first
    hash are broken by a second one, so only hashes reach the driver, never key values."""
    import math
    ks = _keys(key)
    second = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in ks]).cast("binary"), 256)
    hashed = df.withColumns({"_h": seeded_hash(seed, *ks), "_h2": second})
    counts = bucket_counts(hashed, "_h")
    cut = row_at_rank(hashed, "_h", ["_h2"], counts, math.ceil(sum(c for _, c in counts) * test_size))
    part = F.when(lex_less(["_h", "_h2"], cut), F.lit(names[1])).otherwise(F.lit(names[0]))
    return hashed.withColumn(split_col, part).drop("_h", "_h2")


def sample_n(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: the n smallest seeded hashes (distributed top-n)."""
    ks = _keys(key)
    return (df.withColumn("_h", seeded_hash(seed, *ks))
              .orderBy("_h", *ks).limit(n).drop("_h"))


def subsample_splits(df: DataFrame, sizes: dict[str, int], key: str | Sequence[str], seed: int = 42,
                     split_col: str = "split") -> DataFrame:
    """U4: a fixed-size sample of each split (80 / 20 / 20 in the reference).

    One distributed top-n per split (the number of splits is a small constant), so a
    large split is never ordered inside one task.
    """
    out = None
    for name, n in sizes.items():
        part = sample_n(df.where(F.col(split_col) == F.lit(name)), n, key, seed)
        out = part if out is None else out.unionByName(part)
    return out


def shuffle_key(key: str | Sequence[str], seed: int = 42, epoch: int = 0) -> Column:
    """Per-epoch random order key."""
    return seeded_hash(f"{seed}|{epoch}", *_keys(key))


def assign_batches(df: DataFrame, size: int, key: str | Sequence[str], seed: int | None = 42, epoch: int = 0,
                   order: Sequence[str] | None = None, batch_col: str = "batch_id",
                   rank_col: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """U6 + U7: sequential batches of ``size`` rows.

    With ``order=None`` the rows are shuffled by the seeded hash (``hash_rank``, per
    group ``by``); otherwise they follow ``order`` (+ key as tie-break) through
    ``global_rank``.
    """
    ks = _keys(key)
    if order is None:
        ranked = hash_rank(df.withColumn("_h", shuffle_key(ks, seed, epoch)), "_h", ks,
                           rank_col=rank_col, total_col=None, by=by).drop("_h")
    else:
        cols = list(order) + [k for k in ks if k not in order]
        ranked = global_rank(df, cols, rank_col=rank_col)
    return ranked.withColumn(batch_col, F.floor(F.col(rank_col) / F.lit(size)).cast("bigint"))


def bucket_by_length(df: DataFrame, size: int | dict[str, int], length_col: str, key: str | Sequence[str],
                     batch_col: str = "batch_id", split_col: str = "split") -> DataFrame:
    """U8: batches of similar length: rank by (length, key), then cut every ``size`` rows.

    With a dict, every split (``split_col``) is ranked on its own and cut by its own size,
    e.g. ``{"train": 16, "dev": 256, "test": 256}``; rows of other splits are refused.
    """
    if isinstance(size, int):
        return assign_batches(df, size, key, order=[length_col], batch_col=batch_col)
    out = None
    for name, n in size.items():
        part = assign_batches(df.where(F.col(split_col) == F.lit(name)), n, key, order=[length_col],
                              batch_col=batch_col)
        out = part if out is None else out.unionByName(part)
    if not df.where(~F.coalesce(F.col(split_col).isin(list(size)), F.lit(False))).isEmpty():
        raise ValueError("a row's split has no batch size")
    return out


def shard(df: DataFrame, world_size: int, rank_col: str = "position", shard_col: str = "worker") -> DataFrame:
    """Deal ranked rows round-robin to ``world_size`` workers."""
    return df.withColumn(shard_col, F.pmod(F.col(rank_col), F.lit(world_size)).cast("int"))
