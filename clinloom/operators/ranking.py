"""Exact global ranks and order statistics without a single-partition window.

Helpers, chosen by the shape of the order key and by what is needed:

``bucket_counts`` + ``row_at_rank`` -- only a few cut positions are needed (exact-size
    splits): rows per hash-prefix bucket (a bounded table), then one sorted
    ``offset/limit`` inside the bucket holding each cut; rows then compare themselves
    with the cut rows (``lex_less``) without any shuffle.

``hash_rank``  -- the order key is a uniform hash (seeded md5).  Rows are grouped into
    ``16**bucket_chars`` buckets by the hash prefix; a bucket's offset is the number of
    rows in earlier buckets (a window over the bucket-count table, whose size is bounded
    by the bucket count, not the data) and the rank inside a bucket comes from a window
    partitioned by bucket.  Buckets are balanced because the hash is uniform; the key
    must be unique (rank distinct keys first otherwise).

``global_rank`` -- any total order.  ``repartitionByRange`` cuts the data into sorted,
    balanced partitions; rows are numbered inside each partition from the partition-local
    id generator and written once (so sampled range bounds are fixed and lineage is cut);
    a weight is summed by a window per range partition, and the per-partition totals (one
    row per partition) become offsets that are broadcast back.  Pass narrow rows (key and
    weight) and join the rest.  Ties must be broken by a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.session import materialise


def seeded_hash(seed: int | str, *cols: str | Column) -> Column:
    """md5 hex of ``seed|col1|col2...`` -- the same value as DuckDB's md5 of that string."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_unit(h: Column) -> Column:
    """Map an md5 hex string to [0, 1) from its first 8 hex digits."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_rank(df: DataFrame, hash_col: str, tiebreak: Sequence[str] = (), rank_col: str = "rank",
              total_col: str | None = "n_total", bucket_chars: int = 4, by: Sequence[str] = (),
              weight: str | None = None, offset_col: str = "offset") -> DataFrame:
    """0-based rank of each row ordered by (hash_col, *tiebreak), within groups ``by``.

    Adds the group's row total as ``total_col`` and, with ``weight``, the exclusive
    running sum of the weight in that order as ``offset_col``.  ``by`` must have few
    distinct values (splits): the offset table has (#groups x 16**bucket_chars) rows.
    The input is read twice (bucket totals, then ranks): pass a materialised table when
    it is expensive to recompute.
    """
    b = "__hb"
    by = list(by)
    with_b = df.withColumn(b, F.substring(F.col(hash_col), 1, bucket_chars))
    w = F.col(weight) if weight else F.lit(0)
    counts = with_b.groupBy(*by, b).agg(F.count(F.lit(1)).alias("__n"), F.sum(w).alias("__w"))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*by, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                         F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__woff"),
                         F.sum("__n").over(Window.partitionBy(*by)).alias("__tot"))
    inner = Window.partitionBy(*by, b).orderBy(F.col(hash_col), *[F.col(c) for c in tiebreak])
    ranked = with_b.withColumn("__lr", F.row_number().over(inner) - 1)
    if weight:
        ranked = ranked.withColumn("__lw", F.coalesce(
            F.sum(w).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # bucket count x group count rows: bounded without ``by``, checked with it
    from clinloom.operators.joins import sized_broadcast
    offs = sized_broadcast(offs) if by else F.broadcast(offs)
    out = ranked.join(offs, [*by, b]).withColumn(rank_col, (F.col("__off") + F.col("__lr")).cast("bigint"))
    if weight:
        out = out.withColumn(offset_col, (F.col("__woff") + F.col("__lw")).cast("bigint"))
    if total_col:
        out = out.withColumn(total_col, F.col("__tot").cast("bigint"))
    return out.drop(b, "__off", "__woff", "__lr", "__lw", "__tot")


def global_rank(df: DataFrame, order_cols: Sequence[str], weight: str | None = None,
                rank_col: str = "rank", offset_col: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """0-based global rank by ``order_cols`` (and exclusive prefix sum of ``weight``).

    ``order_cols`` must form a unique key.  Adds ``rank_col`` and, with ``weight``, the
    exclusive running sum ``offset_col`` (sum of weights of all earlier rows).
    """
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n_parts, *[F.col(c) for c in order_cols]).sortWithinPartitions(*order_cols)
    # Row numbers inside each sorted range partition, on the JVM: the id generator counts
    # rows per partition in iteration order (upper bits = partition index).
    pid = F.spark_partition_id()
    numbered = materialise(parted.withColumn("_pid", pid)
                           .withColumn("_lr", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)),
                           "ranked")
    lw = F.lit(0).cast("bigint")
    if weight is not None:
        before = Window.partitionBy("_pid").orderBy("_lr").rowsBetween(Window.unboundedPreceding, -1)
        lw = F.coalesce(F.sum(weight).over(before), F.lit(0)).cast("bigint")
    return _apply_offsets(numbered.withColumn("_lw", lw), numbered, weight, rank_col, offset_col)


def _apply_offsets(numbered: DataFrame, rows: DataFrame, wname: str | None, rank_col: str,
                   offset_col: str | None) -> DataFrame:
    totals = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                          F.sum(F.col(wname) if wname else F.lit(0)).alias("_w"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rb"),
                         F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_wb"))
    # one row per range partition: bounded by n_parts.
    out = numbered.join(F.broadcast(offs), "_pid").withColumn(rank_col, (F.col("_rb") + F.col("_lr")).cast("bigint"))
    if wname is not None:
        out = out.withColumn(offset_col or "offset", (F.col("_wb") + F.col("_lw")).cast("bigint"))
    return out.drop("_pid", "_lr", "_lw", "_rb", "_wb")


def bucket_counts(df: DataFrame, hash_col: str, bucket_chars: int = 4) -> list[tuple[str, int]]:
    """Rows per hash-prefix bucket, sorted by bucket (at most ``16**bucket_chars`` rows)."""
    b = F.substring(F.col(hash_col), 1, bucket_chars)
    return sorted((r[0], r[1]) for r in df.groupBy(b.alias("_b")).agg(F.count(F.lit(1))).collect())


def row_at_rank(df: DataFrame, hash_col: str, tiebreak: Sequence[str], counts: list[tuple[str, int]],
                k: int) -> tuple | None:
    """Values of (hash_col, *tiebreak) of the row at 0-based rank ``k`` in that order.

    For a uniform hash order: the bucket holding rank ``k`` is found from ``counts``
    (see :func:`bucket_counts`), then a sorted ``offset/limit`` runs inside that single
    bucket (about n / 16**bucket_chars rows).  ``None`` when ``k`` is outside the rows.
    """
    if k < 0:
        return None
    bucket_chars = len(counts[0][0]) if counts else 4
    before = 0
    for bucket, c in counts:
        if k < before + c:
            b = F.substring(F.col(hash_col), 1, bucket_chars)
            row = (df.where(b == F.lit(bucket)).select(hash_col, *tiebreak)
                     .orderBy(hash_col, *tiebreak).offset(k - before).limit(1).collect())
            return tuple(row[0])
        before += c
    return None


def lex_less(cols: Sequence[str], values: tuple | None) -> Column:
    """Row order (cols...) strictly below ``values``; ``None`` means +infinity."""
    if values is None:
        return F.lit(True)
    cond = None
    for i in range(len(cols) - 1, -1, -1):
        here = F.col(cols[i]) < F.lit(values[i])
        cond = here if cond is None else here | ((F.col(cols[i]) == F.lit(values[i])) & cond)
    return cond
