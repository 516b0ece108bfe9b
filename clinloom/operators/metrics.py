"""Evaluation: logits -> probabilities, predictions, losses, confusion tables and
support-weighted metrics (M2-M4, A9-A14).

Everything is computed from per-(batch, class) counts: the row data is reduced with
partial aggregation to a table whose size is (#batches x #classes^2), and all metrics
are derived from that small table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """M2: class probabilities (max subtracted first for stability)."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x.cast("double") - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def softmax_percent(logits: Column) -> Column:
    """M2: probabilities as whole percents (Python ``round``: half to even)."""
    return F.transform(softmax(logits), lambda p: F.bround(p * 100, 0).cast("int"))


def argmax(logits: Column) -> Column:
    """M3: 0-based index of the first maximum (numpy semantics)."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def logsumexp(logits: Column) -> Column:
    m = F.array_max(logits).cast("double")
    s = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - m))
    return m + F.log(s)


def cross_entropy(logits: Column, target: Column) -> Column:
    """M4: -log softmax(logits)[target] for a 0-based target id."""
    return logsumexp(logits) - F.get(logits, target).cast("double")


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
              by: Sequence[str] = ()) -> DataFrame:
    """Counts per (by..., actual, predicted)."""
    return df.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def dense_confusion(cm: DataFrame, labels: DataFrame, actual: str = "actual", predicted: str = "predicted",
                    label_id: str = "label_id", max_labels: int = 4096) -> DataFrame:
    """A9 dense form: every (actual, predicted) pair of the label ids, zero-filled.

    The ids may be any values.  The grid has k x k cells by definition, so more than
    ``max_labels`` ids are refused.  Observed pairs with an id outside the list are kept
    as rows of their own.
    """
    ids = [r[0] for r in labels.select(label_id).distinct().orderBy(label_id).limit(max_labels + 1).collect()]
    if len(ids) > max_labels:
        raise ValueError(f"a dense confusion table of more than {max_labels} labels")
    kind = labels.schema[label_id].dataType
    one = labels.select(F.col(label_id).alias(actual)).where(F.col(actual).isNotNull()).distinct()
    grid = one.withColumn(predicted, F.explode(F.array(*[F.lit(i).cast(kind) for i in ids if i is not None])))
    return grid.join(cm, [actual, predicted], "full").fillna(0, subset=["n"])


def normalise_confusion(cm: DataFrame, actual: str = "actual", by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """A10: row-normalised counts rounded half-to-even (numpy ``around``); empty rows -> null."""
    total = F.sum("n").over(Window.partitionBy(*by, actual))
    return cm.withColumn("share", F.when(total > 0, F.bround(F.col("n") / total, digits)))


def class_stats(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                by: Sequence[str] = ()) -> DataFrame:
    """Per (by..., class): tp, predicted count, support -- from the confusion counts."""
    return class_stats_from_confusion(confusion(df, actual, predicted, by), actual, predicted, by)


def class_stats_from_confusion(cm: DataFrame, actual: str = "actual", predicted: str = "predicted",
                               by: Sequence[str] = ()) -> DataFrame:
    """Per (by..., class) tp / predicted count / support from a confusion table (by, actual, predicted, n)."""
    as_actual = cm.groupBy(*by, F.col(actual).alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    as_pred = cm.groupBy(*by, F.col(predicted).alias("cls")).agg(F.sum("n").alias("n_pred"))
    return as_actual.join(as_pred, [*by, "cls"], "full").fillna(0, subset=["support", "tp", "n_pred"])


def weighted_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision / recall / F1 and accuracy (undefined ratios -> 0).

    Weighted recall equals accuracy (sum of tp over all rows) by construction.
    """
    return weighted_from_stats(class_stats(df, actual, predicted, by), by)


def weighted_from_stats(s: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A11 from per-class stats (tp, n_pred, support): support-weighted averages."""
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    s = s.withColumn("p", prec).withColumn("r", rec)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    s = s.withColumn("f1", f1)
    return s.groupBy(*by).agg(
        (F.sum(F.col("p") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.sum("support").cast("bigint").alias("n"))


def batch_mean_metrics(df: DataFrame, batch: str = "batch_id", actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    """Metrics per batch, then the mean over batches (the published test numbers)."""
    return mean_over_batches(weighted_metrics(df, actual, predicted, by=[batch]))


def mean_over_batches(per_batch: DataFrame) -> DataFrame:
    return per_batch.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                         F.avg("f1").alias("f1"), F.avg("accuracy").alias("accuracy"),
                         F.count(F.lit(1)).alias("n_batches"))


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Share of rows whose prediction equals the label (a null prediction is a wrong one)."""
    return df.agg(F.avg(F.coalesce(F.col(actual) == F.col(predicted), F.lit(False)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def mean_loss(df: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean cross-entropy and bits per character/token (loss / ln 2)."""
    return df.agg(F.avg(loss).alias("mean_loss"), (F.avg(loss) / F.lit(math.log(2))).alias("bpc"))


def mean_of_batch_losses(per_batch: DataFrame, loss: str = "loss") -> DataFrame:
    """A14, evaluation-loss form: the mean over batches of each batch's mean loss."""
    return per_batch.agg(F.avg(loss).alias("batch_mean_loss"))


def metrics_long(wide: DataFrame, prefix: str = "test_") -> DataFrame:
    """K6 helper: one (metric, value) row per metric, sorted by name at the sink."""
    cols = [c for c in wide.columns]
    stack = ", ".join(f"'{prefix}{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (metric, value)")
