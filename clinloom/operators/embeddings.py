"""Document vectors and the classification head (M1, M5, M6).

Pooling sums whole token vectors per document with a mergeable aggregate, so a very long
document is combined map-side and shuffled once.  The head is Spark ML (distributed
L-BFGS / gradient aggregation), trained on frozen document vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(df: DataFrame, by: str = "doc", vec: str = "embedding", is_pad: str = "is_pad",
              denominator: str = "tokens", out_col: str = "pooled") -> DataFrame:
    """M1: per document, the mean of its non-padding token vectors.

    ``denominator='tokens'`` divides by the number of real tokens (padding zeroed and
    excluded); ``'padded'`` divides by all positions (the padded-length reading, D14).
    A document made only of padding gets a null vector.  The vector sum is a mergeable
    aggregate: partial sums of whole vectors are shuffled once, by document.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    if denominator not in ("tokens", "padded"):
        raise ValueError("denominator must be 'tokens' or 'padded'")
    real = ~F.coalesce(F.col(is_pad), F.lit(False))
    v = F.col(vec).cast("array<double>")
    kept = F.when(real, v).otherwise(F.transform(v, lambda _: F.lit(0.0)))
    rows = df.select(by, real.alias("_real"), array_to_vector(kept).alias("_v"))
    out = rows.groupBy(by).agg(Summarizer.sum(F.col("_v")).alias("_s"), F.count_if(F.col("_real")).alias("n_tokens"),
                               F.count(F.lit(1)).alias("_na"))
    den = F.col("n_tokens") if denominator == "tokens" else F.col("_na")
    mean = F.transform(vector_to_array("_s"), lambda x: F.when(den > 0, x / den))
    return out.select(by, mean.alias(out_col), "n_tokens")


def to_features(df: DataFrame, vec: str, out_col: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out_col, array_to_vector(F.col(vec).cast("array<double>")))


def train_head(df: DataFrame, vec: str, label: str = "label", kind: str = "logistic",
               grid: dict[str, Sequence] | None = None, metric: str = "f1", seed: int = 3,
               train_ratio: float = 0.8, max_iter: int = 50):
    """M6: classifier on frozen vectors; with ``grid``, the best run by ``metric`` on a
    validation split (TrainValidationSplit).  Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    data = to_features(df, vec).select("features", F.col(label).cast("double").alias("label"))
    if kind == "logistic":
        est = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter)
    elif kind == "mlp":
        n_in = len(df.select(vec).first()[0])
        n_out = int(df.agg(F.max(label)).first()[0]) + 1
        est = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", maxIter=max_iter,
                                             layers=[n_in, 2 * n_in, n_in, n_out], seed=seed)
    else:
        raise ValueError("kind must be 'logistic' or 'mlp'")
    if not grid:
        return est.fit(data)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    tvs = TrainValidationSplit(estimator=est, estimatorParamMaps=builder.build(),
                               evaluator=MulticlassClassificationEvaluator(metricName=metric),
                               trainRatio=train_ratio, seed=seed)
    return tvs.fit(data).bestModel


def predict(df: DataFrame, model, vec: str, out_col: str = "predicted") -> DataFrame:
    """M5: batch scoring; the prediction is a 0-based class id (decode with E4)."""
    scored = model.transform(to_features(df, vec))
    return scored.withColumn(out_col, F.col("prediction").cast("int")).drop("features", "rawPrediction",
                                                                            "probability", "prediction")
