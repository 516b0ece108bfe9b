"""Label encoding and top-k label selection.

Label tables are usually small (k labels, a class list); joins broadcast them after a
check of their bytes; label frequencies are computed with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The NLI class list and its ids (sorted order of the three names).
NLI_LABELS: tuple[str, ...] = ("contradiction", "entailment", "neutral")


def top_labels(train: DataFrame, k: int = 50, label: str = "label") -> DataFrame:
    """L2: the k most frequent labels of the training rows; ties broken by label.

    A distributed top-k (partial counts, then TakeOrderedAndProject): the limit is the
    operator itself.  Output: label, n.
    """
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(label)).limit(k)


def filter_top_labels(df: DataFrame, top: DataFrame, label: str = "label") -> DataFrame:
    """L3 (+P6): keep rows whose label is one of the given labels (semi-join; broadcast after a size check)."""
    from clinloom.operators.joins import sized_broadcast
    return df.join(sized_broadcast(top.select(label)), on=label, how="left_semi")


def fit_labels(labels: DataFrame, label: str = "label", id_col: str = "label_id") -> DataFrame:
    """id = position in the sorted list of distinct labels (the distributed rank)."""
    from clinloom.operators.ranking import global_rank
    distinct = labels.select(label).where(F.col(label).isNotNull()).distinct()
    return global_rank(distinct, [label], rank_col=id_col).withColumn(id_col, F.col(id_col).cast("int"))


def fixed_labels(spark, names: Sequence[str] = NLI_LABELS, label: str = "label", id_col: str = "label_id") -> DataFrame:
    """A fixed label list as a table (id = list position)."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{label} string, {id_col} int")


def label_map_expr(c: Column, names: Sequence[str] = NLI_LABELS) -> Column:
    """E2 as an expression: ``create_map`` lookup, null when unknown."""
    pairs = []
    for i, n in enumerate(names):
        pairs += [F.lit(n), F.lit(i)]
    return F.create_map(*pairs)[c]


def encode_labels(df: DataFrame, labels: DataFrame, label: str = "label", id_col: str = "label_id",
                  on_unknown: str = "error") -> DataFrame:
    """Attach the label id.

    ``on_unknown``: ``'error'`` fails the job on a label missing from the table (the
    reference raises), ``'drop'`` removes such rows, ``'keep'`` leaves a null id.
    """
    if on_unknown not in ("error", "drop", "keep"):
        raise ValueError("on_unknown must be 'error', 'drop' or 'keep'")
    from clinloom.operators.joins import sized_broadcast
    lab = sized_broadcast(labels.select(label, id_col))   # label tables are small; checked
    if on_unknown == "drop":
        return df.join(lab, on=label, how="inner")
    out = df.join(lab, on=label, how="left")
    if on_unknown == "error":
        out = out.withColumn(id_col, F.when(F.col(id_col).isNull(),
                                            F.raise_error(F.concat(F.lit("unknown label: "),
                                                                   F.coalesce(F.col(label).cast("string"), F.lit("null")))))
                             .otherwise(F.col(id_col)))
    return out


def decode_labels(df: DataFrame, labels: DataFrame, id_col: str = "predicted", label: str = "label",
                  out_col: str = "predicted_label") -> DataFrame:
    """Id -> label name (broadcast of the label table)."""
    from clinloom.operators.joins import sized_broadcast
    lab = labels.select(F.col("label_id").alias(id_col), F.col(label).alias(out_col))
    return df.join(sized_broadcast(lab), on=id_col, how="left")


def one_hot_columns(df: DataFrame, columns: Sequence[str], out_col: str = "labels") -> DataFrame:
    """E5: pack 0/1 columns into one int array (column order = label order)."""
    return df.withColumn(out_col, F.array(*[F.col(c).cast("int") for c in columns]))


def multi_hot(df: DataFrame, codes_col: str, labels: DataFrame, key: str = "hadm_id", label: str = "label",
              id_col: str = "label_id", out_col: str = "labels") -> DataFrame:
    """Comma list of codes -> 0/1 vector over the label table (``label``, ids 0..k-1).

    The label table is joined as data: the codes of each row (unique ``key``) meet their
    ids, and the vector is filled from the ids found.  k may be any number; the vectors
    hold k entries by definition.
    """
    from clinloom.operators.joins import sized_broadcast
    k = labels.count()
    table = labels.select(F.col(label).alias("_code"), F.col(id_col).alias("_id"))
    ids = (df.select(key, F.explode(F.split(F.col(codes_col), ",")).alias("_code"))
             .join(sized_broadcast(table), "_code").groupBy(key).agg(F.collect_set("_id").alias("_ids")))
    place = F.sequence(F.lit(0), F.lit(k - 1)) if k else F.array().cast("array<int>")
    found = F.coalesce(F.col("_ids"), F.array().cast("array<int>"))
    return (df.join(ids, key, "left")
              .withColumn(out_col, F.transform(place, lambda i: F.array_contains(found, i).cast("int"))).drop("_ids"))
