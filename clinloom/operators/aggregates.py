"""Aggregations.

Per-key lists are built with ``collect_list(struct(order, value))`` + ``sort_array``:
Spark has no input order, so the order key is explicit (``row_id`` for notes,
``(seq_num, code)`` for codes).  Count/sum style aggregates are partial (map-side
combine), so a hot key collapses before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_concat(df: DataFrame, key: str, order: str, fields: dict[str, Column], sep: str = " ") -> DataFrame:
    """Per ``key``: each field's non-null values joined with ``sep`` in ``order`` (+ ``n`` rows).

    One shuffle on the key.  The result holds one value per key, so a key's rows meet in
    one row whatever the plan; the list is built there and nowhere else.
    """
    item = F.struct(F.col(order).alias("_o"), *[c.alias(n) for n, c in fields.items()])
    lst = F.sort_array(F.collect_list(item))
    return df.groupBy(key).agg(*[F.array_join(lst.getField(n), sep).alias(n) for n in fields],
                               F.count(F.lit(1)).alias("n"))


def concat_by_admission(notes: DataFrame, key: str = "hadm_id", order: str = "row_id",
                        text: str = "text", category: str = "category", sep: str = " ",
                        category_value: str | None = None) -> DataFrame:
    """A1: per admission, texts (and categories) joined with ``sep`` in ``order``.

    The category column ends up as the category name repeated once per note, as in
    the reference.  When every note has the same category (``category_value``), the
    column is not carried through the shuffle.  Output: key, text, category, n_notes.
    """
    fields = {text: F.col(text)}
    if category_value is None:
        fields[category] = F.col(category)
    out = ordered_concat(notes, key, order, fields, sep)
    cat = (F.col(category) if category_value is None
           else F.array_join(F.array_repeat(F.lit(category_value), F.col("n").cast("int")), sep))
    return out.select(key, F.col(text), cat.alias(category), F.col("n").cast("bigint").alias("n_notes"))


def codes_by_admission(codes: DataFrame, key: str = "hadm_id", seq: str = "seq_num",
                       code: str = "icd9_code") -> DataFrame:
    """A2 + W4: ordered code list per admission: key, code_list (array), codes (comma string).

    Null codes are left out as the list is built: a filter on the code would keep a semi-join
    on the admission from moving below the window that numbers the codes.
    """
    item = F.when(F.col(code).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(code).alias("c")))
    lst = F.sort_array(F.collect_list(item))
    return (codes.groupBy(key)
             .agg(lst.getField("c").alias("code_list"))
             .where(F.size("code_list") > 0)
             .select(key, "code_list", F.array_join("code_list", ",").alias("codes")))


def code_positions(codes: DataFrame, key: str = "hadm_id", seq: str = "seq_num", code: str = "icd9_code",
                   position: str = "position") -> DataFrame:
    """1-based position of each code within its admission (insertion order = seq, code).

    The window is partitioned by admission: a group is one admission's codes.
    """
    w = Window.partitionBy(key).orderBy(F.col(seq), F.col(code))
    return codes.where(F.col(code).isNotNull()).withColumn(position, F.row_number().over(w))


def join_non_null(columns: Sequence[str], sep: str = ",") -> Column:
    """``sep.join(x.dropna())`` across columns of one row."""
    return F.array_join(F.array_compact(F.array(*[F.col(c).cast("string") for c in columns])), sep)


def pivot_codes(code_lists: DataFrame, prefix: str, n: int | None = None, key: str = "hadm_id",
                list_col: str = "code_list") -> DataFrame:
    """A3: wide ``{prefix}1..n`` columns from the ordered list; short rows padded with null.

    ``n`` defaults to the longest list (one small aggregate).  No shuffle beyond A2.
    """
    if n is None:
        n = code_lists.agg(F.max(F.size(list_col))).first()[0] or 0
    cols = [F.get(F.col(list_col), i).alias(f"{prefix}{i + 1}") for i in range(n)]
    return code_lists.select(key, *cols)


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """A4: frequency of each label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """A5: the set of labels (sorted at the sink)."""
    return df.select(label).where(F.col(label).isNotNull()).distinct()


def label_density(df: DataFrame, label: str) -> DataFrame:
    """Share of rows per label (categorical histogram, probability density).

    The total comes from a window over the aggregated table, whose size is the number
    of distinct labels (a code system), not the number of rows.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy()))


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words (``len(text.split())``)."""
    t = F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def length_profile(df: DataFrame, text: str = "text", token_count: Column | None = None,
                   quantiles: Sequence[float] = ()) -> DataFrame:
    """Mean / sample std / max of words, characters (and tokens) per document.

    ``quantiles`` adds approximate percentiles (``percentile_approx``, a mergeable
    sketch) as ``<measure>_p<q*100>`` columns.
    """
    measures = {"words": word_count(F.col(text)), "chars": F.length(text)}
    if token_count is not None:
        measures["tokens"] = token_count
    aggs = []
    for name, m in measures.items():
        aggs += [F.avg(m).alias(f"{name}_mean"), F.stddev_samp(m).alias(f"{name}_std"), F.max(m).alias(f"{name}_max")]
        aggs += [F.percentile_approx(m, q).alias(f"{name}_p{round(q * 100)}") for q in quantiles]
    return df.agg(*aggs)


def row_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per source / split."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
