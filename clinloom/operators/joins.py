"""Joins (J1-J12).

Every join is an equi-join.  Broadcast is used in three ways only:
  * ``sized_broadcast``: one aggregate adds up the side's bytes before the hint is added;
    beyond the bound the join is left to the planner (sort-merge, or AQE's runtime
    broadcast when the shuffle output turns out small).
  * sides whose size is bounded by construction (a label list of k entries);
  * bitmaps of a fixed number of bits (``key_bitmap``), which thin out rows before a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.session import materialise

BROADCAST_BYTES = 64 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the rows' values: one aggregate over all rows (partial sums, one row per task)."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(16)
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + F.lit(16)
        else:
            size = size + F.lit(16)
    return df.agg(F.sum(size)).first()[0] or 0


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the rows of ``df`` hold at most ``max_bytes`` bytes."""
    return stored_bytes(df) <= max_bytes


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if the byte bound holds, else ``df`` unchanged (the planner decides)."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def combine_codes(diag: DataFrame, proc: DataFrame, key: str = "hadm_id", strict: bool = True) -> DataFrame:
    """Per-admission diagnosis and procedure code lists side by side.

    The reference runs a full outer join and then drops incomplete rows, which is an
    inner join; ``strict=False`` keeps the outer join (D5 option).
    """
    return diag.join(proc, on=key, how="inner" if strict else "full")


def attach_codes(notes: DataFrame, codes: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Left join + drop incomplete rows == inner join."""
    return notes.join(codes, on=key, how="inner")


def labelled_admissions(notes: DataFrame, diag: DataFrame, proc: DataFrame, target: str = "diag",
                        key: str = "hadm_id", require_both: bool = True) -> DataFrame:
    """Notes per admission with the requested code string.

    An admission needs notes, a diagnosis and a procedure (reference behaviour) unless
    ``require_both=False``.  All three inputs are keyed by ``key``; when they come out
    of aggregations on that key the join reuses their hash partitioning (no new
    exchange).
    """
    if target not in ("diag", "proc"):
        raise ValueError("target must be 'diag' or 'proc'")
    d = diag.select(key, F.col("codes").alias("diag_codes"))
    p = proc.select(key, F.col("codes").alias("proc_codes"))
    if require_both:
        joined = notes.join(d, key, "inner").join(p, key, "inner")
    else:
        joined = notes.join(d if target == "diag" else p, key, "inner")
    keep = "diag_codes" if target == "diag" else "proc_codes"
    return joined.select(*notes.columns, F.col(keep).alias("icd9_code"))


def exclude_annotated(notes: DataFrame, ann: DataFrame, key: str = "row_id") -> DataFrame:
    """Notes without any annotation (anti-join)."""
    return notes.join(ann.select(key), on=key, how="left_anti")


def only_annotated(notes: DataFrame, ann: DataFrame, key: str = "row_id") -> DataFrame:
    """Notes with at least one annotation (semi-join)."""
    return notes.join(ann.select(key), on=key, how="left_semi")


def attach_annotations(notes: DataFrame, ann: DataFrame, key: str = "row_id") -> DataFrame:
    """Left join; a note repeats once per annotation."""
    return notes.join(ann, on=key, how="left")


def describe_codes(dx: DataFrame, dictionary: DataFrame, safe: bool = False,
                   code: str = "icd_code", version: str = "icd_version",
                   title: str = "long_title") -> DataFrame:
    """Add the long title of each code.

    Reference mode joins on the code alone (a code present under two versions fans
    out); ``safe=True`` joins on (code, version).  The dictionary is a code system
    (bounded); it is broadcast only after the size check.
    """
    keys = [code, version] if safe else [code]
    d = dictionary.select(*keys, title)
    return dx.join(sized_broadcast(d), on=keys, how="inner")


def assemble_studies(records: DataFrame, metadata: DataFrame, studies: DataFrame) -> DataFrame:
    """Record list x DICOM metadata x study list, without ``_x/_y`` collisions.

    Output: subject_id, study_id, dicom_id, study_date, study_time, text_path.
    """
    r = records.alias("r")
    m = metadata.alias("m")
    s = studies.alias("s")
    return (r.join(m, F.col("r.dicom_id") == F.col("m.dicom"), "inner")
             .join(s, F.col("r.study_id") == F.col("s.study_id"), "inner")
             .select(F.col("r.subject_id").alias("subject_id"), F.col("r.study_id").alias("study_id"),
                     F.col("r.dicom_id").alias("dicom_id"), F.col("m.study_date").alias("study_date"),
                     F.col("m.study_time").alias("study_time"), F.col("s.path").alias("text_path")))


def hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: int) -> DataFrame:
    """(keys, ``_a``, ``_b``): keys that more than ``pairs`` row pairs share, and the grid to cut them by.

    One narrow aggregate over both sides counts rows per key.  The left rows of a key are cut
    into ``_a`` shares and the right ones into ``_b``, so that no cell of the grid exceeds ``pairs``.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = (left.select(*keys, one.alias("_n"), none.alias("_m"))
            .unionByName(right.select(*keys, none.alias("_n"), one.alias("_m"))))
    side = max(1, math.isqrt(pairs))
    n, m = F.col("_n").cast("double"), F.col("_m").cast("double")
    # a short side is kept whole and the long one cut the finer
    a = F.ceil(F.when(m < side, n * m / pairs).otherwise(n / side))
    b = F.ceil(F.when(n < side, n * m / pairs).otherwise(m / side))
    return (both.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m")).where(n * m > pairs)
            .select(*keys, F.when(n < side, 1).otherwise(a).cast("int").alias("_a"),
                    F.when(m < side, 1).otherwise(b).cast("int").alias("_b")))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: int = 1 << 22) -> DataFrame:
    """Inner join on ``keys``; keys that more than ``pairs`` row pairs share are spread over a measured grid.

    A left row of such a key goes to one of ``_a`` shares and meets all ``_b`` shares of the right
    side, and the other way round: every pair meets in exactly one cell.  Shares follow a
    hash of the whole row, so a task that runs again sends its rows the same way (rows
    equal in every column stay together).  Other keys take part once.  Null keys match nothing.
    """
    keys = list(keys)
    hot = materialise(hot_keys(left, right, keys, pairs), "hot-keys")
    if hot.isEmpty():
        return left.join(right, on=keys, how="inner")
    hot = sized_broadcast(hot)

    def spread(df, own, other):
        share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce(F.col(own), F.lit(1)))
        cells = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return (df.join(hot, keys, "left").withColumn("_share", share.cast("int")).withColumn("_cell", F.explode(cells))
                .select(*df.columns, F.col("_share").alias(own), F.col("_cell").alias(other)))

    kept = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return (spread(left, "_a", "_b").join(spread(right, "_b", "_a"), on=[*keys, "_a", "_b"], how="inner")
            .select(*keys, *kept))


def link_same_day(orders: DataFrame, studies: DataFrame, keys: Sequence[str] = ("subject_id", "day"),
                  pairs: int = 1 << 22) -> DataFrame:
    """Every order with every study of the same patient on the same day (many-to-many).

    A patient-day with very many orders and studies is a hot key whose pairs one task would
    write; above ``pairs`` it is spread by :func:`salted_join`.
    """
    return salted_join(orders, studies, keys, pairs)


BLOOM_LOG2 = 24


def key_bitmap(df: DataFrame, key: str, log2: int = BLOOM_LOG2) -> DataFrame:
    """(word, bits): a one-hash Bloom filter of the values of ``key``, 2**``log2`` bits at any input size."""
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << log2))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return (df.where(F.col(key).isNotNull()).groupBy(F.shiftright(h, 6).cast("int").alias("_word"))
            .agg(F.bit_or(bit).alias("_bits")))


def might_hold(df: DataFrame, key: str, bitmap: DataFrame, log2: int = BLOOM_LOG2) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the bitmap: never too few, some too many; null keys go.

    The bitmap has at most 2**(``log2`` - 6) rows of 12 bytes, so it is broadcast whatever the data.
    A semi-join on ``key`` alone: the planner may take it below a window or grouping by ``key``.
    """
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << log2))
    at = h.bitwiseAND(F.lit(63)).cast("int")
    held = (F.shiftright(h, 6).cast("int") == F.col("_word")) & (F.call_function("getbit", F.col("_bits"), at) == 1)
    return df.where(F.col(key).isNotNull()).join(F.broadcast(bitmap), held, "left_semi")


def attach_primary_dx(linked: DataFrame, dx: DataFrame, keys: Sequence[str] = ("subject_id", "hadm_id")) -> DataFrame:
    """Composite equi-join with diagnoses."""
    return linked.join(dx, on=list(keys), how="inner")


def attach_report_text(linked: DataFrame, reports: DataFrame, path_col: str = "text_path",
                       how: str = "inner") -> DataFrame:
    """Replace per-row ``open(path)`` with an equi-join on the path.

    ``reports`` holds (path, text).  Use :func:`unmatched_paths` with an expectation to
    fail like the reference does on a missing file.
    """
    rep = reports.select(F.col("path").alias(path_col), F.col("text").alias("study_text"))
    return linked.join(rep, on=path_col, how=how)


def unmatched_paths(linked: DataFrame, reports: DataFrame, path_col: str = "text_path") -> DataFrame:
    return linked.select(path_col).join(reports.select(F.col("path").alias(path_col)), path_col, "left_anti")


def translate_codes(codes: DataFrame, mapping: DataFrame, code: str = "icd9_code",
                    source: str = "icd9", target: str = "icd10") -> DataFrame:
    """Map codes through a (bounded) crosswalk; unmapped codes keep a null target."""
    m = mapping.select(F.col(source).alias(code), F.col(target))
    return codes.join(sized_broadcast(m), on=code, how="left")
