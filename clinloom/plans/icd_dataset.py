"""G1: notes + diagnosis/procedure codes -> labelled train/validate/test admissions.

Plan shape:
  notes --not-null(P3), category(P4) on the raw columns--> clean(T8, one Project)
        --> written once; first row of each text(W1, on the text's hash: no text shuffled)
        --> bitmap filters (J3): rows that survive, admissions that have codes
        --> per-admission concat(A1, exchange on hadm_id) of what is left
  diag/proc --bitmap filter: admissions that have notes--> seq filter(P5)
        --> per-admission code list(A2, exchange on hadm_id)
  --> 3-way inner join on hadm_id (J3: reuses the three hash partitionings)
  --> written once to the checkpoint folder
  --> exact 60/20/20 split by seeded hash rank (U1: bucket counts + per-bucket ranks)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.text import NOTE_CATEGORIES, clean_text, trim_category
from clinloom.operators.aggregates import codes_by_admission
from clinloom.operators.dedupe import first_rows
from clinloom.operators.filters import drop_missing, filter_category, filter_seq
from clinloom.operators.joins import key_bitmap, labelled_admissions, might_hold
from clinloom.operators.sampling import split_exact, subsample_splits
from clinloom.session import materialise


@dataclass(frozen=True)
class IcdParams:
    """Run parameters, validated up front (reference: a YAML dict + asserts)."""
    diag_or_proc: str = "diag"
    note_category: str = "Discharge summary"
    one_or_all_icds: int | str = 1
    subsampling: bool = False
    seed: int = 42
    require_both: bool = True
    code_column: str = "icd9_code"          # or e.g. "icd10_code": the code column of both code tables

    def __post_init__(self):
        if self.diag_or_proc not in ("diag", "proc"):
            raise ValueError("diag_or_proc must be 'diag' or 'proc'")
        if self.note_category != "all" and self.note_category not in NOTE_CATEGORIES:
            raise ValueError(f"note_category must be one of {NOTE_CATEGORIES} or 'all'")
        if self.one_or_all_icds != "all" and not isinstance(self.one_or_all_icds, int):
            raise ValueError("one_or_all_icds must be an int or 'all'")


def clean_notes(notes: DataFrame, profile: str = "icd", text: str = "text") -> DataFrame:
    """T8 over a notes table (one Project; Catalyst fuses the whole chain)."""
    return notes.withColumn(text, clean_text(F.col(text), profile))


def thin_notes(notes: DataFrame, survivors: DataFrame, coded: Sequence[DataFrame] = ()) -> DataFrame:
    """Notes that may be in the result: row ids among ``survivors``, admissions in each of ``coded``.

    Bitmaps of fixed size, broadcast; what they let pass by chance goes in the joins that follow.
    """
    for table, key in [(survivors, "row_id"), *((c, "hadm_id") for c in coded)]:
        notes = might_hold(notes, key, key_bitmap(table, key))
    return notes


def surviving_notes(notes: DataFrame, category: str, cleaned: bool = True) -> tuple[DataFrame, DataFrame]:
    """P3 -> P4 -> (T8) -> W1 over notes (row_id, hadm_id, category, text): the cleaned notes and the
    (row_id, hadm_id) of those that survive the dedupe.

    The not-null and category predicates run on the raw columns, before cleaning:
    cleaning keeps null-ness, and a predicate on the cleaned text would be pushed
    below the projection and evaluate the whole regex chain twice.  The cleaned notes are
    written once; which rows survive the dedupe is decided on hashes, and the texts are
    shuffled a single time, by admission.
    """
    n = drop_missing(notes.select("row_id", "hadm_id", "category", "text"), ["hadm_id", "text"])
    n = filter_category(n, category)
    if not cleaned:
        n = clean_notes(n, "icd")
    n = materialise(n.withColumn("category", trim_category(F.col("category"))), "notes")
    return n, materialise(first_rows(n), "survivors")


def concat_survivors(n: DataFrame, first: DataFrame, coded: Sequence[DataFrame] = ()) -> DataFrame:
    """A1 over the two tables of :func:`surviving_notes`.

    ``coded``: tables of admissions outside which no note is needed.  Texts of duplicates and
    of admissions without codes are dropped before any text is shuffled.
    """
    keep = first.groupBy("hadm_id").agg(F.collect_list("row_id").alias("_keep"))
    items = thin_notes(n, first, coded).groupBy("hadm_id").agg(F.sort_array(F.collect_list(F.struct("row_id", "text", "category"))).alias("_items"))
    kept = F.filter(F.col("_items"), lambda x: F.array_contains(F.col("_keep"), x["row_id"]))
    rows = items.join(keep, "hadm_id").select("hadm_id", kept.alias("_items"))
    return rows.select("hadm_id", F.array_join(F.col("_items")["text"], " ").alias("text"),
                       F.array_join(F.col("_items")["category"], " ").alias("category"))


def notes_per_admission(notes: DataFrame, category: str, cleaned: bool = True,
                        coded: Sequence[DataFrame] = ()) -> DataFrame:
    """P3 -> P4 -> (T8) -> W1 -> A1: one row per admission with its surviving notes."""
    return concat_survivors(*surviving_notes(notes, category, cleaned), coded)


def icd_labelled(notes: DataFrame, diag: DataFrame, proc: DataFrame, params: IcdParams = IcdParams(),
                 cleaned: bool = False) -> DataFrame:
    """Labelled admissions before splitting: hadm_id, text, category and the code column."""
    n, first = surviving_notes(notes, params.note_category, cleaned=cleaned)
    # codes of admissions without a surviving note go before they are numbered, shuffled or sorted
    noted = key_bitmap(first, "hadm_id")
    d, p = (filter_seq(might_hold(c, "hadm_id", noted), params.one_or_all_icds) for c in (diag, proc))
    needed = (d, p) if params.require_both else (d,) if params.diag_or_proc == "diag" else (p,)
    per_adm = concat_survivors(n, first, needed)
    d, p = (codes_by_admission(c, code=params.code_column) for c in (d, p))
    out = labelled_admissions(per_adm, d, p, params.diag_or_proc, require_both=params.require_both)
    return out.withColumnRenamed("icd9_code", params.code_column)


def icd_dataset(notes: DataFrame, diag: DataFrame, proc: DataFrame, params: IcdParams = IcdParams(),
                cleaned: bool = False) -> DataFrame:
    """G1 (flagship): labelled admissions with an exact 60/20/20 ``split`` column."""
    # Written once to the checkpoint folder: the split needs the row count before it
    # can cut, and the cleaning upstream must not run twice.
    labelled = materialise(icd_labelled(notes, diag, proc, params, cleaned), "labelled")
    out = split_exact(labelled, "hadm_id", seed=params.seed)
    if params.subsampling:
        out = subsample_splits(out, {"train": 80, "validate": 20, "test": 20}, "hadm_id", params.seed)
    return out
