"""G2 (MLM pretraining corpus), G3 (phenotype-annotation dataset), G8 (pretraining blocks).

G2: notes minus annotated notes (J4) + report texts (X1, ROW_ID missing on reports)
    -> clean 'mlm' (T8) -> exact-text distinct (W3) -> exact 90/10 holdout (U3).
G3: sure annotations (P9) -> annotated notes (J5) with their labels (J6, one row per
    annotation) -> clean 'mlm' -> 0/1 label vector (E5) -> 80/20 hash split (U2).
G8: corpus -> tokens (Q1) -> vocabulary (A15) -> ids (Q2) -> packed blocks (Q9)
    -> masked-LM inputs (Q11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.text import clean_text
from clinloom.operators.dedupe import distinct_corpus
from clinloom.operators.filters import drop_unsure
from clinloom.operators.joins import attach_annotations, exclude_annotated, only_annotated
from clinloom.operators.labels import one_hot_columns
from clinloom.operators.sampling import holdout, sample_n, split_hash
from clinloom.operators.sequences import build_vocab, encode, mask_tokens, pack_blocks, tokenize
from clinloom.session import materialise


def union_corpora(notes: DataFrame, reports: DataFrame) -> DataFrame:
    """Concatenate tables with unequal columns (missing columns become null)."""
    return notes.unionByName(reports, allowMissingColumns=True)


def mlm_corpus(notes: DataFrame, reports: DataFrame, annotations: DataFrame, seed: int = 42,
               val_size: float = 0.10) -> DataFrame:
    """Distinct cleaned texts with a ``split`` column (train / validate).

    ``notes``: (row_id, text); ``reports``: (path, text); ``annotations``: (row_id, ...).
    The distinct corpus is written once before the exact split (the split needs its
    size, and the cleaning must not run twice).
    """
    kept = exclude_annotated(notes.select("row_id", "text"), annotations)
    allrows = union_corpora(kept, reports.select("text"))
    cleaned = allrows.where(F.col("text").isNotNull()).select(clean_text(F.col("text"), "mlm").alias("text"))
    corpus = materialise(distinct_corpus(cleaned), "corpus")
    return holdout(corpus, "text", test_size=val_size, seed=seed)


def corpus_sample(corpus: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """Development sample of the deduplicated corpus."""
    return sample_n(corpus, n, "text", seed)


def annotation_dataset(notes: DataFrame, annotations: DataFrame, label_cols: Sequence[str] = ("quality", "toxic"),
                       seed: int = 42, train_frac: float = 0.8) -> DataFrame:
    """row_id, text, label columns, ``labels`` array and ``split``."""
    sure = drop_unsure(annotations)
    n = only_annotated(notes.select("row_id", "text"), sure)
    n = n.withColumn("text", clean_text(F.col("text"), "mlm"))
    rows = attach_annotations(n, sure.select("row_id", *label_cols))
    rows = one_hot_columns(rows, label_cols, "labels")
    return split_hash(rows, "row_id", seed, (("train", train_frac), ("validate", 1.0 - train_frac)))


def pretraining_blocks(corpus: DataFrame, block: int = 128, min_count: int = 1, seed: int = 42,
                       vocab: DataFrame | None = None, mask: bool = True):
    """(blocks, vocab).  ``corpus``: (text) with unique texts; order = md5 of the text."""
    # tokenised once (regex work is the CPU-heavy part) and reused by vocabulary and encoding
    docs = materialise(corpus.select(F.md5(F.col("text")).alias("doc_key"),
                                     tokenize(F.col("text")).alias("tokens")), "tokens")
    if vocab is None:
        vocab = build_vocab(docs, "tokens", min_count=min_count)   # materialised by its rank pass
    ids = encode(docs, "doc_key", ["tokens"], vocab)
    blocks = pack_blocks(ids, "doc_key", "tokens_ids", block, order_is_hash=True)
    if mask:
        vocab_size = int(vocab.agg(F.max("id")).first()[0] or 0) + 1
        blocks = mask_tokens(blocks, "input_ids", "block_id", vocab_size, seed)
    return blocks, vocab
