"""G5 (NLI pair features), G6 (top-k label dataset), G7 (evaluation).

G5: pairs (S4) -> tokens a/b (Q1) -> vocabulary from the training split (A15) ->
    ids in one encode pass (Q2) -> pair truncation + [CLS] a [SEP] b [SEP] (Q4, Q5) ->
    fixed label ids (E2 / E3).
G6: labelled splits -> top-k labels of train (L2) -> rows with a top label (L3) ->
    label ids by sorted position (E1, E3) -> shuffled batches (U6, U7).
G7: scored rows -> prediction / loss (M3, M4) -> confusion (A9, A10) -> corpus and
    batch-mean metrics (A11-A14) as a long metrics table (K6).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.operators import metrics as M
from clinloom.operators.labels import (NLI_LABELS, encode_labels, filter_top_labels, fit_labels, fixed_labels,
                                       top_labels)
from clinloom.operators.sampling import assign_batches
from clinloom.operators.sequences import build_vocab, encode, pair_features, tokenize
from clinloom.session import materialise


def pair_dataset(pairs: DataFrame, max_len: int = 128, on_unknown: str = "keep", vocab: DataFrame | None = None):
    """(features, vocab).  ``pairs``: pair_id, sentence1, sentence2, gold_label, split."""
    # tokenised once, reused by the vocabulary and the encoding
    tok = materialise(pairs.select("pair_id", "split", "gold_label",
                                   tokenize(F.col("sentence1")).alias("a"),
                                   tokenize(F.col("sentence2")).alias("b")), "pairs")
    if vocab is None:
        train = tok.where(F.col("split") == "train")
        both = train.select(F.concat("a", "b").alias("tokens"))
        vocab = build_vocab(both, "tokens")   # materialised by its rank pass
    ids = encode(tok, "pair_id", ["a", "b"], vocab, carry=["split", "gold_label"])
    feats = pair_features(ids, "a_ids", "b_ids", max_len)
    labels = fixed_labels(pairs.sparkSession, NLI_LABELS, "gold_label", "label_id")
    labelled = encode_labels(feats, labels, "gold_label", "label_id", on_unknown=on_unknown)
    return labelled.select("pair_id", "split", "gold_label", "label_id", "input_ids", "segment_ids",
                           "input_mask", "seq_len"), vocab


def top_label_dataset(rows: DataFrame, k: int = 50, batch_size: int = 12, seed: int = 42,
                      label: str = "label", key: str | list[str] = "hadm_id") -> DataFrame:
    """Rows (key, split, label, ...) restricted to the top-k training labels, with
    ``label_id`` and per-split shuffled ``batch_id``."""
    top = top_labels(rows.where(F.col("split") == "train"), k, label)
    kept = filter_top_labels(rows, top, label)
    # written once: the batch ranking reads it twice (bucket counts, then ranks)
    enc = materialise(encode_labels(kept, fit_labels(top, label), label, "label_id", on_unknown="error"), "labelled")
    return assign_batches(enc, batch_size, key, seed=seed, epoch=0, by=["split"])


def scored_rows(scored: DataFrame) -> DataFrame:
    """M3 + M4 on (actual, logits): argmax prediction and per-row loss."""
    return scored.withColumn("argmax", M.argmax(F.col("logits"))).withColumn(
        "loss", M.cross_entropy(F.col("logits"), F.col("actual")))


def evaluate(scored: DataFrame, predicted: str = "predicted", prefix: str = "test_") -> DataFrame:
    """Long metrics table (metric, value) from scored rows with a batch_id.

    One pass over the scored rows: counts and loss sums per (batch, actual, predicted)
    (a partial aggregate); corpus metrics, batch means and the mean loss all derive from
    that small table.
    """
    s = scored_rows(scored)
    # written once (batches x classes^2 rows): every metric below reads this table
    cells = materialise(s.groupBy("batch_id", "actual", predicted).agg(F.count(F.lit(1)).alias("n"),
                                                                       F.sum("loss").alias("loss_sum")), "cells")
    corpus_cm = cells.groupBy("actual", predicted).agg(F.sum("n").alias("n"))
    corpus = M.weighted_from_stats(M.class_stats_from_confusion(corpus_cm, "actual", predicted)).drop("n")
    per_batch = M.weighted_from_stats(M.class_stats_from_confusion(cells, "actual", predicted, ["batch_id"]),
                                      ["batch_id"])
    batch = M.mean_over_batches(per_batch).drop("n_batches")
    batch = batch.select(*[F.col(c).alias("batch_" + c) for c in batch.columns])
    mean = F.sum("loss_sum") / F.sum("n")
    loss = cells.agg(mean.alias("mean_loss"), (mean / F.lit(math.log(2))).alias("bpc"))
    batch_loss = M.mean_of_batch_losses(cells.groupBy("batch_id").agg(mean.alias("loss")), "loss")
    rows = (M.metrics_long(corpus, prefix)
            .unionByName(M.metrics_long(batch, prefix))
            .unionByName(M.metrics_long(loss, prefix))
            .unionByName(M.metrics_long(batch_loss, prefix)))
    return rows
