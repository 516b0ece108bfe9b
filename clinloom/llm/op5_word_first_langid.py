"""Operator 5: language identification, words first, then ever shorter character n-grams.

A word (letters only, lower case) that the training texts hold adds its log frequency in
each language.  An unseen word falls back to its character 5-grams (word ends marked), an
unseen 5-gram's word to 4-grams, and so on to single characters: the longest order with a
known n-gram gives the mean log frequency of those known.  The language with the highest
sum over the whole text wins; ``score`` is its share among the languages' likelihoods.

Learning uses rows with a language and crc32(doc_id) mod 4 != 2: of each language at most
``SAMPLE`` rows, the first by the hash of their id, so the same in every run.  Counts are a
grouped sum; the model keeps every word and n-gram of the sample, as a 64-bit hash and the
languages that hold it, so it grows with the sample, not with the documents.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any
learned row every language is ``und``; ties go to the first language by name; a null
``doc_id`` is never learned from and not held out; rows that repeat are each judged; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import fold, materialise, small_batches
from clinloom.llm.words import SLAB_BYTES, WordTable, byte_hashes, resident, slabs, texts

SAMPLE, TOP, TALLY = 3000, 5, 25_000
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


def _count(batches, lang_no):
    """(order, unit, language, count), order 0 the whole word; partial counts, handed on before
    they grow large."""
    index = lang_no.value
    words: dict[tuple[int, str], int] = {}

    def batch_of():
        tally: dict[tuple[int, str, int], int] = {}
        for (no, w), n in words.items():
            tally[0, w, no] = tally.get((0, w, no), 0) + n
            for k in range(1, TOP + 1):
                for g in grams(w, k):
                    tally[k, g, no] = tally.get((k, g, no), 0) + n
        order, unit, lang = zip(*tally, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int32()), pa.array(unit), pa.array(lang, pa.int32()),
             pa.array(list(tally.values()), pa.int64())], names=["n", "unit", "lang", "count"])

    for batch in batches:
        lang, text = batch.column("lang"), batch.column("text")
        for i in range(batch.num_rows):
            no = index[lang[i].as_py()]
            for w in _LETTERS.findall(text[i].as_py().lower()):
                words[no, w] = words.get((no, w), 0) + 1
            if len(words) > TALLY:
                yield batch_of()
                words.clear()
    if words:
        yield batch_of()


def _hashed(batches):
    """(n, unit, lang, count) with the unit's hash for its name."""
    for batch in batches:
        data, off = texts(batch.column("unit"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("n"), pa.array(byte_hashes(data, off[:-1], off[1:]).view(np.int64)), batch.column("lang"),
             batch.column("count")], names=["n", "unit", "lang", "count"])


def order_of(unit: np.ndarray, lang: np.ndarray, count: np.ndarray, size: np.ndarray) -> dict:
    """One order's units: sorted ``keys``, the languages of key i at ``ptr[i]:ptr[i + 1]`` with what
    they add to ``base``, the log frequency of a unit that a language lacks."""
    by = np.lexsort((lang, unit))
    unit, lang, count = unit[by], lang[by], count[by]
    keys, first = np.unique(unit, return_index=True)
    return {"keys": keys, "ptr": np.append(first, len(unit)), "lang": lang.astype(np.int32),
            "more": np.log((count + 0.1) / 0.1).astype(np.float32), "base": np.log(0.1 / (size + 1))}


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """{"langs": names, "orders": the units of each order}; see :func:`order_of`."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text")) \
        .filter("doc_id is not null and lang is not null and text is not null").filter(fold(F.col("doc_id"), 4) != 2)
    spot = F.xxhash64("doc_id")
    marks = rows.select("doc_id", "lang", spot.alias("spot"))
    limits = marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not limits:
        return {"langs": [], "orders": []}
    # the sample's hash bound of each language: a first cut by share, then the exact first rows
    cut = spark.createDataFrame([(r["lang"], min(2**63 - 1, -2**63 + int(min(1.0, (2.0 * sample + 50) / r["n"]) * 2**64)))
                                 for r in limits], "lang string, cut long")
    near = marks.join(F.broadcast(cut), "lang").filter(F.col("spot") <= F.col("cut"))
    first = Window.partitionBy("lang").orderBy("spot", "doc_id")
    picked = near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample)
    picked = materialise(picked.select("doc_id").distinct(), "op5-picked")       # at most ``sample`` ids a language
    lang_no = spark.sparkContext.broadcast({r["lang"]: i for i, r in enumerate(limits)})
    if picked.count() <= 50_000:
        picked = F.broadcast(picked)
    chosen = materialise(rows.join(picked, "doc_id", "left_semi").select("lang", "text")
                         .repartition(24, F.xxhash64("text")), "op5-sample")
    counts = (chosen.mapInArrow(partial(_count, lang_no=lang_no), "n int, unit string, lang int, count long")
              .groupBy("n", "unit", "lang").agg(F.sum("count").alias("count")))
    counts = materialise(counts.mapInArrow(_hashed, "n int, unit long, lang int, count long"), "op5-counts")
    orders = []
    for n in range(TOP + 1):                                 # hashes of the whole sample's units
        got = counts.filter(F.col("n") == n).select("unit", "lang", F.col("count").alias("c")).toArrow()
        unit, lang, c = (got.column(k).to_numpy() for k in ("unit", "lang", "c"))
        orders.append(order_of(unit.view(np.uint64), lang, c, np.bincount(lang, c, len(limits))))
    return {"langs": [r["lang"] for r in limits], "orders": orders}


def word_scores(word: str, units: list[dict[str, int]], logs: list[np.ndarray], width: int) -> tuple[np.ndarray, int]:
    """(log frequency per language, letter runs) of one written word."""
    total, runs = np.zeros(width, np.float32), 0
    for w in _LETTERS.findall(word.lower()):
        runs += 1
        at = units[0].get(w)
        if at is not None:
            total += logs[0][at]
            continue
        for k in range(min(TOP, len(w) + 2), 0, -1):
            known = [units[k][g] for g in grams(w, k) if g in units[k]]
            if known:
                total += logs[k][known].mean(axis=0)
                break
    return total, runs


def _hash(names: list[str]) -> np.ndarray:
    raw = [x.encode() for x in names]
    ends = np.cumsum([len(x) for x in raw])
    return byte_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


def many_scores(runs: list[str], orders: list[dict], width: int) -> np.ndarray:
    """What :func:`word_scores` adds for each letter run, found by hash."""
    out, left = np.zeros((len(runs), width)), np.arange(len(runs))
    for k in (0, *range(TOP, 0, -1)):
        parts = [[runs[i]] if k == 0 else grams(runs[i], k) for i in left.tolist()]
        owner = np.repeat(np.arange(len(left)), [len(x) for x in parts])
        o = orders[k]
        if not len(owner) or not len(o["keys"]):
            continue
        h = _hash([g for x in parts for g in x])
        at = np.minimum(np.searchsorted(o["keys"], h), len(o["keys"]) - 1)
        hit = o["keys"][at] == h
        at, owner = at[hit], owner[hit]
        known = np.bincount(owner, minlength=len(left))
        size = o["ptr"][at + 1] - o["ptr"][at]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(o["ptr"][at], size)
        row = np.repeat(owner, size)
        np.add.at(out, (left[row], o["lang"][place]), o["more"][place] / known[row])
        out[left[known > 0]] += o["base"]
        left = left[known == 0]
    return out


def _lookup(model: dict) -> WordTable:
    """Remembers word scores under the model."""
    width = len(model["langs"])
    step = max(1, (1 << 22) // (width + 1))

    def score(new):
        out = np.zeros((len(new), width + 1), np.float32)
        if not width:
            return out
        found = [_LETTERS.findall(w.lower()) for w in new]
        out[:, width] = [len(x) for x in found]
        runs, owner = [r for x in found for r in x], np.repeat(np.arange(len(new)), [len(x) for x in found])
        for lo in range(0, len(runs), step):
            np.add.at(out[:, :width], owner[lo:lo + step], many_scores(runs[lo:lo + step], model["orders"], width))
        return out

    return WordTable(width + 1, score, max(8, min(20, ((1 << 23) // (width + 1)).bit_length() - 1)))


def _predict(batches, model):
    langs, width = model.value["langs"], len(model.value["langs"])
    table_ = resident(("op5", model.value["name"]), lambda: _lookup(model.value))
    for batch in batches:
        for words in slabs(batch.column("text"), size=max(1 << 14, min(SLAB_BYTES, (SLAB_BYTES << 4) // (width + 1)))):
            sums = np.zeros((words.rows, width + 1))
            full = np.flatnonzero(words.counts > 0)
            if len(full):
                sums[full] = np.add.reduceat(table_(words).astype(np.float64), words.first[:-1][full], axis=0)
            pred, share = ["und"] * words.rows, np.zeros(words.rows)
            ok = np.flatnonzero(sums[:, width] > 0) if width else []
            for r in ok:
                s = sums[r, :width]
                best = int(s.argmax())
                pred[r], share[r] = langs[best], 1 / np.exp(np.clip(s - s[best], -700, 0)).sum()
            cut = batch.slice(words.row, words.rows)
            yield pa.RecordBatch.from_arrays(
                [cut.column("doc_id"), cut.column("held_out"), pa.array(pred, pa.string()), pa.array(share)],
                names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model | {"name": uuid.uuid4().hex})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_predict, model=held),
                           "doc_id long, held_out boolean, lang_pred string, score double")


@query("op5_word_first_langid")
def op5_word_first_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
