"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences (ended by ``.``, ``!``, ``?`` or a line break).  A sentence
scores p = sigmoid(bias + sum of its features' weights); the document scores the noisy-or
of its sentences, 1 - prod(1 - p), and only documents have labels.  Features are a
sentence's words (lower case) and their character 3- to 5-grams with word ends.

Training uses labelled rows with crc32(doc_id) mod 4 != 2, each different text once:
at most ``SAMPLE`` texts of each class, the first by their hash and so the same in every
run, weighted to the full class counts.  Features enter by the log-likelihood ratio of their
document counts (at least ``EVIDENCE``, at most ``FEATURES`` of them); weights come from
full-batch gradient steps, each a Spark job over the sample that returns one vector of the
features' size.  Scoring is one pass over whole texts; because the model is linear in a
sentence, a word's weight is computed once and remembered.

Result: ``doc_id``, ``held_out`` (remainder 2), ``score`` (0 to 1), ``predicted`` (score >= 0.3) and
the offending sentence: ``sentence`` (number of the highest, from 0; -1 without words),
``sentence_score``, ``word_from`` and ``word_to`` (its words).

Defined cases: null, empty and blank texts score 0; a null ``doc_id`` is never learned from
and not held out; a text with conflicting labels counts as their mean, rounded half up;
without texts of both classes every score is the share of class 1 (0 without any); rows
that repeat are each scored; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import fold, materialise, small_batches
from clinloom.llm.words import Words, WordTable, hash_ints, release, resident, slabs, spans, windows

SAMPLE, FEATURES, EVIDENCE, CUT = 6000, 4096, 24.0, 0.3
ORDERS, STEPS, RATE, RIDGE, TALLY = (3, 4, 5), 40, 0.4, 1e-5, 1 << 20
_CORE = re.compile(r"\w+")
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def features(word: str) -> list[str]:
    """The word and its character n-grams; ``<`` and ``>`` mark its ends."""
    out = []
    for core in _CORE.findall(word.lower()):
        marked = f"<{core}>"
        out.append(marked)
        out += [marked[i:i + k] for k in ORDERS for i in range(len(marked) - k + 1) if k < len(marked)]
    return out


def sentences(words: Words) -> np.ndarray:
    """First word of each sentence of a slab (rows always start one)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    breaks = np.flatnonzero(words.data == 10)
    lines = np.searchsorted(breaks, words.starts)
    start = np.ones(n, bool)
    start[1:] = _STOP[words.data[words.ends[:-1] - 1]] | (lines[1:] != lines[:-1])
    start[words.first[:-1][words.counts > 0]] = True
    return np.flatnonzero(start)


def feature_hashes(text: str) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
    """(hashes, marked text, starts, ends): every occurrence of a feature among the text's different words."""
    s = _CORE.sub(r"<\g<0>>", " ".join(set(text.split())).lower().translate({60: 32, 62: 32}))
    cp = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    opened, closed = np.flatnonzero(cp == 60), np.flatnonzero(cp == 62) + 1
    h = hash_ints(cp, 6)
    word = np.zeros(len(cp), np.int64)                       # number of the word at each place, 0 between words
    word[opened] = np.arange(1, len(opened) + 1)
    word = np.maximum.accumulate(word)
    if len(opened):
        word[(word > 0) & (np.arange(len(cp)) >= closed[word - 1])] = 0
    out, starts, ends = [spans(h, opened, closed)], [opened], [closed]
    for k in ORDERS:
        if len(cp) >= k:
            at = np.flatnonzero((word[:len(cp) - k + 1] > 0) & (word[:len(cp) - k + 1] == word[k - 1:]))
            out.append(windows(h, k)[at])
            starts.append(at)
            ends.append(at + k)
    return np.concatenate(out), s, np.concatenate(starts), np.concatenate(ends)


def _count(batches):
    """Documents of each class that hold a feature; partial counts, handed on before they grow large."""
    release()
    held: tuple[list, list] = ([], [])
    size = 0

    def batch_of():
        both = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                for x in held]
        names = np.union1d(both[0][0], both[1][0])
        n = np.zeros((2, len(names)), np.int64)
        for y in (0, 1):
            n[y, np.searchsorted(names, both[y][0])] = both[y][1]
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n[0]), pa.array(n[1])],
                                          names=["feature", "n0", "n1"])

    for batch in batches:
        y, text = batch.column("y").to_numpy(), batch.column("text")
        for i in range(batch.num_rows):
            own = np.unique(feature_hashes(text[i].as_py())[0])
            held[y[i]].append(own)
            size += len(own)
            if size > TALLY:
                yield batch_of()
                held, size = ([], []), 0
    if size:
        yield batch_of()


def _names(batches, wanted):
    """(feature, name) of the wanted feature hashes, once per task."""
    release()
    left = wanted.value
    for batch in batches:
        out: dict[int, str] = {}
        for text in batch.column("text"):
            h, s, a, b = feature_hashes(text.as_py())
            for i in np.flatnonzero(np.isin(h, left)).tolist():
                out.setdefault(int(h[i]), s[a[i]:b[i]])
        left = left[~np.isin(left, np.array(list(out), np.uint64))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(out), np.uint64).view(np.int64)),
                                              pa.array(list(out.values()))], names=["feature", "name"])


def _automaton(values: dict):
    import ahocorasick
    find = ahocorasick.Automaton()
    for f, v in values.items():
        find.add_word(f, v)
    if values:
        find.make_automaton()
    return find


def _found(find, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, value) of every feature found in the words, one pass over all of them: each on
    a line, its letter runs marked like :func:`features` marks them."""
    lines = _CORE.sub(r"<\g<0>>", "\n".join(words).lower())
    hits = list(find.iter(lines)) if len(find) else []
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0)
    at, value = zip(*hits, strict=True)
    ends = np.cumsum([len(x) + 1 for x in lines.split("\n")])
    return np.searchsorted(ends, at, side="right"), np.asarray(value)


def _bags(batches, known):
    """Per text: its sentences as counted feature numbers."""
    release()
    find = _automaton(known.value)
    for batch in batches:
        y = batch.column("y").to_numpy()
        for words in slabs(batch.column("text"), lower=True):
            first, raw = sentences(words), words.data.tobytes()
            row = np.searchsorted(words.first, first, side="right") - 1
            _, one, back = np.unique(words.hashes, return_index=True, return_inverse=True)
            own, value = _found(find, [raw[words.starts[i]:words.ends[i]].decode() for i in one.tolist()])
            order = np.argsort(own, kind="stable")
            value = value[order].astype(np.int64)
            cut = np.searchsorted(own[order], np.arange(len(one) + 1))
            feats: list[list[list[int]]] = [[] for _ in range(words.rows)]
            plain = np.bincount(row, minlength=words.rows).astype(np.int64)
            some = np.flatnonzero(cut[back + 1] > cut[back]) if len(back) else []
            at = np.searchsorted(first, some, side="right") - 1
            last = -1
            for i, s in zip(some, at, strict=True):
                r, got = row[s], value[cut[back[i]]:cut[back[i] + 1]].tolist()
                if s != last:
                    feats[r].append(got)
                    plain[r] -= 1
                    last = s
                else:
                    feats[r][-1] += got
            yield pa.RecordBatch.from_arrays(
                [pa.array(y[words.row:words.row + words.rows], pa.int32()), pa.array(plain),
                 pa.array(feats, pa.list_(pa.list_(pa.int32())))], names=["y", "plain", "bag"])


def noisy_or(z: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sentence probabilities, sum of log(1 - p) per row)."""
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return p, -np.bincount(owner, np.logaddexp(0, np.clip(z, -60, 60)), rows)


def _gradient(batches, model, weight):
    w, bias = model.value
    grad, loss = np.zeros(len(w) + 1), 0.0
    for batch in batches:
        y, plain = batch.column("y").to_numpy(), batch.column("plain").to_numpy().astype(float)
        bag = batch.column("bag")
        per_row = pa.compute.list_value_length(bag).to_numpy()
        sent = bag.flatten()
        size = pa.compute.list_value_length(sent).to_numpy()
        feat = np.asarray(sent.flatten())
        rows = len(y)
        owner = np.repeat(np.arange(rows), per_row)
        holder = np.repeat(np.arange(len(owner)), size)
        z = bias + np.bincount(holder, w[feat], len(owner)) if len(owner) else np.zeros(0)
        p, rest = noisy_or(z, owner, rows)
        p0 = 1 / (1 + np.exp(-bias))
        rest = rest + plain * np.log1p(-p0)
        total = np.clip(-np.expm1(rest), 1e-12, 1)
        cost = np.where(y == 1, weight[1], weight[0])
        slope = np.where(y == 1, -(1 - total) / total, 1.0) * cost     # d loss / d z = slope * p
        loss += float((cost * np.where(y == 1, -np.log(total), -rest)).sum())
        g = slope[owner] * p
        if len(feat):
            grad[:-1] += np.bincount(feat, g[holder], len(w))
        grad[-1] += g.sum() + (slope * plain * p0).sum()
    yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tolist()])], names=["loss", "grad"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_features: int = FEATURES,
          steps: int = STEPS) -> dict:
    """{"words": feature -> weight, "bias": ..} or {"rate": share of class 1}."""
    spark = docs.sparkSession
    small_batches(spark)
    given = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
             .filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id"), 4) != 2)
             .groupBy("doc_id").agg(F.avg("toxic").alias("toxic")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .filter("text is not null and doc_id is not null")
    # one row per different text, with its mean label
    marks = (rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
             .join(given, "doc_id").groupBy("h1", "h2")
             .agg((F.avg("toxic") >= 0.5).cast("int").alias("y"), F.min("doc_id").alias("doc_id")))
    marks = materialise(marks, "op6-marks")
    totals = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(totals) < 2:
        return {"rate": float(totals.get(1, 0) > 0)}
    picked = marks.filter("y = 1").orderBy("h1", "h2").limit(sample).unionByName(
        marks.filter("y = 0").orderBy("h1", "h2").limit(2 * sample))
    picked = materialise(picked, "op6-picked")               # at most 3 * sample narrow rows: broadcast below
    chosen = rows.join(F.broadcast(picked.select("doc_id", "h1", "y")),
                       "doc_id").filter(F.xxhash64("text") == F.col("h1")).dropDuplicates(["doc_id"])
    chosen = materialise(chosen.select("y", "text").repartition(12, F.xxhash64("text")), "op6-sample")
    size = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return {"rate": float(n1 > 0)}
    counts = (chosen.mapInArrow(_count, "feature long, n0 long, n1 long").groupBy("feature")
              .agg(F.sum("n0").cast("double").alias("a"), F.sum("n1").cast("double").alias("b")))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b, n = F.col("a"), F.col("b"), float(n0 + n1)
    hold = a + b
    ratio = 2 * (part(a, hold * n0 / n) + part(b, hold * n1 / n)
                 + part(n0 - a, (n - hold) * n0 / n) + part(n1 - b, (n - hold) * n1 / n))
    best = (counts.filter(b / n1 > a / n0).select("feature", ratio.alias("g")).filter(F.col("g") >= EVIDENCE)
            .orderBy(F.desc("g"), "feature").limit(max_features).collect())
    wanted = spark.sparkContext.broadcast(np.array([r["feature"] for r in best], np.int64).view(np.uint64))
    named = (chosen.mapInArrow(partial(_names, wanted=wanted), "feature long, name string")
             .groupBy("feature").agg(F.min("name").alias("name")).collect())
    name = {r["feature"]: r["name"] for r in named}
    index = {name[r["feature"]]: i for i, r in enumerate(best)}
    known = spark.sparkContext.broadcast(index)
    bags = materialise(chosen.mapInArrow(partial(_bags, known=known),
                                         "y int, plain long, bag array<array<int>>"), "op6-bags")
    weight = (totals[0] / n0 / sum(totals.values()), totals[1] / n1 / sum(totals.values()))
    w, bias = np.zeros(len(index)), -5.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for step in range(1, steps + 1):                          # Adam on the whole sample
        model = spark.sparkContext.broadcast((w, bias))
        parts = bags.mapInArrow(partial(_gradient, model=model, weight=weight),
                                "loss double, grad array<double>").collect()
        g = np.sum([np.asarray(p["grad"]) for p in parts], axis=0)
        g[:-1] += RIDGE * w
        model.unpersist()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], float(bias - move[-1])
    return {"words": {f: float(w[i]) for f, i in index.items()}, "bias": bias}


def word_weights(weights: dict[str, float]):
    """A function from words to the sums of their features' weights (an array of one column)."""
    find = _automaton(weights)

    def score(words: list[str]) -> np.ndarray:
        own, value = _found(find, words)
        return np.bincount(own, value, len(words)).astype(float)[:, None]

    return score


def _score(batches, model):
    value = model.value
    bias = value.get("bias", 0.0)
    table_ = resident(("op6", value["name"]), lambda: WordTable(1, word_weights(value.get("words", {})), 21))
    for batch in batches:
        for words in slabs(batch.column("text"), lower=True):
            rows = words.rows
            score, best, top = np.zeros(rows), np.full(rows, -1, np.int32), np.zeros(rows)
            lo, hi = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            if "rate" in value:
                score[:] = value["rate"]
            elif len(words):
                first = sentences(words)
                end = np.append(first[1:], len(words))
                owner = np.searchsorted(words.first, first, side="right") - 1
                z = bias + np.add.reduceat(table_(words)[:, 0].astype(np.float64), first)
                p, rest = noisy_or(z, owner, rows)
                score = -np.expm1(rest)
                order = np.lexsort((-np.arange(len(z)), z, owner))     # last of a row: highest, earliest
                last = order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)]
                r = owner[last]
                begin = np.searchsorted(owner, np.arange(rows))
                best[r], top[r] = last - begin[r], p[last]
                lo[r], hi[r] = first[last] - words.first[r], end[last] - words.first[r]
            cut = batch.slice(words.row, rows)
            yield pa.RecordBatch.from_arrays(
                [*(cut.column(c) for c in cut.schema.names if c != "text"), pa.array(score),
                 pa.array((score >= CUT).astype(np.int32)), pa.array(best), pa.array(top), pa.array(lo), pa.array(hi)],
                names=[c for c in cut.schema.names if c != "text"]
                + ["score", "predicted", "sentence", "sentence_score", "word_from", "word_to"])


_OUT = "score double, predicted int, sentence int, sentence_score double, word_from long, word_to long"


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model | {"name": uuid.uuid4().hex})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, model=held), f"doc_id long, held_out boolean, {_OUT}")


@query("op6_toxicity_mil")
def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; learned from ``labels.toxic``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; all columns of the others stay as they are."""
    model = train(docs, table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model | {"name": uuid.uuid4().hex})

    def keep(batches):
        for batch in batches:
            flags = [b.column("predicted") for b in _score([batch.select(["text"])], held)]
            if flags:
                good = pa.compute.equal(pa.chunked_array(flags), 0).combine_chunks()
                yield batch.filter(good)

    return docs.mapInArrow(keep, docs.schema)
