import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from clinloom.llm import op9_brown_lm as o
from tests.llm.helpers import ODD, SF, odd_docs, rows_of, words


def tokens(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + ["\x00end"]


def base(rows):
    count = collections.Counter()
    for d, t in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    return [(d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)),
             n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for d, t in rows]


def got(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in df.collect()]


def test_query_base_and_gain(spark):
    out = o.op9_brown_lm(spark, "/root/testdata/sf0.01")
    assert sorted(got(out)) == sorted(base(rows_of(spark, "/root/testdata/sf0.01")))
    held = [r for r in out.collect() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) <= 1e-9 * r.perplexity for r in held)


def test_gain_grows_with_the_text(spark):
    held = o.op9_brown_lm(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_score_equals_counts(spark, monkeypatch):
    """The score recomputed from the texts, given nothing but the words' classes."""
    from clinloom.llm.words import slabs
    made, write = {}, o.materialise
    monkeypatch.setattr(o, "materialise", lambda df, name, *more: made.setdefault(name, write(df, name, *more)))
    rows = rows_of(spark) + [(None, "no id"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got_ = collections.Counter((r.doc_id, round(r.score, 6)) for r in o.lm_scores(df).collect())
    cls_of = {r.word: r.cls for r in made["op9-classes"].collect()}

    def hashes(t):
        return [int(x) for w in slabs(pa.array([t or ""]), lower=True) for x in w.hashes.view(np.int64)]
    learned = [d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    texts_ = [hashes(t) for _, t in rows]
    count = collections.Counter(h for t, k in zip(texts_, learned, strict=True) if k for h in t)
    assert {h for h, n in count.items() if n > 1} == {h for h, c in cls_of.items() if c != o.RARE}
    seqs = [[o.END, o.END] + [cls_of.get(h, o.RARE) for h in t] + [o.END] for t in texts_]
    three, two, one = collections.Counter(), collections.Counter(), collections.Counter()
    for c, k in zip(seqs, learned, strict=True):
        if k:
            for i in range(2, len(c)):
                three[tuple(c[i - 2:i + 1])] += 1
                two[tuple(c[i - 1:i + 1])] += 1
                one[c[i]] += 1
    after3, after2 = collections.Counter(k[:2] for k in three), collections.Counter(k[0] for k in two)
    n3, n2 = collections.Counter(), collections.Counter()
    for k, n in three.items():
        n3[k[:2]] += n
    for k, n in two.items():
        n2[k[0]] += n
    size = sum(one.values())

    def p(a, b, c):
        low = (one[c] + 0.5) / (size + 0.5 * o.ALL)
        kinds = max(after2[b], 1)
        mid = (two[b, c] + kinds * low) / (n2[b] + kinds)
        kinds = max(after3[a, b], 1)
        return (three[a, b, c] + kinds * mid) / (n3[a, b] + kinds)
    mass = collections.Counter()
    for h, n in count.items():
        mass[cls_of[h]] += n
    n1, n2_ = (sum(n == k for n in count.values()) for k in (1, 2))
    unseen, types = n1 / (n1 + 2 * n2_), n1 * n1 / (2 * n2_)

    def emission(h):
        n = count[h]
        return unseen / types if not n else n / mass[cls_of[h]] * (1 - unseen if n == 1 else 1)
    want = collections.Counter(
        (d, round(sum(math.log10(p(*c[i - 2:i + 1])) for i in range(2, len(c))) + sum(math.log10(emission(h)) for h in t), 6))
        for (d, _), c, t in zip(rows, seqs, texts_, strict=True))
    assert got_ == want


def test_every_word_above_once_chooses_its_class(spark, monkeypatch):
    """Beyond the head, words of two languages that alternate go to their neighbours' classes."""
    made, write = {}, o.materialise
    monkeypatch.setattr(o, "materialise", lambda df, name, *more: made.setdefault(name, write(df, name, *more)))
    rows = [(i, " ".join(f"{'xy'[i % 2]}{j % 3} {'xy'[i % 2]}rare{i // 6}" for j in range(9))) for i in range(600)]
    o.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), head=6).count()
    assert made["op9-classes"].filter(f"total > 1 AND (cls IS NULL OR cls = {o.RARE})").count() == 0
    left = np.zeros((2, o.ALL))
    left[0, 3], left[1, 5] = 4, 4
    grid = np.zeros((o.ALL, o.ALL))
    grid[3, 10], grid[10, 3], grid[5, 11], grid[11, 5] = 50, 50, 50, 50
    assert o.best_classes(left, left, grid).tolist() == [10, 11]


def test_repeated_rows_spread_over_chunks(spark, monkeypatch):
    made, write = {}, o.materialise
    monkeypatch.setattr(o, "materialise", lambda df, name, *more: made.setdefault(name, write(df, name, *more)))
    df = spark.createDataFrame([(None, "same text")] * 500, "doc_id long, text string").repartition(4)
    assert o.lm_scores(df, chunk_bytes=500).count() == 500
    held = collections.Counter()
    for t in made["op9-rows"].toArrow().to_batches():
        for i, chunk in enumerate(t.column("chunk").to_pylist()):
            held[chunk] += sum(b.num_rows for b in o._rows([t.slice(i, 1)]))
    assert sum(held.values()) == 500 and max(held.values()) < 150


def test_unseen_words_share_their_mass(spark):
    rows = [(d, t) for d, t in rows_of(spark, "/root/testdata/sf0.01") if d is not None]
    held = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 == 2][:50]
    strange = [(d, " ".join(f"qzx{d}v{i}" for i in range(len(words(t))))) for d, t in held]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string")
    out = collections.defaultdict(list)
    for r in o.lm_scores(docs).filter("held_out").collect():
        out[r.doc_id].append((r.n_known, r.perplexity))
    pairs = [sorted(out[d]) for d, t in held if len(words(t)) >= 20]
    assert pairs and all(len(p) == 2 and p[0][0] == 1 and p[0][1] > p[1][1] for p in pairs)
    assert o.unseen_types(100, 25) == 200 and o.unseen_types(5, 0) == 10 and o.unseen_types(0, 0) == 1


def test_defined_cases(spark):
    docs = odd_docs(spark, ("n", "chunk", "word", "train"))
    for chunk in (1 << 20, 200):
        assert sorted(got(o.lm_scores(docs, chunk_bytes=chunk)), key=str) == sorted(base(ODD), key=str)
    assert o.lm_scores(docs.limit(0)).count() == 0
    none = [(d, t) for d, t in ODD if d is None or zlib.crc32(str(d).encode()) % 7 == 2] or [(None, "a b")]
    df = spark.createDataFrame(none, "doc_id long, text string")
    assert sorted(got(o.lm_scores(df)), key=str) == sorted(base(none), key=str)


def test_scores_do_not_depend_on_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r.score for r in o.lm_scores(docs).collect()}
    b = {r.doc_id: r.score for r in o.lm_scores(docs.repartition(7), chunk_bytes=1 << 16).collect()}
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-6 * abs(a[d]) for d in a)


def test_exchange_raises_the_likelihood_and_separates_alternating_words():
    rng = np.random.default_rng(0)
    text = [(i % 2) * 4 + int(rng.integers(4)) for i in range(4000)]       # words 0-3 and 4-7 take turns
    grid = np.zeros((10, 10))
    np.add.at(grid, (text[:-1], text[1:]), 1)

    def likelihood(c):
        g = np.zeros((4, 4))
        np.add.at(g, (c[:, None], c[None, :]), grid)
        return o._xlogx(g).sum() - o._xlogx(g.sum(0)).sum() - o._xlogx(g.sum(1)).sum()

    def sums(full):
        onto = np.eye(4)[full]
        return grid.T @ onto, grid @ onto

    start = np.array([0, 0, 1, 0, 1, 0, 1, 1, 2, 3])
    cls, (left, right) = start.copy(), sums(start)
    for w in range(8):                                                       # one word at a time never loses
        before = likelihood(cls)
        o.exchange(cls, *sums(cls), np.diag(grid), np.array([w]), 2)
        assert likelihood(cls) >= before - 1e-6
    assert len(set(cls[:4])) == 1 and len(set(cls[4:8])) == 1 and cls[0] != cls[4]
    begin = likelihood(np.concatenate([np.arange(8) % 2, [2, 3]]))
    for rounds in (1, 5, 20):
        end = likelihood(np.concatenate([o.exchange_rounds(sums, np.diag(grid)[:8], 8, 2, rounds), [2, 3]]))
        assert end >= begin - 1e-6


def test_transitions_are_probabilities():
    grid = np.zeros((o.ALL, o.ALL, o.ALL))
    grid[7, 3, 4], grid[7, 3, 5], grid[8, 3, 6] = 10, 1, 2
    p = 10 ** o.transition_matrix(grid)
    assert np.allclose(p.sum(axis=-1), 1) and p[7, 3, 4] > p[7, 3, 5] > p[7, 3, 6] > p[7, 3, 9] > 0
    assert p[9, 3, 4] > p[9, 3, 6] > p[9, 3, 9]                 # an unknown history falls back to one class


def test_broadcast_and_joined_words_score_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    runs = [{r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in o.lm_scores(docs, common=n).collect()}
            for n in (0, 50, o.COMMON)]
    assert runs[0] == runs[1] == runs[2]
