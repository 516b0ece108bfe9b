import collections
import random
import re

import numpy as np
import pytest

from clinloom.llm import op11_collocations as o
from clinloom.llm.bits import bit_set, held
from tests.llm.helpers import LONG, odd_docs

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    dropped = {(k[0], *k[i:i + m]) for k, a in cand.items() for m in range(2, len(k) - 1) for i in range(1, len(k) - m + 1)
               if 100 * a >= 80 * f[(k[0], *k[i:i + m])]}
    out = []
    for k, a in cand.items():
        if k in dropped:
            continue
        cuts = [(f[k[:1 + i]], f[(k[0], *k[1 + i:])]) for i in range(1, len(k) - 1)]
        score, i = min((2_000_000 * a // (x + y), i) for i, (x, y) in enumerate(cuts))
        out.append((k[0], " ".join(k[1:]), a, *cuts[i], n[k[0]], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def corpus(seed):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a\x0bb", "é", "日本", "x-y", "42", "\x1cz", "new", "york", "city", "hall"]
    rows = []
    for _ in range(400):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", ""]) for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.choice(["en", "fr", None, "und", ""]), text + rnd.choice([" New York City Hall", ""])))
    return rows + [("en", None), (None, None), ("fr", "")] + [("en", "copy of copies " * 30)] * 40


@pytest.mark.parametrize(("least", "top", "budget"), [(30, 2000, 1 << 20), (5, 7, 64), (2, 50, 3)])
def test_equals_brute_force(spark, least, top, budget):
    rows = corpus(least)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    df = df.selectExpr("*", "1 AS a", "2 AS n", "3 AS score", "'x' AS word", "4 AS id")
    assert got(o.collocations(df, least, top, budget)) == brute(rows, least, top)


def test_tasks_hand_on_in_parts(spark, monkeypatch):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(o, "HELD", 64)
    parts = list(o.combine(({"key": np.arange(50) + i, "n": np.ones(50, np.int64)} for i in range(9)), ["key", "n"]))
    total = collections.Counter()
    for b in parts:
        total.update(dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert sum(total.values()) == 450 and len(parts) > 1
    assert got(o.collocations(df, 3, 100, 8)) == brute(rows, 3, 100)


def test_groups_keep_the_budget(spark):
    pairs = [(i * (1 << 50) - (1 << 62), 1 + i % 9) for i in range(5000)] + [(7, 1000), (-9, 101)]
    starts, heavy, parts = o.prefix_groups(spark.createDataFrame(pairs, "pair long, n long"), 100)
    assert heavy.tolist() == [-9, 7] and parts.tolist() == [2, 10]
    size = collections.Counter()
    for p, n in pairs:
        if n <= 100:
            size[int(np.searchsorted(starts, p, side="right"))] += n
    assert max(size.values()) < 100 + 9 and len(size) <= sum(size.values()) // 100 + 1


def test_bitmaps_lose_nothing(spark):
    rnd = np.random.default_rng(0)
    h = rnd.integers(-2**63, 2**63, 3000, dtype=np.int64)
    table = bit_set(spark.createDataFrame([(int(x),) for x in h], "h long"), "h", 20)
    assert held(table, h.view(np.uint64)).all()
    assert held(table, rnd.integers(0, 2**63, 10_000, dtype=np.uint64)).mean() < 0.01


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark, ("lang", "id", "word"))
    rows = [("7", r.text) for r in docs.collect()]
    assert got(o.collocations(docs, 2, 30)) == brute(rows, 2, 30)
    assert o.collocations(docs.limit(0)).count() == 0
    assert LONG in {r[1] for r in rows}
