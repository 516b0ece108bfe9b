import collections
import hashlib
import random

import numpy as np
import pytest

from clinloom.llm import op13_suffix_dedup as o
from tests.llm.helpers import ODD, odd_docs


def brute(rows, window):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    out = collections.Counter()
    for (d, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i + 1:i + 1 + window] = True
        left = bytes(x for x, g in zip(b, gone[1:], strict=True) if not g)
        out[d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()] += 1
    return out


def got(df):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def mixed(seed, letters="ab", n=60):
    """Rows pieced together from shared parts, so that repeats branch to both sides."""
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))) for i in range(n)]
    return rows + [(None, rows[3][1]), (3, rows[3][1]), (98, None), (99, "z" * 300), (99, "yz" * 80), (100, "\x00" * 90 + "a\x00")]


@pytest.mark.parametrize(("window", "seed", "heavy"), [(20, 6, 1000), (24, 24, 1000), (9, 2, 1000), (1, 1, 1000), (20, 6, 0), (16, 5, 8)])
def test_equals_brute_force(spark, window, seed, heavy):
    rows = mixed(window) + mixed(window + 1, "abcdeé日")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(o.suffix_dedup(df, window, seed, heavy)) == brute(rows, window)


def test_production_window(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (30, 35, 60, 300)]
    rows = []
    for i in range(120):
        body = [" ".join(word() for _ in range(rnd.randint(0, 80)))]
        for _ in range(rnd.randint(0, 2)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 20)
            body += [s[a:len(s) - rnd.randint(0, 20)], " ".join(word() for _ in range(rnd.randint(0, 40)))]
        rows.append((i, " ".join(body)))
    rows += [(200, rows[0][1] + "!"), (201, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, 200)
    assert sum(k[2] > 0 for k in want) > 20
    assert got(o.suffix_dedup(df)) == want
    assert got(o.suffix_dedup(df, heavy=3)) == want


def test_defined_cases(spark):
    small = [(d, t if len(t or "") < 1000 else t[:3000]) for d, t in ODD]
    docs = odd_docs(spark, ("node", "c", "l", "gone")).withColumn("text", o.F.substring("text", 1, 3000))
    for window, seed in ((200, 48), (3, 2), (5, 5)):
        assert got(o.suffix_dedup(docs, window, seed)) == brute(small, window)
    assert o.suffix_dedup(docs.limit(0)).count() == 0


def test_interval_tree():
    assert list(o.intervals([-1, 3, 5, 5, 2, -1, 4])) == [(5, 1, 3), (3, 0, 3), (2, 0, 4), (4, 5, 6)]
    assert list(o.intervals([])) == [] and list(o.intervals([-1])) == []
    rnd = random.Random(1)
    for _ in range(50):
        lcp = [-1] + [rnd.randint(-1, 4) for _ in range(rnd.randint(0, 25))]
        want = set()
        for i in range(len(lcp)):
            for j in range(i + 1, len(lcp)):
                d = min(lcp[i + 1:j + 1])
                if d >= 0 and lcp[i] < d and (j + 1 == len(lcp) or lcp[j + 1] < d):
                    want.add((d, i, j))
        seen = list(o.intervals(lcp))
        assert set(seen) == want and len(seen) == len(want)


def test_groups_hold_all_occurrences(spark):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage, pair = noise(400), noise(300)
    rows = [(i, noise(250 + i) + passage + noise(250)) for i in range(7)] + [(i, noise(10 + i) + pair + noise(40)) for i in (7, 8)]
    found = o.Repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    places = collections.defaultdict(dict)
    for r in found.occurrences().collect():
        places[r.repeat][r.k1] = r.start
    assert {frozenset(p) for p in places.values()} == {frozenset(range(7)), frozenset((7, 8))}
    for p in places.values():                            # a group is one string: it starts at one place of the passage
        assert len({start - (250 + d if d < 7 else 3 + d) for d, start in p.items()}) == 1


def test_kept_bytes(spark):
    rows = [(1, "x" * 250 + "é"), (2, "y" + "x" * 250), (3, "unique")]
    out = {r.doc_id: r for r in o.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()}
    assert bytes(out[1].kept) == "é".encode() and bytes(out[2].kept) == b"y" and out[3].kept is None
