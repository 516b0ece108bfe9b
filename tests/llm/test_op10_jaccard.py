import collections

import numpy as np
import pytest

from clinloom.llm import op10_jaccard_join as o
from tests.llm.helpers import ODD, SF, odd_docs, rows_of, words


def brute(rows, n=5, threshold=0.8):
    """(doc_id, class_id, n_copies, n_links, n_texts) by comparing every two rows that share a shingle."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n
                    else frozenset([tuple(w)] if w else []))
    holds = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, texts = collections.Counter(), collections.defaultdict(set)
    for i, s in enumerate(sets):
        for j, both in collections.Counter(j for x in s for j in holds[x]).items():
            if j != i and both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                root[find(i)] = find(j)
                if sets[j] != s:
                    texts[i].add(sets[j])
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    copies = collections.Counter(sets)
    return collections.Counter(
        (d, min((x for x in ids[find(i)] if x is not None), default=None), copies[sets[i]] if sets[i] else 1,
         links[i], len(texts[i])) for i, (d, _) in enumerate(rows))


def got(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "class_id", "n_copies", "n_links", "n_texts").collect())


def near_group(size):
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(size):
        w = list(base)
        w[k % 120] = f"x{k}"
        rows.append((k, " ".join(w)))
    return rows + [(10_000 + k, " ".join(f"q{k}_{i}" for i in range(30))) for k in range(50)]


def test_query_equals_brute_force(spark):
    assert got(o.op10_jaccard_join(spark, SF)) == brute(rows_of(spark))


@pytest.mark.parametrize("bounds", [{}, {"limit": 1, "bucket": 1, "block": 1}, {"limit": 1, "bucket": 3, "block": 2}])
def test_defined_cases(spark, bounds):
    for n in (5, 2):
        assert got(o.jaccard_classes(odd_docs(spark, ("size", "sid")), n, **bounds)) == brute(ODD, n)
    assert o.jaccard_classes(odd_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"limit": 8, "bucket": 32, "block": 16}])
def test_large_group_of_near_copies_loses_no_link(spark, bounds):
    rows = near_group(150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(o.jaccard_classes(df, **bounds)) == brute(rows)


def test_stage_keeps_one_of_each_class(spark):
    docs = odd_docs(spark, ("_k1", "class_row")).drop("_k1")
    out = o.stage(spark, docs, "")
    assert out.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in out.collect())
    assert ids == collections.Counter({1: 2, 2: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1, 8: 1, -20: 1})


def test_plan_reaches_the_recall_asked():
    for threshold in (0.5, 0.7, 0.8, 0.95, 1):
        last = 0
        for recall in (0.9, 0.99, 0.9999):
            need, runs, loss = o.plan(threshold, recall)
            assert 0 <= loss <= 1 - recall and runs >= last and need <= threshold * o.T
            last = runs
    for bad in ((0, 0.9), (1.1, 0.9), (0.8, 1), (0.01, 0.9999)):
        with pytest.raises(ValueError):
            o.plan(*bad)


def test_plan_matches_sampled_pairs():
    """The loss foretold against paths walked by sampled pairs of signatures, one run."""
    rng = np.random.default_rng(3)
    for threshold in (0.5, 0.8):
        share = rng.binomial(o.T, threshold, 200_000) / o.T
        met = rng.random(len(share)) < share
        for _ in range(o.DEPTH - 1):
            met &= (rng.random((len(share), o.BRANCH)) < share[:, None]).any(axis=1)
        apart = share * (1 - (1 - share) ** o.BRANCH) ** (o.DEPTH - 1)
        assert abs(met.mean() - apart.mean()) < 0.005
        need, runs, loss = o.plan(threshold, 0.99)
        kept = np.where(share * o.T >= need, 1 - (1 - apart) ** runs, 0)
        assert abs((1 - kept.mean()) - loss) < 0.002


@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_lower_thresholds_lose_no_link(spark, threshold):
    """Pairs just above the threshold, all levels of the paths in use."""
    rows = []
    for k in range(120):
        w = [f"p{k}_{i}" for i in range(104)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:round(104 * (threshold + 0.04))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(o.jaccard_classes(df, threshold=threshold, limit=1)) == brute(rows, 5, threshold)
