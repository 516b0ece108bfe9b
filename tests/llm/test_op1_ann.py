import numpy as np
import pytest

from clinloom.llm import op1_pruned_graph_ann as o
from tests.llm.helpers import SF


def brute(rows, queries, k=20):
    """(query_id, rank, vec_id, score) over distinct (id, vector) rows."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = []
    for q in [j for j, i in enumerate(ids) if queries(i)]:
        score = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), score[j]) for r, j in enumerate(order)]
    return out


def test_query_recall_and_scores(spark):
    for sf, least in ((SF, 0.99), ("/root/testdata/sf0.1", 0.95)):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        want = brute(rows, lambda i: i % 20 == 0)
        got = [tuple(r) for r in o.op1_pruned_graph_ann(spark, sf).collect()]
        assert sorted(g[:2] for g in got) == sorted(w[:2] for w in want)
        both = {(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}
        assert len(both) >= least * len(want)
        vec = {i: np.asarray(v, np.float32).astype(float) for i, v in rows}
        assert all(abs(g[3] - (vec[g[0]] * vec[g[2]]).sum()) < 1e-12 for g in got)
        by = {}
        for q, r, v, s in sorted(got):
            assert (q, r) == (q, 1) or (-by[q][0], by[q][1]) < (-s, v)
            by[q] = (s, v)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1., 0.]), (20, [1., 0.]), (1, [1., 0.]), (2, [0., 2.]), (3, None), (4, [0., 0.]), (5, [nan, 1.]),
            (6, [1., None]), (7, [1., 2., 3.]), (40, [2., 2.]), (None, [1., 1.]), (20, [0., 2.]), (8, [inf, 1.]), (9, [])]
    rows += [(100 + i, [1., 0.]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS score", "3 AS rank")
    good = [(i, v) for i, v in rows if i is not None and i not in (3, 4, 5, 6, 7, 8, 9)]
    for shard in (4096, 2):
        got = sorted(tuple(r) for r in o.nearest(df, shard=shard).collect())
        assert got == sorted(brute(good, lambda i: i % 20 == 0))
    assert o.nearest(df.limit(0)).count() == 0
    assert [tuple(r) for r in o.nearest(df.where("vec_id IN (20, 1)"), k=5).collect()]


@pytest.mark.parametrize("norms", [False, True])
def test_graph_finds_neighbours_of_unequal_lengths(norms):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    x *= rng.uniform(0.5, 2, (1500, 1)) if norms else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    g = o.Graph.build(x)
    assert g.graph.shape == (1500, o.DEGREE) and (g.graph < 1500).all()
    q = np.concatenate([x[:100], np.zeros((100, 1))], axis=1).astype(np.float32)
    found, _ = g.search(q, 64)
    best = np.argsort(-(x[:100] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(f) & set(b)) / 10 for f, b in zip(found.tolist(), best.tolist(), strict=True)]) > 0.9
