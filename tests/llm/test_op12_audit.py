import collections
import itertools
import re

import pytest

from clinloom.llm import op12_filter_audit as o
from tests.llm.helpers import LONG, words


def fails(rows):
    low = {}
    for d, t, *_ in rows:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    out = []
    for d, text, *_ in rows:
        t = text or ""
        w = words(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > low[t]}
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = collections.defaultdict(list)
    for (d, _, part), bad in zip(rows, fails(rows), strict=True):
        parts[part or ""].append((d, bad))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        mine = {}
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for step, x in enumerate(order, 1):
                gone = [y for y in left if x in y[1]]
                left = [y for y in left if x not in y[1]]
                shapley[x] += len(gone)
                mine["".join(order), step] = [
                    len(left), len(gone), sum(x in b for _, b in docs) - len(gone), sum(b == {x} for _, b in docs),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (order, step), row in mine.items():
            out[part, order, step] = (*row, shapley[order[step - 1]])
    return out


ROWS = [(1, "plain " * 300, "a"), (2, "plain " * 300, "a"), (2, "plain " * 300, None), (3, None, "a"), (4, "", ""), (4, "", "b"),
        (None, "", "b"), (None, None, None), (5, "CAPS AND MORE", "b"), (6, "cash $ 5", "b"), (7, LONG, "a"),
        (-1, LONG, "long"), (8, " ".join(f"w{i}" for i in range(250)), "ok"), (8, " ".join(f"w{i}" for i in range(250)), "ok"),
        (9, "é " * 199 + "\x0bÉ A", "ok"), (10, "x\ty\rz # \x1c", "ok")]
LABELS = [(1, 1, 0), (2, None, 1), (3, 1, 1), (3, 0, 0), (None, 1, 1), (7, 1, None), (99, 1, 1)]


@pytest.mark.parametrize("parts", (1, 7))
def test_equals_brute_force(spark, parts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(parts)
    docs = docs.selectExpr("*", "7 AS mask", "8 AS n", "9 AS good", "'x' AS part", "'y' AS key", "1 AS id")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = o.filter_audit(docs, labels)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    assert out.count() == len(got) and got == brute(ROWS, LABELS)
    assert len(got) == 600 * 5


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert o.filter_audit(docs.limit(0), labels).count() == 0
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in o.filter_audit(docs, labels.limit(0)).collect()}
    assert got == brute(ROWS, [])


def test_masks_leave_texts_behind(spark):
    """No shuffle carries a text: the scan's output is masks and hashes."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    plan = o.mask_cells(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan
