import collections
import itertools
import random
import re

import pytest

from clinloom.llm import op8_spaced_seeds as o
from tests.llm.helpers import SF, odd_docs, rows_of, words


def low(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]


def brute(rows, items, least=13, share=0.8):
    out = set()
    for d, t in rows:
        w = low(t)
        place = collections.defaultdict(list)
        for p, x in enumerate(w):
            place[x].append(p)
        for i, text in items:
            x = low(text)
            if len(x) < 8:                                      # whole, word for word
                if any(w[p:p + len(x)] == x for p in (place.get(x[0], ()) if x else ())):
                    out.add((d, i))
                continue
            k = min(least, len(x))
            for g, c in collections.Counter(p - q for q, y in enumerate(x) for p in place.get(y, ())).items():
                lo, hi = max(g, 0), min(g + len(x), len(w))
                eq = [w[p] == x[p - g] for p in range(lo, hi)] if c >= share * k - 1e-9 else []
                if any(sum(eq[a:a + k]) >= share * k - 1e-9 for a in range(len(eq) - k + 1)):
                    out.add((d, i))
    return out


def test_masks_miss_no_tolerated_pattern():
    for width in range(o.SHORTEST, o.LEAST + 1):
        errors = int(width - o.SHARE * width + 1e-9)
        for bad in itertools.combinations(range(width), errors):
            assert any(not {at + x for x in m} & set(bad) for m in o.MASKS for at in range(width - m[-1])), (width, bad)


def test_query_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for sf in (SF, "/root/testdata/sf0.01"):
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        got = {(r.doc_id, r.item_id) for r in o.op8_spaced_seeds(spark, sf).collect()}
        assert got == brute(rows_of(spark, sf), items) and got


def test_substitutions_duplicates_and_short_items(spark):
    item = [f"t{i}" for i in range(20)]
    hurt = [w if i not in (4, 11, 17) else "zz" for i, w in enumerate(item)]
    lost = [w if i % 3 else "zz" for i, w in enumerate(item)]
    rows = [(1, "start " + " ".join(hurt).upper() + " end"), (2, " ".join(lost)), (3, " ".join(item[:12])),
            (4, " ".join(item[3:16])), (5, "s1 s2 s3 s4 s5 s6 s7 s8"), (6, "s1 s2 s3 s4 s5 s6 s7"), (7, None), (8, ""),
            (None, " ".join(item)), (4, " ".join(item[3:16]))]
    items = [(10, " ".join(item)), (11, " ".join(item)), (12, "s1 s2 s3 s4 s5 s6 s7 s8"), (13, "s1 s2 s3"), (14, None),
             (15, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (o.BITS, 64):                                   # a full filter costs time, not results
        out = o.contaminated(docs, bench, bits=bits).collect()
        assert {(r.doc_id, r.item_id, r.n_items) for r in out} == {(1, 10, 2), (4, 10, 2), (None, 10, 2), (5, 12, 1),
                                                                   (5, 13, 1), (6, 13, 1)}
        one = next(r for r in out if r.doc_id == 1)
        assert (one.start, one.item_start, one.length, one.matched) == (1, 0, 20, 17)


def test_items_of_one_to_eight_words(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abAc") for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    items = [(n, " ".join(rnd.choice("abc") for _ in range(n))) for n in range(1, 9)] + [(20, "zz"), (21, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = o.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == brute(rows, items) and len(out) == len(set(brute(rows, items)))
    text = dict(rows)
    for r in out:
        if r.item_id < 8:
            want = low(dict(items)[r.item_id])
            at = [p for p in range(41) if low(text[r.doc_id])[p:p + len(want)] == want]
            assert (r.start, r.item_start, r.length, r.matched) == (at[0], 0, len(want), len(want))


def test_unproven_parameters_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for bad in ({"share": 0.7}, {"least": 7}, {"least": 14}):
        with pytest.raises(ValueError):
            o.contaminated(docs, bench, **bad)


def test_empty_tables_and_stage(spark):
    docs = odd_docs(spark, ("item", "hits"))
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert o.contaminated(docs, bench.limit(0)).count() == 0 and o.contaminated(docs.limit(0), bench).count() == 0
    assert sorted((r.doc_id, r.matched) for r in o.contaminated(docs, bench).collect()) == [(1, 8), (9, 8)]
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r.doc_id for r in o.op8_spaced_seeds(spark, SF).collect()}
    left = o.stage(spark, whole, SF)
    assert left.columns == whole.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows_of(spark)} - bad
