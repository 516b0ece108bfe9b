import collections
import hashlib

from clinloom.llm import op7_substring_dedup as o
from tests.llm.helpers import ODD, SF, odd_docs, rows_of, words


def brute(rows, window):
    seqs = [[w.encode() for w in words(t)] for _, t in rows]
    seen = collections.Counter(tuple(s[i:i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = collections.Counter()
    for (d, _), s in zip(rows, seqs, strict=True):
        gone = {j for i in range(len(s) - window + 1) if seen[tuple(s[i:i + window])] > 1 for j in range(i, i + window)}
        left = b" ".join(w for j, w in enumerate(s) if j not in gone)
        out[d, len(s), len(gone), hashlib.sha256(left).hexdigest()] += 1
    return out


def got(df):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_query_equals_brute_force(spark):
    assert got(o.op7_substring_dedup(spark, SF)) == brute(rows_of(spark), 35)


def test_defined_cases(spark):
    docs = odd_docs(spark)
    for window, seed in ((35, 11), (3, 2), (2, 1), (5, 5)):
        assert got(o.substring_dedup(docs, window, seed)) == brute(ODD, window)
    assert o.substring_dedup(docs.limit(0)).count() == 0


def test_repetition_within_a_row_and_branching_paths(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, f"{a} {b} {c}"), (2, f"{a} {b}"), (3, f"{b} {c} tail"), (4, f"{c} {c}"), (5, "z " * 90), (6, f"pre {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(o.substring_dedup(df)) == brute(rows, 35)


def test_repeated_rows_hold_their_anchors_once(spark, monkeypatch):
    a, b = (" ".join(f"{x}{i}" for i in range(200)) for x in "ab")
    rows = [(None, a)] * 300 + [(7, b)] * 300 + [(8, f"{b} tail"), (9, "alone " + " ".join(f"c{i}" for i in range(60)))]
    made, write = {}, o.materialise
    monkeypatch.setattr(o, "materialise", lambda df, name: made.setdefault(name, write(df, name)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(o.substring_dedup(df)) == brute(rows, 35)
    hits = made["op7-hits"]
    assert 0 < hits.count() == hits.select("k1", "k2", "pos").distinct().count()


def test_stage_keeps_rows_and_columns(spark):
    docs = odd_docs(spark, ("n_chars", "_kept_text"))
    out = o.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(ODD)
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[5].text == "x" and kept[5].n_chars == 7 and kept[3].text is None
    long = kept[6]
    assert long.n_chars == len(long.text) < len(dict(ODD)[6])
