"""Closed forms against loops, packing totals, feature layout."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinloom.operators import sequences as Q


def loop_truncate(la, lb, m):
    while la + lb > m:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


def closed_form(la, lb, m):
    if la + lb <= m:
        return la, lb
    return min(la, max(m - lb, (m + 1) // 2)), min(lb, max(m - la, m // 2))


@settings(max_examples=500, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 300))
def test_truncate_pair_closed_form_equals_loop(la, lb, m):
    assert closed_form(la, lb, m) == loop_truncate(la, lb, m)


def test_truncate_pair_in_spark(spark):
    rows = [(la, lb) for la in range(0, 12) for lb in range(0, 12)]
    df = spark.createDataFrame(rows, "la int, lb int").select(
        F.array_repeat(F.lit(1), "la").alias("a"), F.array_repeat(F.lit(2), "lb").alias("b"), "la", "lb")
    a, b = Q.truncate_pair(F.col("a"), F.col("b"), 9)
    for r in df.select("la", "lb", F.size(a).alias("na"), F.size(b).alias("nb")).collect():
        assert (r["na"], r["nb"]) == loop_truncate(r["la"], r["lb"], 9)


def test_tokenize_and_vocab(spark):
    df = spark.createDataFrame([(1, "The cat, the DOG."), (2, "a cat")], "k long, text string")
    tok = df.select("k", Q.tokenize(F.col("text")).alias("tokens"))
    assert tok.orderBy("k").first()["tokens"] == ["the", "cat", ",", "the", "dog", "."]
    vocab = {r["token"]: r["id"] for r in Q.build_vocab(tok, "tokens").collect()}
    assert vocab["cat"] == Q.N_SPECIAL and vocab["the"] == Q.N_SPECIAL + 1   # frequency, then token order
    ids = Q.encode(tok, "k", ["tokens"], Q.build_vocab(tok.where("k = 1"), "tokens"), head_bytes=2)
    got = {r["k"]: r["tokens_ids"] for r in ids.collect()}
    assert got[2][0] == Q.UNK_ID and len(got[1]) == 6      # head/tail lookup and unknown id


def test_pair_features_layout(spark):
    df = spark.createDataFrame([([5, 6, 7], [8, 9]), ([5], [])], "a array<int>, b array<int>")
    out = Q.pair_features(df, "a", "b", 8).collect()
    assert out[0]["input_ids"] == [2, 5, 6, 7, 3, 8, 9, 3]
    assert out[0]["segment_ids"] == [0, 0, 0, 0, 0, 1, 1, 1]
    assert out[1]["input_ids"] == [2, 5, 3, 0, 0, 0, 0, 0] and out[1]["input_mask"] == [1, 1, 1, 0, 0, 0, 0, 0]
    long = spark.createDataFrame([(list(range(10, 20)), list(range(30, 40)))], "a array<int>, b array<int>")
    r = Q.pair_features(long, "a", "b", 8).first()
    assert r["input_ids"] == [2, 10, 11, 12, 3, 30, 31, 3] and r["seq_len"] == 20


def test_pack_blocks_totals(spark):
    docs = [(f"d{i:03d}", list(range(i % 7 + 1))) for i in range(50)]
    df = spark.createDataFrame(docs, "k string, ids array<int>").repartition(4)
    total = sum(len(x) for _, x in docs)
    out = Q.pack_blocks(df, "k", "ids", 10, add_special=False).orderBy("block_id").collect()
    assert len(out) == total // 10
    flat = [t for _, x in sorted(docs) for t in x]
    assert [t for r in out for t in r["input_ids"]] == flat[: len(out) * 10]


def test_mask_tokens_properties(spark):
    df = spark.createDataFrame([(i, [2] + list(range(5, 205)) + [3]) for i in range(20)], "block_id long, ids array<int>")
    out = Q.mask_tokens(df, "ids", "block_id", vocab_size=300).collect()
    chosen = masked = 0
    for r in out:
        for x, m, lab in zip(r["ids"], r["masked_ids"], r["labels"]):
            if x < Q.N_SPECIAL:
                assert m == x and lab == Q.IGNORE_LABEL
            if lab != Q.IGNORE_LABEL:
                chosen += 1
                assert lab == x
                masked += m == Q.MASK_ID
            else:
                assert m == x
    assert 0.1 < chosen / 4000 < 0.2 and 0.7 < masked / chosen < 0.9
    again = Q.mask_tokens(df.repartition(3), "ids", "block_id", vocab_size=300).collect()
    assert sorted(map(tuple, [(r["block_id"], tuple(r["masked_ids"])) for r in out])) == \
        sorted((r["block_id"], tuple(r["masked_ids"])) for r in again)


def test_line_blocks_and_mask(spark):
    df = spark.createDataFrame([(list(range(5, 15)),)], "ids array<int>")
    r = Q.line_blocks(df, "ids", 6).first()
    assert r["input_ids"] == [2, 5, 6, 7, 8, 3] and r["attention_mask"] == [1] * 6


def test_vocab_and_encoding_above_the_broadcast_bound(spark):
    rows = [(i, [f"t{(i * j) % 37}" for j in range(1, 9)], None if i % 9 == 0 else [f"u{i % 4}", "absent"])
            for i in range(60)]
    tok = spark.createDataFrame(rows, "k long, tokens array<string>, more array<string>").repartition(4)
    vocab = Q.build_vocab(tok, "tokens")
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(Q.N_SPECIAL, Q.N_SPECIAL + len(ids)))
    want = {k: ([ids[t] for t in a], [Q.UNK_ID] * len(b or [])) for k, a, b in rows}
    for bound in (1 << 20, 200, 1):
        out = Q.encode(tok, "k", ["tokens", "more"], vocab, head_bytes=bound).collect()
        assert {r["k"]: (r["tokens_ids"], r["more_ids"]) for r in out} == want


def test_pad_longest(spark):
    df = spark.createDataFrame([(0, [5]), (0, [5, 6, 7]), (1, []), (1, [8] * 9)], "batch_id int, ids array<int>")
    got = sorted((r["batch_id"], r["input_ids"]) for r in Q.pad_longest(df, "ids", max_len=4).collect())
    assert got == [(0, [5, 0, 0]), (0, [5, 6, 7]), (1, [0, 0, 0, 0]), (1, [8, 8, 8, 8])]


def test_pack_blocks_hash_and_range_order(spark):
    import hashlib
    docs = [(hashlib.md5(str(i).encode()).hexdigest(), list(range(i % 9 + 1))) for i in range(80)]
    df = spark.createDataFrame(docs, "k string, ids array<int>").repartition(3)
    flat = [t for _, x in sorted(docs) for t in x]
    for hashed in (True, False):
        out = Q.pack_blocks(df, "k", "ids", 12, order_is_hash=hashed).orderBy("block_id").collect()
        got = [t for r in out for t in r["input_ids"][1:-1]]
        assert got == flat[: len(out) * 10] and len(out) == len(flat) // 10


def _coded(spark, rows, vocab, head_bytes, monkeypatch):
    made, write = {}, Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, name="table": made.setdefault(name, write(df, name)))
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>, extra string").repartition(3)
    v = spark.createDataFrame([(t, n, i + Q.N_SPECIAL) for i, (t, n) in enumerate(vocab)], "token string, n long, id int")
    out = Q.encode(df, "k", ["a", "b"], v, head_bytes=head_bytes, carry=["extra"])
    return {r.k: (r.a_ids, r.b_ids, r.extra) for r in out.collect()}, made


def test_only_misses_are_joined(spark, monkeypatch):
    """Tokens of the head never enter a shuffle; unknown ones are UNK; nulls and empty arrays stay apart."""
    vocab = [("the", 90), ("of", 80), ("émile", 5), ("rare", 2), ("zz", 1)]
    ids = {t: i + Q.N_SPECIAL for i, (t, _) in enumerate(vocab)}
    rows = [(1, ["the", "rare", "the", "no"], ["zz", "rare"], "x"), (2, [], None, None), (3, None, ["of"], "y"),
            (4, ["no"] * 5 + ["émile"], ["the"], "z"), (5, ["the", "of"], [], "w")]
    want = {k: ([ids.get(t, Q.UNK_ID) for t in a or ()], [ids.get(t, Q.UNK_ID) for t in b or ()], e) for k, a, b, e in rows}
    got, made = _coded(spark, rows, vocab, 2 * 27, monkeypatch)
    assert got == want
    seen = {t for r in made["coded"].select(Q.MISSES).collect() for t in r[0] or ()}
    assert seen and not seen & {"the", "of"}
    assert made["coded"].where(f"{Q.MISSES} IS NULL").count() == 3         # rows that never meet a shuffle
    assert {r.token for r in made["known-misses"].collect()} <= {"émile", "rare", "zz"}
    whole, none = _coded(spark, rows, vocab, 1 << 20, monkeypatch)
    assert whole == want and "coded" not in none


def test_large_vocabulary_equals_small(spark, monkeypatch):
    import random
    rnd = random.Random(5)
    vocab = [(f"t{i}", 1000 - i) for i in range(400)]
    rows = [(k, [f"t{min(int(rnd.expovariate(0.02)), 450)}" for _ in range(rnd.randint(0, 60))],
             [f"t{rnd.randint(0, 500)}" for _ in range(rnd.randint(0, 9))], str(k)) for k in range(200)]
    small, _ = _coded(spark, rows, vocab, 1 << 20, monkeypatch)
    for head_bytes in (1, 200, 4000):
        assert _coded(spark, rows, vocab, head_bytes, monkeypatch)[0] == small


def test_head_table_survives_hash_clashes(monkeypatch):
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    monkeypatch.setattr(pd.util, "hash_array", lambda v: np.array([len(x) for x in v], np.uint64))
    table = Q.HeadTable(pa.array(["a", "b", "cc", "ddd"]), np.array([7, 8, 9, 10]))
    assert table(pa.array(["b", "x", "a", "ddd", "zz", "cc"])).tolist() == [8, -1, 7, 10, -1, 9]
