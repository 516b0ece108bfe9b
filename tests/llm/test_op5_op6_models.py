import zlib

import numpy as np

from clinloom.llm import op5_word_first_langid as o5
from clinloom.llm import op6_toxicity_mil as o6
from tests.llm.helpers import ODD, SF, odd_docs

SF10 = "/root/testdata/sf0.1"


def crc(d, m):
    return zlib.crc32(str(d).encode()) % m


def test_language_query(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = o5.op5_word_first_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in out if r.held_out and docs[r.doc_id]]) >= 0.95


def test_language_defined_cases(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog", "en"), ("der Hund und die Katze", "de"))]
    train = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = o5.train(train)
    ask = spark.createDataFrame([(1, "The dogs"), (2, "Katzen Hunde"), (3, None), (4, ""), (5, "123 !? __"), (None, "und der"),
                                 (1, "The dogs"), (6, "ЖЖЖ")], "doc_id long, text string").selectExpr("*", "'x' AS lang", "1 AS score")
    got = [(r.doc_id, r.lang_pred) for r in o5.predict(ask, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (1, "en"),
                                           (6, "de")], key=str)       # nothing known: the first language
    assert o5.predict(odd_docs(spark), model).count() == len(ODD) and o5.predict(ask.limit(0), model).count() == 0
    none = o5.train(train.limit(0))
    assert {r.lang_pred for r in o5.predict(ask, none).collect()} == {"und"}


def test_unseen_words_fall_back_order_by_order():
    units = [{"known": 0}, {c: i for i, c in enumerate("abc")}, {"<a": 0, "bx": 1}, {}, {}, {}]
    logs = [np.array([[-1., -2.]], np.float32), np.log(np.array([[.1, .2], [.3, .4], [.5, .6]], np.float32)),
            np.array([[-3., -4.], [-5., -7.]], np.float32), *[np.zeros((0, 2), np.float32)] * 3]
    assert o5.word_scores("Known", units, logs, 2)[0].tolist() == [-1, -2]
    assert o5.word_scores("abx", units, logs, 2)[0].tolist() == [-4, -5.5]       # both known bigrams, averaged
    assert np.allclose(o5.word_scores("cc", units, logs, 2)[0], logs[1][2])
    assert o5.word_scores("12", units, logs, 2) [1] == 0


def test_every_learned_word_stays_known(spark):
    def name(i):
        return "qu" + "".join(chr(97 + i // 26**k % 26) for k in range(4))

    large = [(i, " ".join([name(j) for j in range(i * 500, i * 500 + 500)] * 2), "aa") for i in range(180)]
    small = [(1000 + i, f"quaabzz drib{chr(97 + i)}", "bb") for i in range(12)]
    docs = spark.createDataFrame(large + small, "doc_id long, text string, lang string")
    model = o5.train(docs)
    learned = {w for d, t, _ in large + small if crc(d, 4) != 2 for w in t.split()}
    assert len(learned) > 50_000 and len(model["orders"][0]["keys"]) == len(learned)
    ask = spark.createDataFrame([(1, "quaabzz", "x")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in o5.predict(ask, model).collect()] == ["bb"]


def test_many_languages_and_hashed_scores_equal_plain_ones(spark):
    docs = spark.createDataFrame([(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} same text {'xyz'[i % 3]}", f"l{i // 2:03}")
                                  for i in range(1200)], "doc_id long, text string, lang string")
    model = o5.train(docs)
    width = len(model["langs"])
    assert width > 256
    words = ["same", "text", "wab", "zzzsame", "q", "éé", "te"]
    seen = {w for w in words} | {g for w in words for k in range(1, 6) for g in o5.grams(w, k)}
    units, logs = [], []
    for o in model["orders"]:
        at = {w: i for i, w in enumerate(sorted(seen)) if o5._hash([w])[0] in o["keys"]}
        rows = np.tile(o["base"], (len(seen), 1))
        for w, i in at.items():
            j = np.searchsorted(o["keys"], o5._hash([w])[0])
            cut = slice(o["ptr"][j], o["ptr"][j + 1])
            rows[i, o["lang"][cut]] += o["more"][cut]
        units.append(at)
        logs.append(rows)
    plain = np.array([o5.word_scores(w, units, logs, width)[0] for w in words])
    assert np.allclose(o5.many_scores(words, model["orders"], width), plain, rtol=1e-5)
    assert o5.predict(docs, model).count() == 1200


def test_toxicity_query_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF10}/labels.parquet").collect()}
    out = o6.op6_toxicity_mil(spark, SF10).collect()
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc(r.doc_id, 4) == 2) for r in out)
    hit = np.mean([r.predicted for r in held if labels[r.doc_id]])
    false = np.mean([r.predicted for r in held if not labels[r.doc_id]])
    assert hit >= 0.85 and false <= 0.02


def test_toxicity_sentence_and_defined_cases(spark):
    clean = [f"Word{i} stays calm here. Nothing {i} to see" for i in range(120)]
    bad = [f"Fine start {i}. you utter blorgface{i % 3} now! calm end" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(180)], "doc_id long, toxic int")
    model = o6.train(docs, labels)
    r = {x.doc_id: x for x in o6.toxicity(docs, model).collect()}
    assert all(r[i].predicted == (i >= 120) for i in r)
    one = r[130]
    words = bad[10].split()
    assert one.sentence == 1 and words[one.word_from:one.word_to] == ["you", "utter", "blorgface1", "now!"]
    odd = o6.toxicity(odd_docs(spark, ("predicted", "sentence")), model).collect()
    assert len(odd) == len(ODD) and all(x.score == 0 and x.sentence == -1 for x in odd if x.doc_id in (2, 3, 4))
    assert {x.score for x in o6.toxicity(docs, o6.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert {x.score for x in o6.toxicity(docs, o6.train(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert o6.toxicity(docs.limit(0), model).count() == 0
    known = list(model["words"])
    ask = known + ["Blorgface1,blorgface2", "", "İx", "a\x1cb", "none"]
    assert np.allclose(o6.word_weights(model["words"])(ask)[:, 0],
                       [sum(model["words"].get(f, 0) for f in o6.features(w)) for w in ask])


def test_toxicity_stage_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = o6.stage(spark, docs, SF)
    assert out.columns == docs.columns
    gone = {r.doc_id for r in o6.op6_toxicity_mil(spark, SF).collect() if r.predicted}
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - gone
