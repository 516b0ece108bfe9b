import collections

import corpus_pipeline
from clinloom.llm import op6_toxicity_mil as o6
from tests.llm import test_op2_op4_tokens as t2
from tests.llm import test_op7_substring as t7
from tests.llm import test_op8_seeds as t8
from tests.llm import test_op10_jaccard as t10
from tests.llm.helpers import SF, rows_of, words


def after_stages(spark, rows):
    """The rows each stage leaves, by the operators' plain versions (the first by its own scores)."""
    toxic = {r.doc_id for r in o6.op6_toxicity_mil(spark, SF).collect() if r.predicted}
    rows = [r for r in rows if r[0] not in toxic]
    yield rows
    of = {k[0]: k[1] for k in t10.brute(rows)}
    rows = [r for r in rows if of[r[0]] == r[0] or not words(r[1])]
    yield rows
    cut = {}
    seqs = {d: words(t) for d, t in rows}
    seen = collections.Counter(tuple(s[i:i + 35]) for s in seqs.values() for i in range(len(s) - 34))
    for d, t in rows:
        s = seqs[d]
        gone = {j for i in range(len(s) - 34) if seen[tuple(s[i:i + 35])] > 1 for j in range(i, i + 35)}
        cut[d] = " ".join(w for j, w in enumerate(s) if j not in gone) if gone else t
    rows = list(cut.items())
    yield rows
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in t8.brute(rows, items)}
    yield [r for r in rows if r[0] not in bad]


def test_stages_equal_their_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, after_stages(spark, rows_of(spark)), strict=False):
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
    t2.check_packing(want, corpus_pipeline.run(spark, SF).collect())


def test_names_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_spans", "decontamination",
                                                      "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and t7.ODD
