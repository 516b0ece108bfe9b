"""Plan-shape guards for the scale design (checked on the physical plans)."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["g1_icd_dataset", "j3_labelled_admissions", "g2_mlm_corpus", "g4_link_radiology",
                                  "g5_pair_dataset", "g6_top_label_dataset", "g7_evaluate", "q9_pack_blocks"])
def test_no_cartesian_or_nested_loop_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_exact_split_does_not_shuffle_the_table(spark):
    p = plan(spark, "g1_icd_dataset")         # reads the checkpointed labelled table
    assert "Exchange" not in p and "Window" not in p


def test_cleaning_chain_evaluated_once(spark):
    p = plan(spark, "t8_clean_notes_icd")
    assert p.count("[\\s\\x1c-\\x1f]+") == 1   # the whitespace step of the chain


@pytest.mark.parametrize("name", ["q2_encode", "q9_pack_blocks", "g5_pair_dataset"])
def test_tokens_are_not_exploded(spark, name):
    p = plan(spark, name)
    assert "posexplode" not in p


def test_encoding_maps_arrays_in_place(spark):
    p = plan(spark, "q2_encode")
    assert "MapInArrow" in p and "hashpartitioning" not in p


@pytest.mark.parametrize("name", ["g1_icd_dataset", "g2_mlm_corpus", "g5_pair_dataset", "q9_pack_blocks"])
def test_no_single_partition_exchange_of_rows(spark, name):
    assert "SinglePartition" not in plan(spark, name)


def test_category_filter_reaches_the_parquet_scan(spark, tmp_path):
    from clinloom.operators.filters import filter_category
    rows = [(1, "Discharge summary "), (2, "Radiology"), (3, " Discharge summary")]
    spark.createDataFrame(rows, "row_id long, category string").write.parquet(str(tmp_path / "n"))
    df = filter_category(spark.read.parquet(str(tmp_path / "n")), "Discharge summary")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(category,Discharge summary)" in p
    assert sorted(r["row_id"] for r in df.collect()) == [1, 3]
