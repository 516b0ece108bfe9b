"""Same results with 1 and 8 shuffle partitions."""

import pytest

import __spark_entry__ as entry
from tests.test_oracle import digest

SF = "/root/testdata/sf0.001"
NAMES = ["g1_icd_dataset", "g2_mlm_corpus", "g4_link_radiology", "g5_pair_dataset", "g6_top_label_dataset",
         "g7_evaluate", "q9_pack_blocks", "q9_pack_blocks_doc_order", "g8_pretraining_blocks", "q2_encode_large",
         "u8_bucket_by_length", "l1_order_by", "a1_hot", "a2_hot", "m1_mean_pool"]


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_does_not_change_results(spark, name):
    q = entry.queries()[name]
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = q(spark, SF)
        results.append(digest(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


@pytest.mark.parametrize("name", ["d1_study_timestamp", "j9_link_same_day", "g4_link_radiology"])
def test_session_time_zone_does_not_change_results(spark, name):
    q = entry.queries()[name]
    results = []
    for tz in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        df = q(spark, SF)
        results.append(digest(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(set(results)) == 1
