"""Plans have the shape that scale needs: narrow scans, pushed filters, no cross joins, no sorts of whole tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import index, inverted, search
from quarry.plans import catalog
from quarry.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_asked_for(spark, sf_dir):
    text = plan(catalog.vector_topk_filtered(spark, sf_dir))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in text and "PushedFilters: [In(label, [1,2,3])]" in text and "TakeOrderedAndProject" in text
    narrow = plan(catalog.registry_machine(spark, sf_dir))
    assert "o_totalprice" not in narrow and "EqualTo(o_orderpriority,2-HIGH)" in narrow


@pytest.mark.parametrize("name", ["index_diff", "sync_status", "hybrid_merge", "registry_collisions", "cache_upsert", "stream_last_event", "multi_dir_search", "push_plan", "embed_chunks"])
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


def test_counts_are_partial_first(spark, sf_dir):
    text = plan(catalog.registry_collisions(spark, sf_dir))
    assert "partial_count" in text and "partial_collect_set" in text and text.count("Exchange hashpartitioning") == 1


def test_index_queries_open_their_buckets_only(spark, sf_dir, tmp_path):
    docs = catalog.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    written = inverted.build(docs, str(tmp_path / "i"), buckets=16)
    text = plan(written.postings(["eau", "the"], 16))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text) and "In(term, [eau,the])" in text


def test_small_tables_are_spread(spark, sf_dir):
    one = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=9)
    assert spread(many) is many


def test_unchanged_files_are_not_cut_again(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    stored = index.file_entries(files)
    assert index.chunk_rows(index.to_index(files, stored), "m", 1).count() == 0


def test_candidates_are_limited_before_they_are_merged(spark, sf_dir):
    text = plan(catalog.hybrid_search_e2e(spark, sf_dir))
    assert text.count("TakeOrderedAndProject") >= 3 and search.candidate_count(10) == 20
