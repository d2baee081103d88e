from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.llm import graph


@pytest.fixture
def low_limits(spark):
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_node_with_a_million_edges_is_split(spark, low_limits):
    n = 1_000_000
    leaves = spark.range(1, n + 1, numPartitions=8).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    both = leaves.unionByName(leaves.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, _ = graph.pointed(both)
    sums = joined.agg(F.count("u").alias("n"), F.max("m").alias("m"), F.count_if(F.col("m") > F.least("u", "v")).alias("else"))
    assert tuple(sums.collect()[0]) == (2 * n, 0, 0)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan and "AQEShuffleRead skewed" in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_chain_a_star_and_loose_ends(spark, kind):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, None), (5, 4)]
    table = spark.createDataFrame(edges, "a long, b long").select(F.lpad(F.col("a").cast(kind), 9, "0").cast(kind).alias("a"), F.lpad(F.col("b").cast(kind), 9, "0").cast(kind).alias("b"))
    found = {(int(r.node), int(r.root)) for r in graph.components(table).collect()}
    assert found == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}
    assert graph.components(table.where(F.lit(False))).count() == 0
