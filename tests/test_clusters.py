from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import clusters, search

SCHEMA = "id long, embedding array<double>"


@pytest.fixture(scope="module")
def grouped():
    """Vectors around a few directions, one of them with a third of all."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    at = np.where(rng.random(2400) < 0.33, 0, rng.integers(0, 12, 2400))
    return centres[at] * rng.uniform(0.5, 3, (2400, 1)) + 0.15 * rng.standard_normal((2400, 16))


def scores(df):
    return [(r.id, round(r.vector_score, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def rows(spark, grouped):
    odd = [(10_000, []), (10_001, [0.0] * 16), (10_002, None), (10_003, [1.0, 2.0, 3.0]), (10_004, [math.nan] * 16), (10_005, [1.0] * 20), (10_006, grouped[3].tolist()), (10_007, grouped[3].tolist())]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(grouped)] + odd, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return clusters.build(rows, str(tmp_path_factory.mktemp("clusters") / "index"))


@pytest.mark.parametrize("query", [0, 3, 700, [1.0] * 16, [0.0] * 15 + [-2.0], [1.0, 2.0], [0.0] * 16, []])
@pytest.mark.parametrize("k", [1, 10])
def test_rows_of_a_scan(rows, index, grouped, query, k):
    q = grouped[query].tolist() if isinstance(query, int) else query
    want = search.vector_topk(rows.where("embedding IS NOT NULL"), q, k)
    assert scores(index.topk(q, k)) == scores(want)
    if isinstance(query, int):
        assert index.read["rows_read"] < index.read["rows"] / 2 and index.read["rings_read"] < index.read["rings"]
    assert scores(index.topk(q, k, min_score=0.9)) == scores(search.vector_topk(rows.where("embedding IS NOT NULL"), q, k, min_score=0.9))


def test_all_rows_if_there_are_few(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    assert scores(clusters.build(few, str(tmp_path / "few")).topk([1.0, 0.0], 5)) == [(1, 1.0), (2, 0.0)]
    none = clusters.build(few.where(F.lit(False)), str(tmp_path / "none"))
    assert none.topk([1.0, 0.0], 5).count() == 0 and none.topk_many(few, 3, "id").count() == 0


def test_many_queries_at_once(spark, rows, index, grouped, monkeypatch):
    monkeypatch.setattr(clusters, "SLICE_ROWS", 300)
    monkeypatch.setattr(clusters, "CHUNK_QUERIES", 4)
    asked = [(i, grouped[i].tolist()) for i in range(0, 60, 2)] + [(100, [1.0, 2.0]), (101, [0.0] * 16), (102, None), (103, [])]
    found = index.topk_many(spark.createDataFrame(asked, SCHEMA), 4, "id").collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, round(r.vector_score, 9)))
    assert sorted(got) == sorted(i for i, v in asked if v and any(v))
    for i, v in asked:
        if i in got:
            assert got[i] == scores(search.vector_topk(rows.where("embedding IS NOT NULL"), v, 4))


def test_recall_of_the_nearest_clusters(rows, index, grouped):
    """A tenth of the clusters finds nine tenths of the best ten."""
    found, read = 0, 0
    for i in range(5, 2400, 300):
        q = grouped[i].tolist()
        exact = {r.id for r in search.vector_topk(rows.where("embedding IS NOT NULL"), q, 10).collect()}
        found += len(exact & {r.id for r in index.topk(q, 10, probes=5).collect()})
        read += index.read["rows_read"] / index.read["rows"]
    assert found >= 0.9 * 80 and read < 0.5 * 8


def test_only_picked_clusters_are_opened(index, grouped):
    plan = index.topk(grouped[0].tolist(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan.replace("isnotnull(cluster#", "cluster#") or "PartitionFilters: [isnotnull(cluster" in plan
