from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import topk


def plain(rows, queries, k):
    """Set of (query_id, rank, id, score); rows and queries: id -> vector."""
    out = set()
    for q, x in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in rows.items() if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("query_id", "rank", "id", "score").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1.0) for i, v in rows], "id long, vector array<long>, score double").repartition(3)


@pytest.mark.parametrize(("values", "cells"), [(range(-3, 4), 64), (range(-1, 2), 40), (range(-900, 900), 1 << 21), ([-(10**8), 10**8, 7], 128)])
def test_all_scores(spark, values, cells):
    rng = random.Random(len(values))
    rows = {i: [rng.choice(values) for _ in range(rng.choice([4, 4, 3]))] for i in range(0, 300, 3)}
    queries = {i: v for i, v in rows.items() if i % 10 == 0} | {-5: [0, 0, 0, 0], 1000: [], 1001: [1, -1]}
    got = found(topk.top_k(table(spark, rows.items()), table(spark, queries.items()), 5, block_cells=cells, chunk_queries=4))
    assert got == plain(rows, queries, 5)


def test_ties_repeats_nulls_and_few_rows(spark):
    same = {i: [5, 5] for i in range(40)}
    rows = list(same.items()) + [(3, [5, 5]), (7, [9, 9]), (None, [9, 9]), (99, None), (77, [1, 1])]
    want = plain(same | {77: [1, 1]}, {3: [5, 5], 39: [5, 5], 500: [-1, 0]}, 6)
    queries = [(3, [5, 5]), (3, [5, 5]), (39, [5, 5]), (39, [6, 0]), (500, [-1, 0]), (None, [1, 1]), (4, None)]
    assert found(topk.top_k(table(spark, rows), table(spark, queries), 6, block_cells=20)) == want
    few = {1: [1], 2: [2]}
    assert found(topk.top_k(table(spark, few.items()), table(spark, few.items()), 5)) == plain(few, few, 5)
    none = table(spark, [(1, [1])]).where(F.lit(False))
    assert topk.top_k(none, table(spark, [(1, [1])])).count() == 0 and topk.top_k(table(spark, [(1, [1])]), none).count() == 0


def test_integer_vectors(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [math.nan]), (4, [math.inf]), (5, []), (6, [1e-9, -1.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>").select("i", topk.integer_vector(F.col("v")).alias("v"))
    assert {r.i: r.v for r in df.collect()} == {0: [128, -1], 1: None, 2: None, 3: None, 4: None, 5: [], 6: [0, -256]}


def test_large_sums_are_exact_and_cut_off(spark):
    big = 1 << 62
    rows = {1: [big, 1], 2: [big, 2], 3: [-big, -big], 4: [(1 << 53) + 1, 0], 5: [1 << 53, 0]}
    got = found(topk.top_k(table(spark, rows.items()), table(spark, [(0, [1, 1]), (9, [4, 0])]), 5))
    assert {(q, i): s for q, _, i, s in got if q == 0} == {(0, 1): big + 1, (0, 2): big + 2, (0, 4): (1 << 53) + 1, (0, 5): 1 << 53, (0, 3): -(1 << 63)}
    assert {(r, i): s for q, r, i, s in got if q == 9} == {(1, 1): (1 << 63) - 1, (2, 2): (1 << 63) - 1, (3, 4): 4 * ((1 << 53) + 1), (4, 5): 1 << 55, (5, 3): -(1 << 63)}


def test_the_threshold_stops_the_reading():
    """Where few components are large, few vectors are scored; the result is that of scoring all."""
    rng = np.random.default_rng(3)
    m = np.floor(256 * rng.standard_normal((20_000, 16)) * (rng.random((20_000, 16)) < 0.02) ** 1.0).astype(np.int64)
    block = topk.Block(pa.array(m.tolist(), pa.list_(pa.int64())), [[i] for i in range(len(m))])
    shares = []
    for q in m[(m != 0).sum(axis=1) == 1][:20]:
        ids, scores, scored = block.best(q, 5)
        s = m @ q
        order = np.lexsort((np.arange(len(m)), -s))[:5]
        assert ids == order.tolist() and scores == s[order].tolist()
        shares.append(scored / len(m))
    assert max(shares) < 0.02


def test_each_query_of_a_batch_has_its_own_best():
    """Dense, sparse, zero, short and very large queries in one batch, many ties; batches of any size."""
    rng = random.Random(11)
    rows = {i: [rng.choice([-3, -1, 0, 0, 2, 40]) for _ in range(rng.choice([6, 6, 4]))] for i in range(0, 1200, 3)}
    first = {tuple(v + [0] * (6 - len(v))): i for i, v in sorted(rows.items(), reverse=True)}
    ids = {v: [i for i, x in rows.items() if tuple(x + [0] * (6 - len(x))) == v] for v in first}
    block = topk.Block(pa.array([list(v) for v in ids], pa.list_(pa.int64())), list(ids.values()))
    queries = [[rng.choice([-7, 0, 0, 5]) for _ in range(6)] for _ in range(60)] + [[0] * 6, [0, 0, 9, 0, 0, 0], [1 << 40, 3, 0, 0, -1, 2], [1 << 61, 1, -1, 0, 0, 0], [-(1 << 63), 0, 0, 0, 0, 1]]
    want = [sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in rows.items())[:5] for q in queries]
    for cells in (1, 2500, 1 << 22):
        got = block.best_of_each(np.array(queries, np.int64), 5, cells)
        assert [[(-s, i) for i, s in zip(ids, scores, strict=True)] for ids, scores, _ in got] == want
    short = block.best_of_each(np.array([q[:2] for q in queries], np.int64), 5)
    assert [s for _, s, _ in short] == [sorted((sum(a * b for a, b in zip(q[:2], v, strict=False)) for v in rows.values()), reverse=True)[:5] for q in queries]


class Counted(np.ndarray):
    """Counts products and their multiplications."""

    calls = multiplications = 0

    def __array_ufunc__(self, ufunc, method, *inputs, **more):
        inputs = [np.asarray(x) if isinstance(x, Counted) else x for x in inputs]
        out = getattr(ufunc, method)(*inputs, **more)
        if ufunc is np.matmul:
            Counted.calls += 1
            Counted.multiplications += np.size(out) * inputs[0].shape[-1]
        return out


def test_vectors_without_structure_are_scored_once_and_together():
    """No bound holds before nearly all is met, so the work is one product of the queries and the rows, in few calls."""
    rng = np.random.default_rng(4)
    m = rng.standard_normal((20_000, 64))
    m = np.floor(256 * m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.int64)
    block = topk.Block(pa.array(m.tolist(), pa.list_(pa.int64())), [[i] for i in range(len(m))])
    block.matrix = block.matrix.view(Counted)
    Counted.calls = Counted.multiplications = 0
    got = block.best_of_each(m[:200], 6)
    assert Counted.calls < 20 and Counted.multiplications <= 200 * m.size
    for q, (ids, scores, scored) in zip(m, got, strict=False):
        s = m @ q
        order = np.lexsort((np.arange(len(m)), -s))[:6]
        assert ids == order.tolist() and scores == s[order].tolist() and scored <= len(m)
