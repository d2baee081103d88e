"""Exact top-k search by inner product with the threshold algorithm.

Candidates lie in blocks. A block keeps a list of its vectors for each
dimension, sorted by that component. The queries of a batch read the lists from
the ends that help them, all to the same depth, and score whatever is met there.
A query stops as soon as the sum of what the lists still have to give it is
below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Components of a block, and most of its queries; with lists and queries they take about 100 MB.
BLOCK_CELLS = 1 << 21
#: Most queries that meet a block in one task.
CHUNK_QUERIES = 1 << 15
#: Scores that a batch of queries has at a time.
SCORE_CELLS = 1 << 22
#: How deep lists are read first; each further reading is four times as long.
FIRST_DEPTH = 16
#: Sums below a bound are exact in that type, others as whole numbers of any size.
_EXACT = ((2.0**24, np.float32), (2.0**53, np.float64), (np.inf, object))


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as a double; null for a vector that is null or has a null or a component that isn't finite."""
    wide = vector.cast("array<double>")
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(True)), F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


class Block:
    """Some vectors, as a matrix with a sorted list for each dimension."""

    def __init__(self, vectors: pa.ListArray, ids: list[list[int]]):
        self.ids = ids
        self.matrix = _matrix(vectors)
        self.first = np.array([i[0] for i in ids], np.int64)
        self.most = float(max(int(self.matrix.max(initial=0)), -int(self.matrix.min(initial=0))))
        self.longest = float(np.linalg.norm(self.matrix.astype(np.float64), axis=1).max(initial=0))
        columns = np.ascontiguousarray(self.matrix.T)
        # lists[d] has the rows by rising component d; 16 bits are sorted by their digits
        narrow = columns.astype(np.int16) if self.most < 1 << 15 else columns
        self.lists = np.argsort(narrow, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(narrow, self.lists, axis=1)
        self._read: tuple[bytes, np.ndarray, np.ndarray, np.ndarray] | None = None

    def best(self, query: np.ndarray, k: int) -> tuple[list[int], list[int], int]:
        """The best k ids with their scores (ties: the smaller id), and how many vectors were scored."""
        return self.best_of_each(query.reshape(1, -1), k)[0]

    def best_of_each(self, queries: np.ndarray, k: int, score_cells: int = SCORE_CELLS) -> list[tuple[list[int], list[int], int]]:
        """What `best` says of each row of `queries`."""
        queries = queries[:, : self.matrix.shape[1]]
        sums = self.most * np.abs(queries.astype(np.float64)).sum(axis=1)
        kinds = np.searchsorted([most for most, _ in _EXACT], sums, side="right")
        out: list = [None] * len(queries)
        for number, (_, kind) in enumerate(_EXACT):
            of_kind = np.flatnonzero(kinds == number)
            size = max(1, score_cells // len(self.ids) // (8 if kind is object else 1))
            for at in range(0, len(of_kind), size):
                some = of_kind[at : at + size]
                for i, found in zip(some, self._batch(queries[some].astype(kind), k), strict=True):
                    out[i] = found
        return out

    def _batch(self, queries: np.ndarray, k: int) -> list[tuple[list[int], list[int], int]]:
        n, width = len(self.ids), queries.shape[1]
        up, down = np.flatnonzero((queries > 0).any(axis=0)), np.flatnonzero((queries < 0).any(axis=0))
        order, depths, matrix = self._reading(up, down, queries.dtype)
        matrix = matrix[:, :width]
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)
        # what is not met yet has at most what the lists had last
        rest = lambda of, depth: above[of] @ self.sorted[:width, n - depth].astype(queries.dtype) + below[of] @ self.sorted[:width, depth - 1].astype(queries.dtype)
        reach = self.longest * np.linalg.norm(queries.astype(np.float64), axis=1)
        score, row = ([np.zeros(0, kind)] * len(queries) for kind in (queries.dtype, np.int64))
        scored = np.zeros(len(queries), np.int64)
        start, to, step = 0, 0, FIRST_DEPTH
        active = np.arange(len(queries))
        while start < n and len(active):
            to = min(n, to + step) if len(up) + len(down) else n
            # no score is above `reach`, so where the lists have more than that left for all, no search can end
            while to < n and (rest(active, to) >= reach[active]).all():
                step *= 4
                to = min(n, to + step)
            end = int(np.searchsorted(depths, to))
            # a few that are left are met at once
            if to == n or 8 * end > 7 * n:
                end = n
            for i, got in zip(active, queries[active] @ matrix[start:end].T, strict=True):
                new = _high(got, k, score[i][-1] if len(score[i]) == k else None)
                of, at = np.concatenate([score[i], got[new]]), np.concatenate([row[i], order[start + new]])
                top = np.lexsort((self.first[at], -of))[:k]
                score[i], row[i] = of[top], at[top]
            scored[active] += end - start
            start, step = end, 4 * step
            if start < n:
                active = active[[len(score[i]) < k or score[i][-1] <= most for i, most in zip(active, rest(active, to), strict=True)]]
        out = []
        for scores, rows, count in zip(score, row, scored, strict=True):
            each = sorted((-int(s), i) for s, r in zip(scores, rows, strict=True) for i in self.ids[r])[:k]
            out.append(([i for _, i in each], [-s for s, _ in each], int(count)))
        return out

    def _reading(self, up: np.ndarray, down: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows as they are met in the lists `up` from their high ends and `down` from their low ends, the depths where, and their vectors."""
        key = b"%s %s %s" % (up.tobytes(), down.tobytes(), str(kind).encode())
        if self._read is None or self._read[0] != key:
            n = len(self.ids)
            depths, here, rising = np.full(n, n, np.int32), np.empty(n, np.int32), np.arange(n, dtype=np.int32)
            for dimensions, places in ((up, rising[::-1]), (down, rising)):
                for d in dimensions:
                    here[self.lists[d]] = places
                    np.minimum(depths, here, out=depths)
            order = np.argsort(depths, kind="stable")
            self._read = key, order, depths[order], self.matrix[order].astype(kind)
        return self._read[1:]


def _high(scores: np.ndarray, k: int, least: float | None) -> np.ndarray:
    """Places of all scores of `least` and more; with None, of the k highest and perhaps some others."""
    if least is None:
        width = len(scores) // 64
        if width < k:
            return np.arange(len(scores))
        # k of the groups have their highest there
        least = np.partition(scores[: 64 * width].reshape(64, width).max(axis=0), width - k)[width - k]
    return np.flatnonzero(scores >= least)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """vector, ids: each vector once, with the `most` smallest ids that have it. No key's rows meet in one task: every task hands on its own smallest."""
    number = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("_n", number).where(F.col("_n") <= most)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block_cells: int = BLOCK_CELLS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, id, score: the k best rows of each query, by inner product; the query's own id is left out.

    Both tables have id (long) and vector (whole numbers). Ties go to the smaller
    id, so the result is one whatever the order of the rows. All rows are
    searched if there are fewer than k of them, and all are given.

    Rows or queries with a null id or vector take no part. Rows that repeat an id
    count once, with the least of its vectors; vectors of unequal length are filled with
    zeros, empty ones score 0. Equal vectors are searched once, with their k + 1
    smallest ids, which is all that a result can hold. Scores beyond 64 bits are
    cut off there. Empty tables give an empty result. Other columns are not looked at.

    Every query meets every block, in groups of at most about `chunk_queries`
    queries and `block_cells` components of either, so a group is bounded whatever the tables
    hold. A block is dealt out once for all the queries of a chunk, and a chunk once for each block.
    """
    spark = rows.sparkSession
    once = lambda t: t.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).groupBy(F.col("id").cast("long").alias("id")).agg(F.min("vector").alias("vector"))
    vectors, asked = written(distinct_vectors(once(rows), k + 1), "vectors"), written(once(queries), "queries")
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    n_queries, width = asked.count(), max(1, width)
    # smaller blocks, and then smaller chunks, if there are fewer than enough for all cores
    wanted = 3 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n * width // block_cells), min(wanted, 16 * n * width // block_cells))
    chunks = max(1, -(-n_queries // min(chunk_queries, max(1, block_cells // width))), min(-(-wanted // blocks), n_queries // 1024))
    left = vectors.select(F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vector", "ids")
    # components beyond the rows' meet zeros only
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "id", F.slice("vector", 1, width).alias("vector"))

    def search(group: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list[int]] = {"query_id": [], "id": [], "score": []}
        if group.num_rows and queries.num_rows:
            block = Block(group.column("vector").combine_chunks(), group.column("ids").to_pylist())
            found = block.best_of_each(_matrix(queries.column("vector").combine_chunks()), k + 1)
            for query_id, (ids, scores, _) in zip(queries.column("id").to_pylist(), found, strict=True):
                out["query_id"] += [query_id] * len(ids)
                out["id"] += ids
                out["score"] += [max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores]
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    hits = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.where(F.col("id") != F.col("query_id")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
