"""Exact vector search over written clusters that a bound can leave unread.

Vectors are dealt to the nearest of some centroids, and within a cluster to
rings by their angle to it. The angle between two directions is a distance, so a
query at angle t to a centroid is at least |t - a| from a vector at angle a:
rings whose bound is below the k-th score so far are not read. What is left out
can't be among the best, so the result is that of a scan; an approximate search
reads the nearest clusters only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vector import cosine

#: Rows that centroids are fitted on, and the most of them. All rows are indexed.
SAMPLE_ROWS, MOST_CLUSTERS = 20_000, 2048
#: Rings of a half turn.
RINGS = 64
#: The cluster of vectors that have no direction or another length than most: always read.
REST = -1
#: Rows of a cluster that meet queries in one task, and queries that meet them.
SLICE_ROWS, CHUNK_QUERIES = 32_768, 1024
#: Angles are sums of rounded products; this is more than that changes.
_SLACK = 1e-6


def _unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / norm)


def build(table: DataFrame, path: str, id_col: str = "id", embedding: str = "embedding", clusters: int | None = None, seed: int = 7) -> VectorIndex:
    """Write the index of a table's vectors below `path`.

    About sqrt(rows) clusters by default. Centroids are fitted on a sample of
    at most SAMPLE_ROWS rows. Null vectors are left out; vectors without a
    direction (empty, zero or with components that aren't finite) and vectors of
    another length than most lie in a cluster that every search reads.
    """
    spark = table.sparkSession
    rows = table.where(F.col(embedding).isNotNull()).select(F.col(id_col).alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dims, n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (0, 0)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    # squares of very large or small components have no use either
    sound = (F.size("embedding") == dims) & F.lit(dims > 0) & ~odd & (norm > 1e-200) & (norm < 1e200)
    wanted = clusters or max(1, min(MOST_CLUSTERS, round(math.sqrt(n))))
    share = min(1.0, 1.1 * SAMPLE_ROWS / max(1, n))
    sample = rows.where(sound).sample(share, seed).limit(SAMPLE_ROWS).select(array_to_vector(_unit(F.col("embedding"))).alias("features"))
    centroids = np.zeros((0, dims))
    if n and wanted == 1:
        # any direction will do
        centroids = np.array([r["features"].toArray() for r in sample.limit(1).collect()]).reshape(-1, dims)
    elif n and not sample.isEmpty():
        found = np.array(KMeans(k=wanted, distanceMeasure="cosine", maxIter=8, seed=seed).fit(sample).clusterCenters())
        size = np.linalg.norm(found, axis=1)
        centroids = found[size > 1e-9] / size[size > 1e-9, None]
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_CLUSTERS vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            ok = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(len(c))
            at, angle = np.full(batch.num_rows, REST, np.int32), np.zeros(batch.num_rows)
            if ok.any():
                x = np.array(batch.column(1).filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
                near = x @ c.T / np.linalg.norm(x, axis=1)[:, None]
                best = near.argmax(axis=1)
                at[ok], angle[ok] = best, np.arccos(np.clip(near[np.arange(len(x)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(angle)], names=["id", "embedding", "cluster", "angle"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).mapInArrow(nearest, f"id {kind}, embedding array<double>, cluster int, angle double")
    dealt = dealt.withColumn("ring", F.floor(F.col("angle") / math.pi * RINGS).cast("int"))
    # a cluster with very many rows is split over tasks
    dealt.hint("rebalance", "cluster").sortWithinPartitions("cluster", "ring").write.partitionBy("cluster").parquet(f"{path}/vectors")
    schema = f"id {kind}, embedding array<double>, angle double, ring int, cluster int"
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    stored.groupBy("cluster", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).write.parquet(f"{path}/rings")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centroids)], "cluster int, centroid array<double>").write.parquet(f"{path}/centroids")
    return VectorIndex(spark, path, schema)


@dataclass
class VectorIndex:
    """A written index, opened for queries. `read` says how many rings and rows the last search read, of how many."""

    spark: SparkSession
    path: str
    schema: str = "id long, embedding array<double>, angle double, ring int, cluster int"
    read: dict[str, int] = field(default_factory=dict)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def _headers(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Centroids, and cluster, ring, n, least and most of each ring: a few thousand vectors and their rings, whatever the table has."""
        c = self.spark.read.schema("cluster int, centroid array<double>").parquet(f"{self.path}/centroids").orderBy("cluster").collect()
        r = self.spark.read.schema("cluster int, ring int, n long, least double, most double").parquet(f"{self.path}/rings").orderBy("cluster", "ring").collect()
        return np.array([x["centroid"] for x in c]), {k: np.array([x[k] for x in r]) for k in ("cluster", "ring", "n", "least", "most")}

    def _picked(self, rings: dict[str, np.ndarray], which: np.ndarray) -> DataFrame:
        """The rows of some rings: other clusters' folders are not opened, other rings' row groups are passed over."""
        rows = self.vectors()
        by: dict[int, list[int]] = {}
        for c, r in zip(rings["cluster"][which].tolist(), rings["ring"][which].tolist(), strict=True):
            by.setdefault(c, []).append(r)
        if not by:
            return rows.where(F.lit(False))
        pairs = self.spark.createDataFrame([(c, r) for c, rs in by.items() for r in rs], "cluster int, ring int")
        return rows.where(F.col("cluster").isin(list(by))).join(F.broadcast(pairs), ["cluster", "ring"], "left_semi")

    def topk(self, query: list[float], k: int, min_score: float | None = None, probes: int | None = None, without: DataFrame | None = None) -> DataFrame:
        """id and vector_score: the rows of `search.vector_topk`, ties by id. With `probes` the nearest so many clusters are read and no others.

        `without` has ids (id) of rows that are gone since the index was written.
        """
        centroids, rings = self._headers()
        q = np.array(query, float)
        usable = len(centroids) and len(q) == centroids.shape[1] and 1e-100 < np.linalg.norm(q) < 1e100
        angle, best = _bounds(centroids, rings, q / np.linalg.norm(q)) if usable else (np.zeros(len(rings["n"])), np.ones(len(rings["n"])))
        self.read = {"rings": len(best), "rings_read": 0, "rows": int(rings["n"].sum()), "rows_read": 0}
        if not any(query) or not len(best):
            return self.vectors().where(F.lit(False)).select("id", F.lit(0.0).alias("vector_score"))

        def scored(which: np.ndarray) -> DataFrame:
            self.read["rings_read"], self.read["rows_read"] = int(which.sum()), int(rings["n"][which].sum())
            score = cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in query]))
            rows = self._picked(rings, which)
            rows = rows if without is None else rows.join(without, "id", "left_anti")
            found = rows.select("id", score.alias("vector_score")).where(~F.isnan("vector_score") & (F.abs("vector_score") < math.inf))
            found = found if min_score is None else found.where(F.col("vector_score") >= min_score)
            return found.orderBy(F.desc("vector_score"), "id").limit(k)

        floor = -2.0 if min_score is None else min_score
        if probes is not None:
            near = np.argsort(-(centroids @ q))[:probes] if usable else np.arange(len(centroids))
            return scored((np.isin(rings["cluster"], near) | (rings["cluster"] == REST)) & (best >= floor))
        # rings of the nearest clusters with enough rows, then all that their k-th score doesn't rule out
        order = np.lexsort((-best, angle))
        first = rings["cluster"] == REST
        first[order[: int(np.searchsorted(np.cumsum(np.where(first, 0, rings["n"])[order]), 4 * k)) + 1]] = True
        seen = [r["vector_score"] for r in scored(first & (best >= floor)).collect()]
        if len(seen) == k:
            floor = max(floor, seen[-1])
        return scored(best >= floor)

    def topk_many(self, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
        """query_id, id, vector_score and rank of the best k rows of each of many queries.

        Each query first meets its nearest cluster, then those clusters that its
        k-th score there does not rule out. Queries and clusters meet by
        shuffles, in groups of bounded size. Queries that are null, empty or zero have
        no rows; those of another length than the index meet all clusters.
        """
        centroids, rings = self._headers()
        kind = queries.schema[id_col].dataType.simpleString()
        own = self.vectors().schema["id"].dataType.simpleString()
        clusters = np.unique(rings["cluster"])
        rows_of = {int(c): int(rings["n"][rings["cluster"] == c].sum()) for c in clusters}
        pieces = {c: -(-n // SLICE_ROWS) for c, n in rows_of.items()}
        starts = np.searchsorted(rings["cluster"], clusters)
        shared = self.spark.sparkContext.broadcast((centroids, rings, clusters, pieces, starts))  # as `_headers`
        asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector).cast("array<double>").alias("q"), F.lit(-2.0).alias("floor"))

        def met(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                c, r, names, parts, starts = shared.value
                for batch in batches:
                    out: list[list] = [[], [], [], [], []]
                    for i, (v, floor) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                        x = np.array([np.nan if y is None else y for y in v], float)
                        if not len(x) or not np.isfinite(x).all() or not x.any():
                            continue
                        best, near = np.ones(len(names)), len(names) - 1
                        if len(c) and len(x) == c.shape[1] and 1e-100 < np.linalg.norm(x) < 1e100:
                            angle, ring = _bounds(c, r, x / np.linalg.norm(x))
                            best = np.maximum.reduceat(ring, starts)
                            # rings lie in the order of their clusters
                            near = int(np.argmin(np.where(names == REST, 9, angle[starts])))
                        for at, name in enumerate(names.tolist()):
                            if (at == near) if first else (at != near and best[at] >= floor):
                                for piece in range(parts[name]):
                                    for column, value in zip(out, (i, name, piece, v, floor), strict=True):
                                        column.append(value)
                    ids = batch.column(0).take(pa.array(out[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.float64())), pa.array(out[4], pa.float64())], names=["query_id", "cluster", "piece", "q", "floor"])

            return run

        def round_(asked: DataFrame, first: bool) -> DataFrame:
            pairs = asked.mapInArrow(met(first), f"query_id {kind}, cluster int, piece int, q array<double>, floor double")
            # enough groups that none has over about CHUNK_QUERIES queries
            loads = {r["cluster"]: r["n"] for r in pairs.where("piece = 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
            chunks = self.spark.createDataFrame([(c, -(-n // CHUNK_QUERIES), pieces[c]) for c, n in loads.items()], "cluster int, chunks int, pieces int")
            left = self.vectors().join(F.broadcast(chunks), "cluster").select("cluster", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "embedding")
            right = pairs.join(F.broadcast(chunks.drop("pieces")), "cluster").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
            keys = ["cluster", "piece", "chunk"]
            return left.groupBy(*keys).cogroup(right.select(*keys, "query_id", "q", "floor").groupBy(*keys)).applyInArrow(_matched(k), f"query_id {kind}, id {own}, vector_score double")

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vector_score"), "id"))
        best = lambda hits: hits.withColumn("rank", rank).where(F.col("rank") <= k)
        near = best(round_(asked, True))
        floors = near.where(F.col("rank") == k).select("query_id", F.col("vector_score").alias("_floor"))
        rest = asked.join(floors, "query_id", "left").select("query_id", "q", F.coalesce("_floor", "floor").alias("floor"))
        return best(near.drop("rank").unionByName(round_(rest, False)))


def _bounds(centroids: np.ndarray, rings: dict[str, np.ndarray], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a direction, the angle to the centroid of each ring, and the largest cosine that a row of the ring can have."""
    t = np.arccos(np.clip(centroids @ unit, -1, 1))[np.maximum(rings["cluster"], 0)]
    apart = np.maximum(0, np.maximum(rings["least"] - t, t - rings["most"]) - _SLACK)
    return t, np.where(rings["cluster"] == REST, 1.0, np.cos(apart)) + _SLACK


def _matched(k: int):
    """The best k rows of a group for each of its queries, and all that tie with the k-th."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [queries.column("query_id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.float64())]
        if rows.num_rows and queries.num_rows:
            x, sizes = _padded(rows.column("embedding"))
            q, q_sizes = _padded(queries.column("q"))
            width = min(x.shape[1], q.shape[1])
            dot = q[:, :width] @ x[:, :width].T
            # norms over the length that both have
            x_norms, q_norms = (np.sqrt(np.cumsum(np.pad(m, ((0, 0), (1, 0))) ** 2, axis=1)) for m in (x, q))
            both = np.minimum(q_sizes[:, None], sizes[None])
            norm = q_norms[np.arange(len(q))[:, None], both] * x_norms[np.arange(len(x))[None], both]
            with np.errstate(invalid="ignore", over="ignore"):
                score = np.divide(dot, norm, out=np.zeros_like(dot), where=~(norm <= 0))
            score[~np.isfinite(score)] = -np.inf
            keep = min(k, score.shape[1])
            edge = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
            floor = queries.column("floor").to_numpy()
            row, col = np.nonzero((score >= np.maximum(edge, floor - _SLACK)[:, None]) & (score > -np.inf))
            out = [queries.column("query_id").take(pa.array(row)), rows.column("id").take(pa.array(col)), pa.array(score[row, col])]
        return pa.table(out, names=["query_id", "id", "vector_score"])

    return run


def _padded(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length, with zeros where a vector ends, and the lengths."""
    column = vectors.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, size
