"""Vector, keyword and hybrid search over chunk tables.

Search reads tables of chunks: id, path, start_line, end_line, source, model,
text, embedding. Scores are computed on the columns they need; snippets are
taken of the few rows that are left. Ties are broken by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import let
from quarry.functions.text import phrase_count, query_phrases, tokens
from quarry.functions.vector import cosine

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows of one matrix product with a block of queries.
SLICE = 1024


def candidate_count(max_results: int, multiplier: float = 2.0, most: int = 200) -> int:
    """How many rows each side of a hybrid search hands on."""
    return min(most, max(1, math.floor(max_results * multiplier)))


def oversampled(max_results: int) -> int:
    """How many rows each directory hands on."""
    return math.ceil(max_results * 1.5)


def filtered(chunks: DataFrame, model: str | None = None, sources: list[str] | None = None) -> DataFrame:
    if model is not None:
        chunks = chunks.where(F.col("model") == model)
    return chunks.where(F.col("source").isin(sources)) if sources else chunks


def vector_topk(chunks: DataFrame, query: list[float], limit: int, id_col: str = "id", embedding: str = "embedding", min_score: float | None = None) -> DataFrame:
    """`chunks` with vector_score, the best `limit` rows. A zero query finds nothing; scores that are no numbers drop out."""
    if not any(query):
        return chunks.withColumn("vector_score", F.lit(None).cast("double")).where(F.lit(False))
    q = F.array(*[F.lit(float(v)) for v in query])
    out = chunks.withColumn("vector_score", cosine(F.col(embedding), q))
    out = out.where(~F.isnan("vector_score") & (F.abs("vector_score") < math.inf))
    if min_score is not None:
        out = out.where(F.col("vector_score") >= min_score)
    return out.orderBy(F.desc("vector_score"), id_col).limit(limit)


def _best_of(held: pa.Table | None, waiting: list[pa.Table], limit: int) -> pa.Table:
    """The best `limit` rows (query, score, id) of each query; ties by id."""
    every = pa.concat_tables([*([held] if held is not None else []), *waiting]).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    query = every.column("query").to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return every.filter(pa.array(place < limit))


def vector_topk_many(chunks: DataFrame, queries: list[tuple[int, list[float]]], limit: int, id_col: str = "id", embedding: str = "embedding", block: int = 512) -> DataFrame:
    """query_id, id, vector_score, rank: the best `limit` rows for each of many queries.

    Queries go to the tasks in blocks of a stated size; SLICE rows at a time are one
    matrix product. A task keeps the best rows of each query over all of its
    batches, so its memory has a bound that no table size changes.
    """
    found = None
    for at in range(0, len(queries), block):
        part = queries[at : at + block]
        ids = np.array([i for i, _ in part])
        width = max(len(v) for _, v in part)
        q = np.zeros((len(part), width))
        for row, (_, v) in enumerate(part):
            q[row, : len(v)] = v
        q_size = np.array([len(v) for _, v in part])

        def run(batches: Iterator[pa.RecordBatch], q=q, ids=ids, q_size=q_size, width=width) -> Iterator[pa.RecordBatch]:
            q_norms = np.sqrt(np.cumsum(np.pad(q, ((0, 0), (1, 0))) ** 2, axis=1))
            held, waiting, edge = None, [], np.full(len(q), -np.inf)
            for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
                key, vectors = batch.column(0), batch.column(1)
                sizes = np.minimum(np.nan_to_num(np.array(vectors.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int), width)
                x = np.zeros((batch.num_rows, width))
                offsets, values = vectors.offsets.to_numpy(), np.asarray(vectors.values.to_numpy(zero_copy_only=False), float)
                if (sizes == sizes[0]).all() and (np.diff(offsets) == sizes[0]).all():
                    x[:, : sizes[0]] = values[offsets[0] : offsets[-1]].reshape(-1, sizes[0]) if sizes[0] else 0
                else:
                    for r, n in enumerate(sizes):
                        x[r, :n] = values[offsets[r] : offsets[r] + n]
                # norms over the length that both have
                x_norm = np.stack([np.sqrt((x[:, :n] ** 2).sum(axis=1)) for n in np.unique(q_size)], axis=0)[np.unique(q_size, return_inverse=True)[1]]
                norm = q_norms[:, sizes] * x_norm
                score = np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm > 0)
                row, col = np.nonzero(score >= edge[:, None])  # ties at the edge stay
                waiting.append(pa.table({"query": pa.array(row), "score": pa.array(score[row, col]), "id": key.take(pa.array(col))}))
                if sum(t.num_rows for t in waiting) > 4 * limit * len(q):
                    held, waiting = _best_of(held, waiting, limit), []
                    at = held.column("query").to_numpy()
                    n = np.bincount(at, minlength=len(q))
                    least = np.full(len(q), np.inf)
                    np.minimum.at(least, at, held.column("score").to_numpy())
                    edge = np.where(n >= limit, least, -np.inf)
            held = _best_of(held, waiting, limit) if waiting else held
            if held is not None:
                found_ids = pa.array(ids[held.column("query").to_numpy()])
                table = pa.table({"query_id": found_ids, "id": held.column("id"), "vector_score": held.column("score")})
                yield from table.combine_chunks().to_batches(10_000)

        kind = chunks.schema[id_col].dataType.simpleString()
        hits = chunks.where(F.col(embedding).isNotNull()).select(id_col, F.col(embedding).cast("array<double>")).mapInArrow(run, f"query_id long, id {kind}, vector_score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        raise ValueError("no queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vector_score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


@dataclass(frozen=True)
class CorpusStats:
    """What BM25 needs of the whole table."""

    rows: int
    mean_length: float
    rows_with: tuple[int, ...]

    def idf(self, phrase: int) -> float:
        n = self.rows_with[phrase]
        value = math.log((self.rows - n + 0.5) / (n + 0.5))
        return value if value > 0 else LEAST_IDF


def with_tokens(table: DataFrame, text: str = "text") -> DataFrame:
    """`table` with its tokens; write this once where many queries follow."""
    return table.withColumn("tokens", tokens(F.coalesce(F.col(text), F.lit(""))))


def _measured(phrases: list[list[str]]) -> Column:
    """struct<d, f0, f1, ...>: a row's length and how often each phrase occurs; its tokens are made once."""
    return let(F.col("tokens"), lambda w: F.struct(F.size(w).alias("d"), *[phrase_count(w, p).alias(f"f{i}") for i, p in enumerate(phrases)]))


def corpus_stats(tokenised: DataFrame, phrases: list[list[str]]) -> CorpusStats:
    """One row of sums, taken in one pass."""
    rows = tokenised.select(F.inline(F.array(_measured(phrases))))
    row = rows.agg(F.count(F.lit(1)), F.avg("d"), *[F.sum((F.col(f"f{i}") > 0).cast("long")) for i in range(len(phrases))]).first()
    return CorpusStats(row[0], float(row[1] or 0.0), tuple(int(v or 0) for v in row[2:]))


def bm25(tokenised: DataFrame, query: str) -> DataFrame:
    """`tokenised` with rank (the lower the better) where every phrase of the query occurs; nothing for a query without tokens."""
    phrases = query_phrases(query)
    if not phrases or not all(phrases):
        return tokenised.withColumn("rank", F.lit(None).cast("double")).where(F.lit(False))
    stats = corpus_stats(tokenised, phrases)

    def ranked(m: Column) -> Column:
        lacks, total = F.lit(False), F.lit(0.0)
        for i in range(len(phrases)):
            f = m[f"f{i}"].cast("double")
            lacks = lacks | (f == 0)
            total = total + F.lit(stats.idf(i)) * f * (K1 + 1) / (f + K1 * (1 - B + B * m["d"] / F.lit(stats.mean_length)))
        return F.when(~lacks, -total)

    # a generator of no or one row: the rank is worked out once and not again for a filter
    rank = F.array_compact(F.array(let(_measured(phrases), ranked)))
    return tokenised.select("*", F.explode(rank).alias("rank"))


def rank_to_score(rank: Column, mode: str = "faithful") -> Column:
    """1 / (1 + |rank|); 0 if the rank is not finite. Mode `monotone` is |rank| / (1 + |rank|): better ranks score higher."""
    finite = rank.isNotNull() & ~F.isnan(rank) & (F.abs(rank) < math.inf)
    score = F.lit(1.0) / (1 + F.abs(rank)) if mode == "faithful" else F.abs(rank) / (1 + F.abs(rank))
    return F.when(finite, score).otherwise(F.lit(0.0))


def keyword_topk(tokenised: DataFrame, query: str, limit: int, id_col: str = "id", mode: str = "faithful") -> DataFrame:
    """The best `limit` rows by rank, with text_score."""
    return bm25(tokenised, query).orderBy("rank", id_col).limit(limit).withColumn("text_score", rank_to_score(F.col("rank"), mode))


def merge_hybrid(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.7, text_weight: float = 0.3, id_col: str = "id") -> DataFrame:
    """Both result lists as one, by id: weighted scores, a missing side as 0, the keyword snippet first.

    If one list is empty the other has all the weight; whether a list is empty
    is a one-row aggregate over at most a few hundred candidates.
    """
    names = ["path", "start_line", "end_line", "source"]
    v = vector.select(F.col(id_col).alias("v_id"), *[F.col(c).alias(f"v_{c}") for c in names], F.col("snippet").alias("v_snippet"), "vector_score")
    k = keyword.select(F.col(id_col).alias("k_id"), *[F.col(c).alias(f"k_{c}") for c in names], F.col("snippet").alias("k_snippet"), "text_score")
    both = v.join(k, F.col("v_id") == F.col("k_id"), "full_outer")
    every = Window.partitionBy(F.lit(1))
    some_v, some_k = F.count("v_id").over(every) > 0, F.count("k_id").over(every) > 0
    vw = F.when(~some_k, 1.0).when(~some_v, 0.0).otherwise(vector_weight)
    tw = F.when(~some_v, 1.0).when(~some_k, 0.0).otherwise(text_weight)
    score = vw * F.coalesce("vector_score", F.lit(0.0)) + tw * F.coalesce("text_score", F.lit(0.0))
    return both.select(
        F.coalesce("v_id", "k_id").alias(id_col), *[F.coalesce(f"v_{c}", f"k_{c}").alias(c) for c in names], score.alias("score"),
        F.when(F.length("k_snippet") > 0, F.col("k_snippet")).otherwise(F.coalesce("v_snippet", "k_snippet")).alias("snippet"), "vector_score", "text_score",
    )


def best(merged: DataFrame, max_results: int, min_score: float = 0.3, id_col: str = "id") -> DataFrame:
    """Rows at or above the least score, best first; ties: vector side first, then keyword side, then id."""
    kept = merged.where(F.col("score") >= min_score)
    return kept.orderBy(F.desc("score"), F.desc_nulls_last("vector_score"), F.desc_nulls_last("text_score"), id_col).limit(max_results)


def best_across(results: DataFrame, directory: str, max_results: int, id_col: str = "id") -> DataFrame:
    """The best rows of many directories, each of which hands on at most `oversampled` ones."""
    within = F.row_number().over(Window.partitionBy(directory).orderBy(F.desc("score"), id_col))
    return results.withColumn("_n", within).where(F.col("_n") <= oversampled(max_results)).drop("_n").orderBy(F.desc("score"), directory, id_col).limit(max_results)


def in_directories(directory: Column, asked: list[str]) -> Column:
    """Whether a directory is, or its path holds, one of the names asked for, whatever their case."""
    hit = F.lit(False)
    for name in asked:
        hit = hit | F.lower(directory).contains(name.lower())
    return hit


def shown(number: Column, path: Column, start: Column, end: Column, score: Column, text: Column, directory: Column | None = None) -> Column:
    """A result as text: number, place and share, then the snippet."""
    place = F.concat(F.lit("["), number.cast("string"), F.lit("] "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    if directory is not None:
        place = F.concat(place, F.lit(" ["), directory, F.lit("]"))
    return F.concat(place, F.lit(" ("), F.format_string("%.1f", score * 100), F.lit("% match)\n"), text)
