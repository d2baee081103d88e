"""Embedding texts: providers, deterministic vectors, batch results."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import let
from quarry.functions.vector import l2_normalised

#: The words whose counts are the first dimensions of deterministic vectors.
KEYWORDS = (
    "project", "meeting", "todo", "bug", "feature", "api", "database", "user",
    "test", "deploy", "config", "error", "fix", "update", "review", "design",
    "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta",
    "important", "urgent", "note", "remember", "decision", "action", "plan", "goal",
)
DIMS = 128


class Provider(Protocol):
    """What makes vectors. Sent to tasks, so it has to be picklable."""

    id: str
    model: str

    def embed_query(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class NoProvider:
    """Keyword search only: every vector is empty."""

    id: str = "none"
    model: str = "bm25-only"

    def embed_query(self, text: str) -> list[float]:
        return []

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[] for _ in texts]


@dataclass(frozen=True)
class DeterministicProvider:
    """Vectors by rule, for offline use: keyword counts, then code points of the text taken in turn."""

    id: str = "deterministic"
    model: str = "keywords-128"
    dims: int = DIMS

    def embed_query(self, text: str) -> list[float]:
        low = text.lower()
        v = [0.5 * low.count(k) for k in KEYWORDS[: self.dims]]
        v += [ord(low[i % len(low)]) / 1000 if low else 0.0 for i in range(len(KEYWORDS), self.dims)]
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        return [x / norm for x in v]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


class MissingKey(RuntimeError):
    """A provider that needs a key which isn't there."""


def choose_provider(wanted: str, makers: dict[str, Callable[[], Provider]], fallback: str | None = None) -> tuple[Provider, str | None]:
    """The provider and what it stands in for. `none` is keyword search only; `auto` takes the first of `makers` that has its key."""
    if wanted == "none":
        return NoProvider(), None
    if wanted == "auto":
        for maker in makers.values():
            try:
                return maker(), None
            except MissingKey:
                continue
        return NoProvider(), "auto"
    try:
        return makers[wanted](), None
    except Exception:
        if fallback in (None, "none", wanted):
            if fallback == "none":
                return NoProvider(), wanted
            raise
        return makers[fallback](), wanted


#: Seconds that a query's vector may take: from a service, and from anything in this process.
QUERY_SECONDS = {"remote": 60.0, "local": 300.0}


def query_vector(provider: Provider, text: str, seconds: float | None = None) -> list[float]:
    """The query's vector; TimeoutError if the provider takes longer than its kind may."""
    if seconds is None:
        seconds = QUERY_SECONDS["local" if provider.id in ("none", "deterministic") else "remote"]
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(provider.embed_query, text).result(seconds)
    except FutureTimeout as e:
        raise TimeoutError(f"{provider.id} took over {seconds} s for a query") from e
    finally:
        pool.shutdown(wait=False)


def worth_retrying(error: Exception) -> bool:
    """Whether another attempt may help: not after an answer that says the request itself is wrong."""
    status = getattr(error, "status", None)
    return status is None or status == 429 or status >= 500


def with_retries(call: Callable[[], list], attempts: int = 3, first: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep, jitter: float = 0.0):
    """The call's result; waits that double between attempts, each longer by up to the share `jitter`, so that tasks don't come back all at once."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as e:
            if attempt == attempts - 1 or not worth_retrying(e):
                raise
            sleep(min(most, first * 2**attempt * (1 + jitter * random.random())))
    raise AssertionError


def embed_missing(missing: DataFrame, provider: Provider, batch: int = 256, attempts: int = 3) -> DataFrame:
    """hash and embedding of rows (hash, text): one provider call per `batch` rows of a task, nulls as empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                vectors = with_retries(lambda: provider.embed_batch(texts), attempts, jitter=0.2)  # noqa: B023
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["hash", "embedding"])

    return missing.select("hash", "text").mapInArrow(run, "hash string, embedding array<double>")


def keyword_vector(text: Column, dims: int = DIMS) -> Column:
    """The deterministic vector as a column expression."""

    def of(low: Column) -> Column:
        counts = [((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k) * 0.5) for k in KEYWORDS[:dims]]
        chars = F.transform(F.sequence(F.lit(len(KEYWORDS)), F.lit(dims - 1)), lambda i: F.when(F.length(low) > 0, F.ascii(F.substring(low, i % F.length(low) + 1, F.lit(1))) / 1000.0).otherwise(F.lit(0.0)))
        return l2_normalised(F.concat(F.array(*counts), chars) if dims > len(KEYWORDS) else F.array(*counts))

    return let(F.lower(text), of)


RESULT_SCHEMA = "key string, custom_id string, request_id string, error struct<message:string>, response struct<status_code:int,body:struct<data:array<struct<embedding:array<double>>>>,embedding:struct<values:array<double>>>"


def batch_results(lines: DataFrame, line: str = "line") -> DataFrame:
    """id, embedding and problem of each JSON line that a batch interface returned; blank lines are left out."""
    rows = lines.where(F.trim(F.col(line)) != "").select(F.from_json(line, RESULT_SCHEMA).alias("r"))
    vector = F.coalesce(F.get(F.col("r.response.body.data"), F.lit(0))["embedding"], F.col("r.response.embedding.values"))
    name = F.coalesce("r.key", "r.custom_id", "r.request_id")
    problem = (
        F.when(name.isNull(), "no id")
        .when(F.col("r.error.message").isNotNull(), F.col("r.error.message"))
        .when(F.col("r.response.status_code") >= 400, F.concat(F.lit("status "), F.col("r.response.status_code").cast("string")))
        .when(vector.isNull() | (F.size(vector) == 0), "empty embedding")
    )
    return rows.select(name.alias("id"), vector.alias("embedding"), problem.alias("problem"))


def batch_problems(results: DataFrame, asked: DataFrame, id_col: str = "id") -> DataFrame:
    """id and problem of every request that failed or that no result line answers; a batch without rows here is good."""
    failed = results.where(F.col("problem").isNotNull()).select(id_col, "problem")
    missing = asked.select(id_col).join(results.select(id_col), id_col, "left_anti").select(id_col, F.lit("missing").alias("problem"))
    return failed.unionByName(missing)
