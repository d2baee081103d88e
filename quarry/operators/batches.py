"""Embeddings of a table by a service's asynchronous batches, in steps that a restarted driver goes on with.

Requests are numbered and written once; tasks upload a group each and later
fetch and write the answers, so rows don't pass through the driver. The driver
starts a job for each uploaded file, which is what is paid for, and notes it in a file of
its own before it starts the next. What is written below the run's folder is
not done again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.embed import batch_problems, batch_results, with_retries
from quarry.operators.index import segment_groups
from quarry.operators.remote import BATCH_SIZE, GeminiService, OpenAiService, ServiceError
from quarry.sources import places

#: States in which a job is over, well or not.
DONE = frozenset("completed succeeded done job_state_succeeded batch_state_succeeded".split())
LOST = frozenset("failed expired cancelled canceled job_state_failed batch_state_failed batch_state_cancelled batch_state_expired".split())


class BatchLost(RuntimeError):
    """A job that ended without an answer, or answers that say no."""


class Jobs(Protocol):
    """What a service's batches are made of. Sent to tasks, so it has to be picklable."""

    def line(self, key: str, text: str) -> str: ...

    def upload(self, name: str, content: str) -> str: ...

    def start(self, file: str, name: str) -> str: ...

    def started(self) -> dict[str, str]: ...

    def state(self, job: str) -> tuple[str, str | None]: ...

    def fetch(self, file: str) -> str: ...


def _sent(service: OpenAiService | GeminiService, method: str, url: str, headers: dict[str, str], body: bytes | None = None) -> bytes:
    status, raw = service.transport(method, url, {**service.headers, **headers}, body)
    if status >= 400:
        raise ServiceError(status, raw.decode("utf-8", "replace")[:500])
    return raw


def _multipart(kind: str, mark: str, parts: list[tuple[str, str]]) -> tuple[dict[str, str], bytes]:
    body = "".join(f"--{mark}\r\n{head}\r\n\r\n{content}\r\n" for head, content in parts) + f"--{mark}--\r\n"
    return {"Content-Type": f"multipart/{kind}; boundary={mark}"}, body.encode()


@dataclass(frozen=True)
class OpenAiJobs:
    service: OpenAiService

    def line(self, key: str, text: str) -> str:
        return json.dumps({"custom_id": key, "method": "POST", "url": "/v1/embeddings", "body": {"model": self.service.model, "input": text}})

    def upload(self, name: str, content: str) -> str:
        head = 'Content-Disposition: form-data; name="purpose"', f'Content-Disposition: form-data; name="file"; filename="{name}.jsonl"\r\nContent-Type: application/jsonl'
        headers, body = _multipart("form-data", name, [(head[0], "batch"), (head[1], content)])
        return json.loads(_sent(self.service, "POST", f"{self.service.url}/files", headers, body))["id"]

    def start(self, file: str, name: str) -> str:
        return self.service.call("POST", "batches", {"input_file_id": file, "endpoint": "/v1/embeddings", "completion_window": "24h", "metadata": {"name": name}})["id"]

    def started(self) -> dict[str, str]:
        """Job by file of the service's last jobs."""
        return {j["input_file_id"]: j["id"] for j in self.service.call("GET", "batches?limit=100").get("data") or []}

    def state(self, job: str) -> tuple[str, str | None]:
        found = self.service.call("GET", f"batches/{job}")
        return found.get("status") or "unknown", found.get("output_file_id")

    def fetch(self, file: str) -> str:
        return _sent(self.service, "GET", f"{self.service.url}/files/{file}/content", {}).decode()


@dataclass(frozen=True)
class GeminiJobs:
    service: GeminiService

    def line(self, key: str, text: str) -> str:
        return json.dumps({"key": key, "request": {"content": {"parts": [{"text": text}]}, "task_type": "RETRIEVAL_DOCUMENT"}})

    def upload(self, name: str, content: str) -> str:
        host, _, version = self.service.url.rpartition("/")
        about = json.dumps({"file": {"displayName": name, "mimeType": "application/jsonl"}})
        headers, body = _multipart("related", name, [("Content-Type: application/json; charset=UTF-8", about), ("Content-Type: application/jsonl; charset=UTF-8", content)])
        found = json.loads(_sent(self.service, "POST", f"{host}/upload/{version}/files?uploadType=multipart", headers, body))
        return (found.get("file") or found)["name"]

    def start(self, file: str, name: str) -> str:
        return self.service.call("POST", f"{self.service.path}:asyncBatchEmbedContent", {"batch": {"displayName": name, "inputConfig": {"file_name": file}}})["name"]

    def started(self) -> dict[str, str]:
        jobs = self.service.call("GET", "batches").get("operations") or []
        config = lambda j: (j.get("metadata") or j).get("inputConfig") or {}
        return {config(j).get("file_name") or config(j).get("fileName") or "": j["name"] for j in jobs}

    def state(self, job: str) -> tuple[str, str | None]:
        found = self.service.call("GET", job if job.startswith("batches/") else f"batches/{job}")
        about = found.get("metadata") or {}
        output = found.get("outputConfig") or {}
        return found.get("state") or about.get("state") or "unknown", output.get("file") or output.get("fileId") or (about.get("output") or {}).get("responsesFile")

    def fetch(self, file: str) -> str:
        return _sent(self.service, "GET", f"{self.service.url}/{file if file.startswith('files/') else f'files/{file}'}:download", {"Content-Type": "application/json"}).decode()


class BatchRun:
    """One run below a folder that driver and tasks share; the same folder goes on with the same run."""

    def __init__(self, spark: SparkSession, home: str, jobs: Jobs, size: int = BATCH_SIZE):
        self.spark, self.home, self.jobs, self.size = spark, home.rstrip("/"), jobs, size

    def _table(self, name: str, schema: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step's table: as it is if it was written to its end, else written now."""
        path = f"{self.home}/{name}"
        if not places.exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def run(self, requests: DataFrame, poll: float = 2.0, timeout: float = 24 * 3600.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
        """hash and embedding of every request (hash, text). A request without a vector fails the run; null texts are empty."""
        asked = self._table("requests", "hash string, text string, batch long", lambda: segment_groups(requests.select("hash", F.coalesce("text", F.lit("")).alias("text")), ["hash"], self.size).select("hash", "text", "batch"))
        files = self._table("uploads", "batch long, file string", lambda: self._uploaded(asked))

        def answers() -> DataFrame:
            # one row for each batch, not for each request
            jobs = self._started({r["batch"]: r["file"] for r in files.collect()})
            return self._fetched(self._awaited(jobs, poll, timeout, sleep, clock))

        lines = self._table("answers", "batch long, line string", answers)
        found = batch_results(lines)
        problems = batch_problems(found, asked.select(F.col("hash").alias("id"))).limit(5).collect()
        if problems:
            raise BatchLost(f"rows without a vector: {[tuple(r) for r in problems]}")
        return found.select(F.col("id").alias("hash"), "embedding")

    def _uploaded(self, asked: DataFrame) -> DataFrame:
        jobs, size = self.jobs, self.size

        def upload(group: pa.Table) -> pa.Table:
            batch = group.column("batch")[0].as_py()
            rows = zip(group.column("hash").to_pylist(), group.column("text").to_pylist(), strict=True)
            content = "\n".join(jobs.line(key, text) for key, text in rows)
            file = with_retries(lambda: jobs.upload(f"quarry-{batch}-{size}", content), jitter=0.2)
            return pa.table({"batch": pa.array([batch], pa.int64()), "file": pa.array([file], pa.string())})

        # a group has `size` rows at most, as the service takes them
        return asked.groupBy("batch").applyInArrow(upload, "batch long, file string")

    def _started(self, files: dict[int, str]) -> dict[int, str]:
        """The job of each batch. A driver that died after a start and before it was noted left a job that the service knows."""
        out, known = {}, None
        for batch, file in sorted(files.items()):
            note = f"{self.home}/jobs/batch-{batch}.json"
            text = places.read_text(self.spark, note)
            if text is None:
                known = self.jobs.started() if known is None else known
                job = known.get(file) or with_retries(lambda file=file, batch=batch: self.jobs.start(file, f"quarry-{batch}"), 3, 0.3, 2.0, jitter=0.2)
                text = json.dumps({"job": job, "file": file})
                places.create_text(self.spark, note, text)
            out[batch] = json.loads(text)["job"]
        return out

    def _awaited(self, jobs: dict[int, str], poll: float, timeout: float, sleep: Callable[[float], None], clock: Callable[[], float]) -> dict[int, str]:
        out: dict[int, str] = {}
        began = clock()
        while True:
            for batch in [b for b in jobs if b not in out]:
                state, file = with_retries(lambda b=batch: self.jobs.state(jobs[b]), jitter=0.2, sleep=sleep)
                if state.lower() in LOST or (state.lower() in DONE and not file):
                    raise BatchLost(f"batch {jobs[batch]} is {state}" + ("" if file else " without an output"))
                if state.lower() in DONE:
                    out[batch] = file
            if len(out) == len(jobs):
                return out
            if clock() - began > timeout:
                raise TimeoutError(f"{len(jobs) - len(out)} batches took over {timeout} s")
            sleep(poll)

    def _fetched(self, outputs: dict[int, str]) -> DataFrame:
        jobs = self.jobs

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lines = with_retries(lambda file=file: jobs.fetch(file), jitter=0.2).split("\n")
                    for at in range(0, len(lines), 1000):
                        some = lines[at : at + 1000]
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array(some, pa.string())], names=["batch", "line"])

        rows: list[tuple[Any, ...]] = sorted(outputs.items())
        return self.spark.createDataFrame(rows, "batch long, file string").repartition(max(1, len(rows))).mapInArrow(fetch, "batch long, line string")
