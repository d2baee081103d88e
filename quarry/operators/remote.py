"""Embedding services over HTTP, and their asynchronous batches.

A service is a small picklable description; the transport is a function that
tests replace. Tasks call `embed_batch` for the rows they hold.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from quarry.operators.embed import DeterministicProvider, MissingKey, Provider, choose_provider, with_retries

#: The services' default addresses and models.
OPENAI_URL, OPENAI_MODEL = "https://api.openai.com/v1", "text-embedding-3-small"
GEMINI_URL, GEMINI_MODEL = "https://generativelanguage.googleapis.com/v1beta", "gemini-embedding-001"
BATCH_SIZE = 50_000

Transport = Callable[[str, str, dict[str, str], bytes | None], tuple[int, bytes]]


class ServiceError(RuntimeError):
    def __init__(self, status: int, text: str):
        super().__init__(f"status {status}: {text}")
        self.status = status


def http(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=300) as response:
            return response.status, response.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def _key(given: str | None, *names: str) -> str:
    for value in (given, *(os.environ.get(n) for n in names)):
        if value and value.strip():
            return value.strip()
    raise MissingKey(f"no key: set one of {', '.join(names)}")


def openai_model(name: str) -> str:
    return name.strip().removeprefix("openai/") or OPENAI_MODEL


def gemini_model(name: str) -> str:
    short = name.strip().removeprefix("models/")
    for prefix in ("gemini/", "google/"):
        if short.startswith(prefix):
            return short[len(prefix) :]
    return short or GEMINI_MODEL


def gemini_url(url: str) -> str:
    """Without trailing slashes, and without the path of a compatible interface."""
    return re.sub(r"/openai.*", "", url.rstrip("/"))


@dataclass(frozen=True)
class Service:
    """What both services share."""

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    transport: Transport = http

    def call(self, method: str, path: str, payload: Any = None) -> Any:
        body = None if payload is None else json.dumps(payload).encode()
        status, raw = self.transport(method, f"{self.url}/{path}", {"Content-Type": "application/json", **self.headers}, body)
        if status >= 400:
            raise ServiceError(status, raw.decode("utf-8", "replace")[:500])
        return json.loads(raw)


@dataclass(frozen=True)
class OpenAiService(Service):
    id: str = "openai"

    @classmethod
    def create(cls, model: str = "", key: str | None = None, url: str = OPENAI_URL, headers: dict[str, str] | None = None, transport: Transport = http) -> OpenAiService:
        return cls(url.rstrip("/"), openai_model(model), {"Authorization": f"Bearer {_key(key, 'OPENAI_API_KEY')}", **(headers or {})}, transport)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        """One request; vectors by position."""
        if not texts:
            return []
        found = self.call("POST", "embeddings", {"model": self.model, "input": texts}).get("data") or []
        return [entry.get("embedding") or [] for entry in found]

    def embed_query(self, text: str) -> list[float]:
        return (self.embed_batch([text]) or [[]])[0]


@dataclass(frozen=True)
class GeminiService(Service):
    id: str = "gemini"

    @classmethod
    def create(cls, model: str = "", key: str | None = None, url: str = GEMINI_URL, headers: dict[str, str] | None = None, transport: Transport = http) -> GeminiService:
        return cls(gemini_url(url), gemini_model(model), {"x-goog-api-key": _key(key, "GOOGLE_API_KEY", "GEMINI_API_KEY"), **(headers or {})}, transport)

    @property
    def path(self) -> str:
        return f"models/{self.model}"

    def embed_query(self, text: str) -> list[float]:
        if not text.strip():
            return []
        found = self.call("POST", f"{self.path}:embedContent", {"content": {"parts": [{"text": text}]}, "taskType": "RETRIEVAL_QUERY"})
        return (found.get("embedding") or {}).get("values") or []

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        """One request; a text without an answer has an empty vector."""
        if not texts:
            return []
        asked = [{"model": self.path, "content": {"parts": [{"text": t}]}, "taskType": "RETRIEVAL_DOCUMENT"} for t in texts]
        found = self.call("POST", f"{self.path}:batchEmbedContents", {"requests": asked}).get("embeddings") or []
        return [(found[i].get("values") or []) if i < len(found) else [] for i in range(len(texts))]


def provider_of(config: dict[str, Any], transport: Transport = http) -> tuple[Provider, str | None]:
    """The provider that the `embedding` settings name, and what it stands in for.

    provider: auto, none, deterministic, openai or gemini; model, and for each
    service a section of its name with apiKey, baseUrl and headers; fallback: what
    is taken if the one named can't be made.
    """

    def maker(kind: type, url: str, section: str) -> Callable[[], Provider]:
        own = config.get(section) or {}
        return lambda: kind.create(config.get("model") or "", own.get("apiKey"), own.get("baseUrl") or url, own.get("headers"), transport)

    services = {"openai": maker(OpenAiService, OPENAI_URL, "openai"), "gemini": maker(GeminiService, GEMINI_URL, "gemini")}
    wanted = config.get("provider") or "auto"
    if wanted == "auto":
        return choose_provider("auto", services)
    return choose_provider(wanted, {**services, "deterministic": DeterministicProvider}, config.get("fallback"))


def batch_lines(service: OpenAiService, rows: list[tuple[str, str]]) -> list[str]:
    """A JSON line for each (id, text) of a batch request."""
    return [json.dumps({"custom_id": i, "method": "POST", "url": "/v1/embeddings", "body": {"model": service.model, "input": t}}) for i, t in rows]


def result_vectors(lines: list[str]) -> tuple[dict[str, list[float]], dict[str, str]]:
    """Vectors and problems by id, of result lines of either service."""
    good, bad = {}, {}
    for line in filter(str.strip, lines):
        row = json.loads(line)
        name = row.get("key") or row.get("custom_id") or row.get("request_id")
        response = row.get("response") or {}
        body = response.get("body") or {}
        data = body.get("data") or []
        vector = (data[0].get("embedding") if data else None) or ((response.get("embedding") or {}).get("values"))
        if row.get("error"):
            bad[name] = str(row["error"].get("message") or row["error"])
        elif (response.get("status_code") or 200) >= 400:
            bad[name] = f"status {response['status_code']}"
        elif not vector:
            bad[name] = "empty embedding"
        else:
            good[name] = vector
    return good, bad


def _upload(service: OpenAiService, lines: list[str]) -> str:
    mark = uuid.uuid4().hex
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n', f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="requests.jsonl"\r\nContent-Type: application/jsonl\r\n\r\n', "\n".join(lines), f"\r\n--{mark}--\r\n"]
    status, raw = service.transport("POST", f"{service.url}/files", {**service.headers, "Content-Type": f"multipart/form-data; boundary={mark}"}, "".join(parts).encode())
    if status >= 400:
        raise ServiceError(status, raw.decode("utf-8", "replace")[:500])
    return json.loads(raw)["id"]


def run_batch(service: OpenAiService, rows: list[tuple[str, str]], poll: float = 2.0, timeout: float = 3600.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict[str, list[float]]:
    """Upload, start, wait, fetch. A problem with any row, or a row without an answer, fails the batch."""
    file_id = _upload(service, batch_lines(service, rows))

    state = with_retries(lambda: service.call("POST", "batches", {"input_file_id": file_id, "endpoint": "/v1/embeddings", "completion_window": "24h"}), 3, 0.3, 2.0, sleep, 0.2)
    began = clock()
    while state.get("status") != "completed":
        if state.get("status") in ("failed", "expired", "cancelled", "canceled"):
            raise RuntimeError(f"batch {state['id']} {state['status']}")
        if clock() - began > timeout:
            raise TimeoutError(f"batch {state['id']} took over {timeout} s")
        sleep(poll)
        state = service.call("GET", f"batches/{state['id']}")
    status, raw = service.transport("GET", f"{service.url}/files/{state['output_file_id']}/content", service.headers, None)
    if status >= 400:
        raise ServiceError(status, raw.decode("utf-8", "replace")[:500])
    good, bad = result_vectors(raw.decode().split("\n"))
    bad |= {i: "missing" for i, _ in rows if i not in good and i not in bad}
    if bad:
        raise RuntimeError(f"{len(bad)} rows of the batch failed: {next(iter(bad.items()))}")
    return good


def run_batches(service: OpenAiService, rows: list[tuple[str, str]], size: int = BATCH_SIZE, at_once: int = 2, **options: Any) -> dict[str, list[float]]:
    """Batches of at most `size` rows, some at once; the first failure ends it."""
    out: dict[str, list[float]] = {}
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        for found in pool.map(lambda at: run_batch(service, rows[at : at + size], **options), range(0, len(rows), size)):
            out |= found
    return out


def embed_by_batch(service: OpenAiService, rows: list[tuple[str, str]], direct: int = 100, **options: Any) -> dict[str, list[float]]:
    """The batch interface, or requests of at most `direct` rows each if it fails."""
    try:
        return run_batches(service, rows, **options)
    except (ServiceError, RuntimeError, TimeoutError, OSError, ValueError):
        out: dict[str, list[float]] = {}
        for at in range(0, len(rows), direct):
            some = rows[at : at + direct]
            found = with_retries(lambda some=some: service.embed_batch([t for _, t in some]))
            out |= dict(zip((i for i, _ in some), found, strict=True))
        return out
