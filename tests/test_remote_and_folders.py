from __future__ import annotations

import datetime as dt
import json

import pytest

from quarry import folders
from quarry.operators import remote
from quarry.operators.embed import MissingKey


def service(answers, seen):
    def transport(method, url, headers, body):
        seen.append((method, url, headers, body))
        status, payload = answers.pop(0)
        return status, payload if isinstance(payload, bytes) else json.dumps(payload).encode()

    return transport


def test_openai_requests(monkeypatch):
    seen = []
    s = remote.OpenAiService.create("openai/m", " k ", "http://h/v1/", {"X": "y"}, service([(200, {"data": [{"embedding": [1, 2]}, {}]}), (500, b"down")], seen))
    assert s.embed_batch(["a", "b"]) == [[1, 2], []] and s.embed_batch([]) == []
    method, url, headers, body = seen[0]
    assert (method, url, headers["Authorization"], headers["X"]) == ("POST", "http://h/v1/embeddings", "Bearer k", "y") and json.loads(body) == {"model": "m", "input": ["a", "b"]}
    with pytest.raises(remote.ServiceError, match="500"):
        s.embed_query("x")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(MissingKey):
        remote.OpenAiService.create()
    monkeypatch.setenv("OPENAI_API_KEY", "env")
    assert remote.OpenAiService.create().headers["Authorization"] == "Bearer env"


def test_gemini_requests():
    seen = []
    s = remote.GeminiService.create("models/google/g", "k", "http://h/v1beta/openai/", None, service([(200, {"embedding": {"values": [1]}}), (200, {"embeddings": [{"values": [2]}]})], seen))
    assert s.embed_query("q") == [1] and s.embed_query("  ") == [] and s.embed_batch(["a", "b"]) == [[2], []]
    assert seen[0][1] == "http://h/v1beta/models/g:embedContent" and json.loads(seen[0][3])["taskType"] == "RETRIEVAL_QUERY"
    assert seen[1][1].endswith(":batchEmbedContents") and json.loads(seen[1][3])["requests"][0]["taskType"] == "RETRIEVAL_DOCUMENT"
    assert [remote.gemini_model(m) for m in ("", "gemini/x", "models/y", "z")] == [remote.GEMINI_MODEL, "x", "y", "z"]
    assert [remote.openai_model(m) for m in (" ", "a")] == [remote.OPENAI_MODEL, "a"]


def lines(*rows):
    return "\n".join(json.dumps(r) for r in rows).encode()


GOOD = {"custom_id": "1", "response": {"status_code": 200, "body": {"data": [{"embedding": [1.0]}]}}}


def test_batches():
    waits, seen = [], []
    answers = [(200, {"id": "f"}), (503, b"busy"), (200, {"id": "b", "status": "validating"}), (200, {"id": "b", "status": "completed", "output_file_id": "o"}), (200, lines(GOOD))]
    s = remote.OpenAiService.create("m", "k", "http://h", None, service(answers, seen))
    assert remote.run_batch(s, [("1", "text")], sleep=waits.append) == {"1": [1.0]}
    assert 0.3 <= waits[0] <= 0.36 and waits[1] == 2.0 and b"requests.jsonl" in seen[0][3] and seen[-1][1] == "http://h/files/o/content"
    for last in (lines({"custom_id": "1", "error": {"message": "bad"}}), lines({"key": "2", "response": {"embedding": {"values": [1]}}}), lines({"custom_id": "1", "response": {"status_code": 500}})):
        s = remote.OpenAiService.create("m", "k", "http://h", None, service([(200, {"id": "f"}), (200, {"id": "b", "status": "completed", "output_file_id": "o"}), (200, last)], []))
        with pytest.raises(RuntimeError):
            remote.run_batch(s, [("1", "text")], sleep=waits.append)
    s = remote.OpenAiService.create("m", "k", "http://h", None, service([(200, {"id": "f"}), (400, b"no")], []))
    with pytest.raises(remote.ServiceError):
        remote.run_batch(s, [("1", "text")], sleep=waits.append)
    s = remote.OpenAiService.create("m", "k", "http://h", None, service([(200, {"id": "f"}), (200, {"id": "b", "status": "expired"}), (200, {"data": [{"embedding": [7]}]})], []))
    assert remote.embed_by_batch(s, [("1", "text")]) == {"1": [7]}
    clock = iter(range(0, 10**6, 1000))
    s = remote.OpenAiService.create("m", "k", "http://h", None, service([(200, {"id": "f"})] + [(200, {"id": "b", "status": "running"})] * 9, []))
    with pytest.raises(TimeoutError):
        remote.run_batch(s, [("1", "text")], sleep=waits.append, clock=lambda: next(clock))


def test_folder_kinds(tmp_path):
    repo = tmp_path / "repo" / "sub"
    repo.mkdir(parents=True)
    assert folders.folder_kind(str(repo))["kind"] == "standalone"
    (tmp_path / "repo" / ".git").mkdir()
    assert folders.folder_kind(str(repo)) == {"kind": "project-bound", "git_root": str(tmp_path / "repo"), "has_sync": False}
    (repo / ".quarry").mkdir()
    (repo / ".quarry" / "config.json").write_text('{"sync": {"path": "p/"}}')
    assert folders.folder_kind(str(repo))["kind"] == "standalone"


def test_central(tmp_path):
    place = str(tmp_path / "central")
    assert folders.check_central(place) == {"valid": False, "warnings": [], "errors": ["not there"]}
    made = folders.make_central(place)
    assert made["success"] and made["created"] and folders.check_central(place) == {"valid": True, "warnings": [], "errors": []}
    assert not folders.make_central(place)["created"]
    folders.change_registry(place, lambda _: {"version": 1, "mappings": [{"path": "p/"}]})
    assert folders.read_registry(place)["mappings"] == [{"path": "p/"}]
    (tmp_path / "central" / folders.REGISTRY).write_text("broken")
    assert folders.read_registry(place) == {"version": 1, "mappings": []}


def test_quarantine(tmp_path):
    at = folders.quarantine(str(tmp_path), "memory/a.md", b"l", None, dt.datetime(2024, 1, 2, 3, 4, 5, 6000, dt.UTC))
    assert at.endswith("2024-01-02T03-04-05-006Z") and [p.name for p in (tmp_path / ".quarry" / "conflicts").glob("*/*")] == ["memory_a.md.local"]


def test_watch(tmp_path):
    polled, time = [], iter(range(0, 1000, 200))

    def poll(folder):
        polled.append(folder)
        if folder == "bad":
            raise OSError("gone")
        return f"pulled {folder}"

    watch = folders.Watch(str(tmp_path), lambda: ["a", "bad"], poll, lambda: "valid", validate=300, log_bytes=150)
    watch.run(rounds=3, sleep=lambda s: None, clock=lambda: next(time))
    assert polled == ["a", "bad"] * 3 and watch.running() is None
    assert any("[error] bad gone" in x for x in watch.last_lines()) and (tmp_path / "watch.log.1").exists()
    watch.pid_file.write_text(str(__import__("os").getpid()))
    with pytest.raises(RuntimeError):
        watch.run(rounds=1)
