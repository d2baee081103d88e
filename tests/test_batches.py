from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quarry.operators.batches import BatchLost, BatchRun, GeminiJobs, OpenAiJobs
from quarry.operators.remote import GeminiService, OpenAiService


class Stub(ThreadingHTTPServer):
    """Both services' batch interfaces: files, jobs that are done after some questions, answers."""

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.files, self.jobs, self.asked, self.busy, self.broken = {}, {}, {}, 2, set()
        self.lock = threading.Lock()
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}/v1"

    def vector(self, text):
        return [float(len(text)), float(text.count("a")), 1.0]

    def answer(self, file):
        out = []
        for line in self.files[file].split("\n"):
            row = json.loads(line)
            key = row.get("custom_id") or row["key"]
            text = row["body"]["input"] if "body" in row else row["request"]["content"]["parts"][0]["text"]
            if key in self.broken:
                out.append(json.dumps({"custom_id": key, "error": {"message": "no"}}))
            elif "body" in row:
                out.append(json.dumps({"custom_id": key, "response": {"status_code": 200, "body": {"data": [{"embedding": self.vector(text)}]}}}))
            else:
                out.append(json.dumps({"key": key, "response": {"embedding": {"values": self.vector(text)}}}))
        return "\n".join(out) + "\n"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _say(self, found, status=200):
        body = (found if isinstance(found, str) else json.dumps(found)).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        s, body = self.server, self.rfile.read(int(self.headers["Content-Length"])).decode()
        with s.lock:
            if "/files" in self.path:
                name = f"files/{len(s.files)}" if "upload" in self.path else f"f{len(s.files)}"
                s.files[name] = re.split(r"\r\n--", body.split("application/jsonl")[-1].split("\r\n\r\n", 1)[1])[0]
                return self._say({"file": {"name": name}} if "upload" in self.path else {"id": name})
            found = json.loads(body)
            job = f"batches/b{len(s.jobs)}" if "async" in self.path else f"b{len(s.jobs)}"
            s.jobs[job] = found.get("input_file_id") or found["batch"]["inputConfig"]["file_name"]
            return self._say({"name": job} if "async" in self.path else {"id": job, "status": "validating"})

    def do_GET(self):
        s, path = self.server, self.path.removeprefix("/v1/")
        with s.lock:
            if path.startswith("batches?"):
                return self._say({"data": [{"id": j, "input_file_id": f} for j, f in s.jobs.items()]})
            if path == "batches":
                return self._say({"operations": [{"name": j, "metadata": {"inputConfig": {"file_name": f}}} for j, f in s.jobs.items()]})
            if path.startswith("batches/"):
                job = path if path in s.jobs else path.removeprefix("batches/")
                s.asked[job] = s.asked.get(job, 0) + 1
                done = s.asked[job] > s.busy
                if job.startswith("batches/"):
                    return self._say({"state": "SUCCEEDED" if done else "RUNNING", "metadata": {"output": {"responsesFile": f"files/out-{s.jobs[job]}"}} if done else {}})
                return self._say({"status": "completed" if done else "in_progress", "output_file_id": f"out-{s.jobs[job]}" if done else None})
            file = path.removeprefix("files/").removesuffix("/content").removesuffix(":download").removeprefix("out-")
            return self._say(s.answer(file))


@pytest.fixture
def stub():
    server = Stub()
    yield server
    server.shutdown()


def jobs_of(kind, stub):
    if kind == "openai":
        return OpenAiJobs(OpenAiService.create("m", "k", stub.url))
    return GeminiJobs(GeminiService.create("m", "k", stub.url))


TEXTS = [(f"h{i:02}", "a" * i + "é\n" if i else None) for i in range(23)]


@pytest.mark.parametrize("kind", ["openai", "gemini"])
def test_a_run_that_is_killed_goes_on(spark, tmp_path, stub, kind):
    """Killed while it waits: files and jobs are those of the first run. Killed between a start and its note: the service knows the job."""
    requests = spark.createDataFrame(TEXTS, "hash string, text string")

    def killed(seconds):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        BatchRun(spark, str(tmp_path), jobs_of(kind, stub), 10).run(requests, sleep=killed)
    assert len(stub.files) == len(stub.jobs) == 3
    for note in (tmp_path / "jobs").glob("*batch-1.json*"):
        note.unlink()
    found = BatchRun(spark, str(tmp_path), jobs_of(kind, stub), 10).run(requests, sleep=lambda s: None)
    assert {r.hash: r.embedding for r in found.collect()} == {h: stub.vector(t or "") for h, t in TEXTS}
    assert len(stub.files) == len(stub.jobs) == 3
    asked = sum(stub.asked.values())
    again = BatchRun(spark, str(tmp_path), jobs_of(kind, stub), 10).run(requests)
    assert again.count() == 23 and len(stub.files) == 3 and sum(stub.asked.values()) == asked


def test_failures(spark, tmp_path, stub):
    requests = spark.createDataFrame(TEXTS[:4], "hash string, text string")
    stub.broken.add("h02")
    with pytest.raises(BatchLost, match="h02"):
        BatchRun(spark, str(tmp_path / "a"), jobs_of("openai", stub)).run(requests, sleep=lambda s: None)
    clock = iter(range(0, 10**6, 1000))
    stub.busy = 10**6
    with pytest.raises(TimeoutError):
        BatchRun(spark, str(tmp_path / "b"), jobs_of("openai", stub)).run(requests, timeout=5000, sleep=lambda s: None, clock=lambda: next(clock))
    empty = BatchRun(spark, str(tmp_path / "c"), jobs_of("gemini", stub)).run(requests.limit(0))
    assert empty.count() == 0
