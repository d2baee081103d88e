from __future__ import annotations

import json

import pytest

from quarry.__main__ import main
from quarry.facade import InvalidPath, Memory, offline
from quarry.operators.embed import DeterministicProvider
from quarry.sources.files import AmbiguousMemory, memory_files, parsed_log, parsed_registry, parsed_state, syncable_files
from quarry.tools import Server, ToolExecutor


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "memory" / "deep").mkdir(parents=True)
    (tmp_path / "MEMORY.md").write_text("# Decisions\nWe chose the database design for the project.\n")
    (tmp_path / "memory" / "a.md").write_text("Meeting notes: deploy the api\nFix the login bug\n")
    (tmp_path / "memory" / "deep" / "b.md").write_text("Remember the quarterly goal\n")
    (tmp_path / "memory" / "c.txt").write_text("not a memory")
    (tmp_path / "other.md").write_text("not a memory")
    return tmp_path


def test_discovery(spark, folder, tmp_path):
    assert {r.path for r in memory_files(spark, str(folder)).collect()} == {"MEMORY.md", "memory/a.md", "memory/deep/b.md"}
    assert memory_files(spark, str(tmp_path / "none")).count() == 0
    (folder / "memory.md").write_text("else")
    with pytest.raises(AmbiguousMemory):
        memory_files(spark, str(folder))
    (folder / ".quarry").mkdir()
    (folder / ".quarry" / "x.md").write_text("own")
    found = {r.file for r in syncable_files(spark, str(folder), ["**/*.md", "*.txt"], ["memory/deep/**"]).collect()}
    assert found == {"MEMORY.md", "memory.md", "memory/a.md", "other.md"}


def test_sync_and_search(spark, folder):
    class Counting(DeterministicProvider):
        pass

    m = offline(spark, str(folder), query={"minScore": 0.0})
    found = m.search("login bug")
    assert found and found[0]["path"] == "memory/a.md" and set(found[0]) == {"path", "start_line", "end_line", "score", "snippet"}
    assert m.search("   ") == [] and not m.is_stale()
    before = {r.path: r.updated_at for r in m.table("chunks").collect()}
    (folder / "memory" / "a.md").write_text("Entirely new content about gardening\n")
    (folder / "memory" / "deep" / "b.md").unlink()
    (folder / "memory" / "new.md").write_text("urgent review\n")
    assert m.is_stale()
    assert m.sync() == {"changed": 1, "deleted": 1, "new": 1, "unchanged": 1}
    after = {r.path: r.updated_at for r in m.table("chunks").collect()}
    assert set(after) == {"MEMORY.md", "memory/a.md", "memory/new.md"} and after["MEMORY.md"] == before["MEMORY.md"]
    status = m.status()
    assert (status["files"], status["chunks"], status["stale"]) == (3, 3, False) and status["cache"] == 5
    full = {(r.path, r.hash) for r in m.table("chunks").collect()}
    m.sync(force=True)
    assert {(r.path, r.hash) for r in m.table("chunks").collect()} == full
    again = offline(spark, str(folder), query={"minScore": 0.0})
    assert again.search("gardening", max_results=1)[0]["path"] == "memory/a.md"


def test_keyword_search_only(spark, folder):
    m = Memory(spark, str(folder), query={"minScore": 0.0})
    assert [r["path"] for r in m.search("the project")] == ["MEMORY.md"]
    assert m.search("absent") == [] and m.status()["model"] == "bm25-only"
    vectors = offline(spark, str(folder), hybrid={"enabled": False}, query={"minScore": 0.0})
    vectors.sync()
    assert len(vectors.results("goal", 2).collect()) == 2


def test_files(spark, folder):
    m = Memory(spark, str(folder))
    m.write_file("memory/n.md", "one\n")
    m.append_file("memory/n.md", "two")
    m.append_file("memory/n.md", "three")
    assert m.read_file("memory/n.md") == "one\ntwo\nthree" and m.read_file("memory/none.md") is None
    assert m.read_lines("memory/n.md", 2, 1) == {"content": "two", "start_line": 2, "end_line": 2}
    name = m.append_today("note")
    assert name in m.list_files() and m.read_file(name) == "note"
    for bad in ("../x.md", "other.md", "memory/../x.md", "memory/x.txt"):
        with pytest.raises(InvalidPath):
            m.write_file(bad, "x")


def test_json_sources(spark):
    texts = spark.createDataFrame([('{"version":1,"mappings":[{"path":"p","localPath":"~/l","machineId":"m","lastSync":"t"}]}',), ("broken",), ("{}",)], "content string")
    assert [(r.position, r.path, r.machine_id) for r in parsed_registry(texts).collect()] == [(0, "p", "m")]
    state = spark.createDataFrame([('{"version":1,"centralPath":"old","files":{"a":{"localHash":"1","remoteHash":"2","lastSyncedHash":"3"}}}',), ("[]",)], "content string")
    assert [tuple(r) for r in parsed_state(state, "new").collect()] == [("a", "1", "2", None, "new")]
    lines = spark.createDataFrame([('{"timestamp":"t1","operation":"push","pushed":2}',), ("",), ('{"timestamp":"t2","operation":"pull"}',)], "line string")
    assert {(r.timestamp, r.pushed) for r in parsed_log(lines).collect()} == {("t1", 2), ("t2", None)}
    assert parsed_log(lines.union(spark.createDataFrame([("oops",)], "line string"))).count() == 0


def results(score):
    return lambda query, most, least: [{"path": "memory/a.md", "start_line": 1, "end_line": 2, "score": score, "snippet": query}] * (most if score > 0.5 else 1)


def test_tool():
    tool = ToolExecutor({"Work/notes": results(0.9), "home": results(0.25)})
    text = tool.execute("memory_search", {"query": "q", "maxResults": 2})["content"][0]["text"]
    assert text == "[1] memory/a.md:1-2 [Work/notes] (90.0% match)\nq\n\n[2] memory/a.md:1-2 [Work/notes] (90.0% match)\nq\n\n(Searched 2 directories)"
    assert tool.execute("memory_search", {"query": "q", "directories": ["HOME"]})["content"][0]["text"] == "[1] memory/a.md:1-2 (25.0% match)\nq"
    none = tool.execute("memory_search", {"query": "q", "directories": ["x"]})
    assert none["isError"] and "Available: Work/notes, home" in none["content"][0]["text"]
    assert tool.execute("other", {})["isError"] and tool.execute("memory_search", {})["isError"]


def test_server():
    asked = []
    server = Server(ToolExecutor({"d": lambda q, most, least: asked.append(most) or []}))
    ask = lambda **r: server.handle_line(json.dumps({"jsonrpc": "2.0", "id": 1} | r))
    assert ask(method="initialize")["result"]["protocolVersion"] == "2024-11-05" and ask(method="ping")["result"] == {}
    assert ask(method="tools/list")["result"]["tools"][0]["name"] == "memory_search"
    answer = ask(method="tools/call", params={"name": "memory_search", "arguments": {"query": "q", "maxResults": 10}})
    assert answer["result"]["content"][0]["text"] == "No results found." and asked == [15]
    assert ask(method="nope")["error"]["code"] == -32601 and ask(method="tools/call", params={})["error"]["code"] == -32602
    assert server.handle_line("{")["error"]["code"] == -32700 and server.handle_line('{"id":1}')["error"]["code"] == -32600
    assert server.handle_line("  ") is None and server.handle_line('{"jsonrpc":"2.0","method":"initialized"}') is None
    written = []
    server.run(["\n", '{"jsonrpc":"2.0","id":5,"method":"ping"}\n'], written.append)
    assert json.loads(written[0]) == {"jsonrpc": "2.0", "id": 5, "result": {}}


def test_command_line(spark, folder, tmp_path, capsys):
    d = str(folder)

    def run(*argv):
        capsys.readouterr()
        assert main(list(argv)) == 0
        return capsys.readouterr().out

    run("init", "-d", d, "-f")
    assert json.loads(run("config", "-d", d, "--set", "query.minScore=0"))["query"] == {"maxResults": 10, "minScore": 0}
    run("append", "-d", d, "-f", "memory/log.md", "-s", "s1", "gardening plan")
    assert "session=s1" in (folder / "memory" / "log.md").read_text()
    assert "memory/log.md" in run("search", "-d", d, "--json", "-s", "0", "gardening plan")
    assert json.loads(run("status", "-d", d))["files"] == 4
    run("upsert", "-d", d, "-s", "s9", "--session-source", "tool", "memory/log.md", "---\ncreated: 2024\ntags: [a]\n---\nnew body")
    head = (folder / "memory" / "log.md").read_text()
    assert head.startswith("---\nsession:\n  id: s9\n  source: tool\n") and "created: 2024" in head and "tags: [a]" in head and head.endswith("new body")
    central = tmp_path / "central"
    (central / "memory").mkdir(parents=True)
    (central / "memory" / "theirs.md").write_text("theirs")
    assert json.loads(run("sync:status", "-d", d, str(central)))["local_only"] == 4
    run("push", "-d", d, str(central))
    assert (central / "memory" / "log.md").exists()
    run("pull", "-d", d, "--dry-run", str(central))
    assert not (folder / "memory" / "theirs.md").exists()
    run("pull", "-d", d, str(central))
    assert (folder / "memory" / "theirs.md").read_text() == "theirs"
    assert [json.loads(line)["operation"] for line in run("sync:log", "-d", d).splitlines()] == ["push", "pull"]
    assert json.loads(run("sync:init-central", str(central)))["success"]
    run("sync:init", "-d", d, str(central), "--path", "notes", "--machine", "m1")
    run("sync:init", "-d", d, str(central), "--path", "notes/", "--machine", "m2")
    assert [json.loads(x)["machineId"] for x in run("sync:list", str(central)).splitlines()] == ["m1", "m2"]
    assert "collision" in run("sync:validate", "-d", d, str(central / ".registry.json"))
    run("sync:remove", str(central), "--path", "notes", "--machine", "m1")
    assert len(run("sync:list", str(central)).splitlines()) == 1
    (folder / "memory" / "late.md").write_text("late")
    run("watch", "-d", d, "--rounds", "1")
    assert "'new': 2" in run("watch:logs", "-d", d) and json.loads(run("watch:status", "-d", d)) == {"pid": None}
