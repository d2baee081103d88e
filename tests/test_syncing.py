"""Runs of push, pull and both; providers from settings; the time a query's vector may take."""

from __future__ import annotations

import datetime as dt
import json
import time

import pytest

from quarry import folders, syncing
from quarry.operators import embed, remote
from quarry.sources.files import HIDDEN

NOW = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


@pytest.fixture
def place(tmp_path):
    here, central = tmp_path / "here", tmp_path / "central"
    (here / "memory").mkdir(parents=True)
    (here / HIDDEN).mkdir()
    (central / "p" / "memory").mkdir(parents=True)
    (here / HIDDEN / "config.json").write_text(json.dumps({"sync": {"central": str(central), "path": "p/"}}))
    folders.change_registry(str(central), lambda _: {"version": 1, "mappings": [{"path": "p/", "localPath": str(here), "machineId": "m", "lastSync": "old"}, {"path": "q/", "localPath": "x", "machineId": "m", "lastSync": "old"}]})
    (here / "MEMORY.md").write_text("mine")
    (here / "memory" / "both.md").write_text("here")
    (central / "p" / "memory" / "both.md").write_text("there")
    (central / "p" / "memory" / "new.md").write_text("new")
    return here, central


def test_both_ways_with_state_registry_and_log(spark, place):
    here, central = place
    out = syncing.run(spark, str(here), "sync", machine="m", now=NOW)
    assert (out["pushed"], out["pulled"], out["skipped"], out["errors"]) == (2, 1, [], [])
    assert (central / "p" / "MEMORY.md").read_text() == "mine" and (here / "memory" / "new.md").read_text() == "new" and (central / "p" / "memory" / "both.md").read_text() == "here"
    state = json.loads((here / HIDDEN / syncing.STATE).read_text())
    assert set(state["files"]) == {"MEMORY.md", "memory/both.md", "memory/new.md"} and all(f["localHash"] == f["remoteHash"] != "" for f in state["files"].values())
    assert [m["lastSync"] for m in folders.read_registry(str(central))["mappings"]] == ["2024-05-01T00:00:00.000Z", "old"]
    assert json.loads((here / HIDDEN / syncing.LOG).read_text())["operation"] == "sync"
    assert syncing.run(spark, str(here), "sync", machine="m", now=NOW)["files"] == []


def test_pull_skips_or_puts_aside(spark, place):
    here, _ = place
    dry = syncing.run(spark, str(here), "pull", dry_run=True)
    assert dry["skipped"] == ["MEMORY.md", "memory/both.md"] and not (here / "memory" / "new.md").exists() and not (here / HIDDEN / syncing.LOG).exists()
    out = syncing.run(spark, str(here), "pull", force=True, now=NOW)
    assert out["pulled"] == 2 and (here / "memory" / "both.md").read_text() == "there"
    aside = {p.name: p.read_text() for p in (here / HIDDEN / "conflicts").glob("*/*")}
    assert aside == {"memory_both.md.local": "here", "memory_both.md.remote": "there"}


def test_one_file_that_fails_does_not_stop_the_others(spark, place):
    here, central = place
    (central / "p" / "MEMORY.md").mkdir()
    out = syncing.run(spark, str(here), "push", now=NOW)
    assert out["pushed"] == 1 and len(out["errors"]) == 1 and out["errors"][0].startswith("MEMORY.md")
    assert json.loads((here / HIDDEN / syncing.LOG).read_text())["result"] == "error"
    with pytest.raises(syncing.NotMapped):
        syncing.run(spark, str(central), "push")


def test_providers_from_settings(monkeypatch):
    for name in ("OPENAI_API_KEY", "GOOGLE_API_KEY", "GEMINI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert [(p.id, instead) for p, instead in (remote.provider_of(c) for c in ({}, {"provider": "none"}, {"provider": "deterministic"}))] == [("none", "auto"), ("none", None), (embed.DeterministicProvider().id, None)]
    assert remote.provider_of({"provider": "openai", "fallback": "none"})[0].id == "none"
    with pytest.raises(embed.MissingKey):
        remote.provider_of({"provider": "openai"})
    provider, _ = remote.provider_of({"provider": "openai", "model": "openai/m", "openai": {"apiKey": "k", "baseUrl": "http://h/", "headers": {"x": "y"}}}, lambda *a: (200, b'{"data": [{"embedding": [1, 2]}]}'))
    assert (provider.model, provider.url, provider.headers["x"], embed.query_vector(provider, "q")) == ("m", "http://h", "y", [1, 2])
    monkeypatch.setenv("GEMINI_API_KEY", "g")
    assert remote.provider_of({"provider": "auto"})[0].id == "gemini"


def test_a_query_that_takes_too_long():
    class Slow(embed.NoProvider):
        def embed_query(self, text):
            time.sleep(2)
            return [1.0]

    with pytest.raises(TimeoutError):
        embed.query_vector(Slow(), "q", 0.05)
    assert embed.query_vector(Slow(), "q") == [1.0]
