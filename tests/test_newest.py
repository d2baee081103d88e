from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from quarry import config, folders
from quarry.operators import embed, index
from quarry.operators.remote import ServiceError

ROWS = [(i, (None if i % 17 == 0 else 5 if i % 3 == 0 else (i * 7919) % 1000 - 500), f"k{(i * 31) % 400:03}") for i in range(400)]


def order(r):
    return (r[1] is None, -(r[1] or 0), r[2])


@pytest.mark.parametrize("n", [0, 1, 50, 130, 131, 260, 375, 376, 377, 390, 399, 400, 500])
@pytest.mark.parametrize("small", [5, 1000])
def test_newest_rows(spark, monkeypatch, n, small):
    monkeypatch.setattr(index, "ONE_TASK", small)
    monkeypatch.setattr(index, "PARTS", 4)
    table = spark.createDataFrame(ROWS, "i long, at long, k string").repartition(5)
    found = index.newest(table, n, "at", ["k"])
    assert sorted(tuple(r) for r in found.collect()) == sorted(sorted(ROWS, key=order)[:n])


def test_a_wide_range_of_times(spark):
    rows = [(0, -(1 << 63)), (1, (1 << 63) - 1), (2, 0), (3, 1), (4, -1)]
    table = spark.createDataFrame(rows, "k long, at long")
    for n in range(6):
        assert {r.k for r in index.newest(table, n, "at", ["k"]).collect()} == {k for k, _ in sorted(rows, key=lambda r: -r[1])[:n]}
    assert index.newest(table.where(F.lit(False)), 3, "at", ["k"]).count() == 0


def test_no_task_gets_all(spark, monkeypatch):
    monkeypatch.setattr(index, "ONE_TASK", 100)
    cache = spark.range(50_000).select(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("").alias("provider_key"), F.col("id").cast("string").alias("hash"), F.pmod(F.xxhash64("id"), F.lit(9999)).alias("updated_at"))
    pruned = index.cache_pruned(cache, 20_000)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "SinglePartition" not in plan and "GlobalLimit" not in plan
    want = cache.orderBy(F.desc("updated_at"), *index.CACHE_KEYS).limit(20_000)
    assert pruned.count() == 20_000 and pruned.select("hash").exceptAll(want.select("hash")).count() == 0


def test_writers_of_one_registry_lose_nothing(tmp_path):
    """Many threads add a mapping each; one finds the claim of a writer that died."""
    central = str(tmp_path)

    def add(i):
        folders.change_registry(central, lambda r: r | {"mappings": [*r["mappings"], {"path": f"p{i}/", "machineId": "m"}]}, attempts=500)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(24)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {m["path"] for m in folders.read_registry(central)["mappings"]} == {f"p{i}/" for i in range(24)}
    assert [p.name for p in tmp_path.iterdir()] == [folders.REGISTRY]


def test_two_interleaved_writers(tmp_path):
    """The second writes while the first is between reading and claiming, and while the first has its claim."""
    central, calls = str(tmp_path), []

    def first(registry):
        calls.append(len(registry["mappings"]))
        if len(calls) == 1:
            with pytest.raises(TimeoutError):
                folders.change_registry(central, lambda r: r, attempts=2, sleep=lambda s: None)
        return registry | {"mappings": [*registry["mappings"], {"path": "a/"}]}

    folders.change_registry(central, first)
    folders.change_registry(central, lambda r: r | {"mappings": [*r["mappings"], {"path": "b/"}]})
    assert [m["path"] for m in folders.read_registry(central)["mappings"]] == ["a/", "b/"]


@pytest.mark.parametrize("status,calls", [(400, 1), (401, 1), (404, 1), (429, 3), (500, 3), (503, 3)])
def test_only_some_answers_are_asked_for_again(status, calls):
    made, waits = [], []

    def call():
        made.append(1)
        raise ServiceError(status, "no")

    with pytest.raises(ServiceError):
        embed.with_retries(call, sleep=waits.append, jitter=0.2)
    assert len(made) == calls and all(0.5 * 2**i <= w <= 0.6 * 2**i for i, w in enumerate(waits))


def test_damaged_layers_say_nothing(spark):
    rows = spark.createDataFrame([('{"query":{"minScore":0.5}}', "{broken"), (None, "[1]"), ("", '{"query":{"maxResults":3}}')], "a string, b string")
    found = [json.loads(r.j)["query"] for r in rows.select(config.merged_json(F.col("a"), F.col("b")).alias("j")).collect()]
    assert [(q["minScore"], q["maxResults"]) for q in found] == [(0.5, 10), (0.3, 10), (0.3, 3)]


def test_settings_of_home_lie_below_a_folders_own(tmp_path):
    for name, text in ((".config/quarry/config.json", '{"query":{"maxResults":1,"minScore":0.1}}'), (".quarry/config.json", '{"query":{"maxResults":2}}'), ("xdg/quarry/config.json", "broken")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    low = config.global_layers(tmp_path, None, tmp_path / "notes" / ".quarry")
    assert config.merged(*low, {"query": {"minScore": 0.5}}) == {"query": {"maxResults": 2, "minScore": 0.5}}
    assert config.global_layers(tmp_path, str(tmp_path / "xdg"), tmp_path / ".quarry") == [{}]
