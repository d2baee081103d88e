from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quarry.facade import Memory
from quarry.sources import changes as listing
from quarry.streaming import changes, live

SCHEMA = "directory string, file string, event string, ts timestamp, event_id long"


def put(spark, folder, number, rows):
    made = spark.createDataFrame(rows, "directory string, file string, event string, s double, event_id long").withColumn("s", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    made.withColumnRenamed("s", "ts").coalesce(1).write.mode("append").parquet(f"{folder}/{number:03}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def collected(out):
    return lambda batch, number: out.extend(tuple(r) for r in batch.collect())


def test_bursts_by_event_time_over_many_batches(spark, tmp_path):
    """The rows of the table function, whatever the batches; the query is stopped and started in between."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice("xyz"), rng.choice(["add", "change", "unlink"]), float(rng.choice([0, 1, 2, 3, 9, 10, 14, 30, 33, 60])) + rng.choice([0.0, 0.25]), i) for i in range(120)]
    rows.sort(key=lambda r: (r[3], r[4]))
    folder, out = str(tmp_path / "in"), []
    for number, at in enumerate(range(0, 120, 60)):
        put(spark, folder, number, rows[at : at + 60])
        live.started(live.debounced(stream(spark, folder), 4, True, "1 second"), collected(out), str(tmp_path / "check")).awaitTermination()
    put(spark, folder, 9, [(d, "end", "add", 1e6, 999) for d in "abz"])
    live.started(live.debounced(stream(spark, folder), 4, True, "1 second"), collected(out), str(tmp_path / "check")).awaitTermination()
    table = spark.createDataFrame(rows, "directory string, file string, event string, ts double, event_id long").withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    assert sorted(out) == sorted(tuple(r) for r in changes.last_events(table, 4).select("directory", "burst", "file", "event").collect())


def until(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)
    assert done()


def test_an_open_burst_outlives_the_query(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    put(spark, folder, 0, [("d", "x", "add", 1.0, 1), ("d", "y", "add", 1.0, 2), ("d", "x", "change", 2.0, 3)])
    start = lambda gap: live.started(live.debounced(stream(spark, folder), gap), collected(out), str(tmp_path / "check"), "100 milliseconds")
    query = start(3600)
    until(lambda: query.lastProgress and any(p["numInputRows"] for p in query.recentProgress))
    query.stop()
    assert out == []
    # the timer of the first run would take an hour; the next event sets a new one
    put(spark, folder, 1, [("d", "y", "unlink", 3.0, 4), ("d", "x", "add", 1.5, 5)])
    query = start(1)
    try:
        until(lambda: len(out) == 2)
    finally:
        query.stop()
    assert sorted(out) == [("d", 1, "x", "change"), ("d", 1, "y", "unlink")]


def test_listings(tmp_path):
    (tmp_path / "memory" / "deep").mkdir(parents=True)
    (tmp_path / "MEMORY.md").write_text("a")
    (tmp_path / "memory" / "deep" / "b.md").write_text("b")
    (tmp_path / "memory" / ".c.md").write_text("c")
    (tmp_path / "memory" / "d.txt").write_text("d")
    now = listing.listed(str(tmp_path))
    assert set(now) == {"MEMORY.md", "memory/deep/b.md"} and listing.listed(str(tmp_path / "none")) == {}
    before = {"MEMORY.md": [1, 1], "memory/gone.md": [1, 1]}
    assert listing.differences(before, now) == [("MEMORY.md", "change"), ("memory/deep/b.md", "add"), ("memory/gone.md", "unlink")]
    at = now["MEMORY.md"][0]
    assert listing.settled(now, before, at + 5, 10)["MEMORY.md"] == [1, 1] and listing.settled(now, before, at + 50, 10)["MEMORY.md"] == now["MEMORY.md"]


def test_reader_rows_are_the_same_again(tmp_path):
    (tmp_path / "memory").mkdir()
    reader = listing._Reader(str(tmp_path), str(tmp_path / "state"), 0.0)
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == []
    (tmp_path / "memory" / "a.md").write_text("a")
    rows, end = reader.read(start)
    rows = list(rows)
    assert [r[1:3] for r in rows] == [("memory/a.md", "add")] and list(reader.readBetweenOffsets(start, end)) == rows
    (tmp_path / "memory" / "a.md").unlink()
    again, last = listing._Reader(str(tmp_path), str(tmp_path / "state"), 0.0).read(end)
    assert [r[1:3] for r in again] == [("memory/a.md", "unlink")] and last == {"n": 2}
    reader.commit(last)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["listing-0.json", "listing-2.json"]


@pytest.mark.parametrize("gap", [0.5])
def test_watched_folder_keeps_an_index(spark, tmp_path, gap):
    folder = tmp_path / "notes"
    (folder / "memory").mkdir(parents=True)
    (folder / "memory" / "old.md").write_text("old")
    m = Memory(spark, str(folder))
    m.sync()
    seen = []

    def update(batch, number):
        seen.extend((r.file, r.event) for r in batch.collect())
        m.sync()

    query = live.watched(spark, [str(folder)], update, str(tmp_path / "home"), gap, 0.05)
    try:
        until(lambda: query.lastProgress is not None)
        (folder / "memory" / "new.md").write_text("one")
        (folder / "memory" / "old.md").unlink()
        until(lambda: len(seen) >= 2 and not m.is_stale())
    finally:
        query.stop()
    assert sorted(seen) == [("memory/new.md", "add"), ("memory/old.md", "unlink")] and [r.path for r in m.table("files").collect()] == ["memory/new.md"]
