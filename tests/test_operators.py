from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.operators import embed, index, inverted, search, sync
from quarry.streaming import changes


def row_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("rank,score", [(0.0, 1.0), (1.0, 0.5), (-1.0, 0.5), (-100.0, 1 / 101), (float("inf"), 0.0), (float("nan"), 0.0), (None, 0.0)])
def test_rank_to_score(spark, rank, score):
    assert spark.createDataFrame([(rank,)], "r double").select(search.rank_to_score(F.col("r"))).first()[0] == pytest.approx(score)


TEXTS = ["foo bar baz", "Foo-bar café", "bar foo bar bar", "nothing here", "foo_bar", "the the the of", "été FOO bar", "", "baz of the foo bar " * 9]


@pytest.mark.parametrize("query", ["foo", "foo bar", "foo_bar", "the the", "cafe", "café", "absent", "bar of", "FOO_bar_baz"])
def test_bm25_equals_an_inverted_index(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    match = " AND ".join(f'"{w}"' for w in __import__("re").findall("[A-Za-z0-9_]+", query))
    want = dict(con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
    found = search.bm25(search.with_tokens(spark.createDataFrame(list(enumerate(TEXTS, 1)), "id long, text string")), query)
    got = {r.id: r["rank"] for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("query", ["foo", "foo bar", "foo_bar", "the the", "absent", "FOO_bar_baz", "   ", "_"])
def test_written_index_equals_scan(spark, tmp_path, query):
    rows = spark.createDataFrame([*enumerate(TEXTS, 1), (99, None)], "id long, text string")
    written = inverted.build(rows, str(tmp_path / "index"), buckets=4)
    want = {r.id: r["rank"] for r in search.bm25(search.with_tokens(rows), query).collect()}
    assert {r.id: r["rank"] for r in written.bm25(query).collect()} == pytest.approx(want)


def hits(spark, score, rows):
    return spark.createDataFrame([(i, f"p{i}", 1, 2, "memory", s, v) for i, s, v in rows], f"id string, path string, start_line int, end_line int, source string, snippet string, {score} double")


def test_hybrid_merge(spark):
    v = hits(spark, "vector_score", [("a", "va", 0.9), ("b", "vb", 0.2)])
    k = hits(spark, "text_score", [("b", "kb", 1.0), ("c", "", 1.0)])
    merged = {r.id: (r.score, r.snippet) for r in search.merge_hybrid(v, k).collect()}
    assert merged["a"] == (pytest.approx(0.63), "va") and merged["b"] == (pytest.approx(0.44), "kb") and merged["c"] == (pytest.approx(0.3), "")
    half = {r.id: r.score for r in search.merge_hybrid(v, k, 0.5, 0.5).collect()}
    assert half["b"] == pytest.approx(0.5 * 0.2 + 0.5 * 1.0)
    only_v = {r.id: r.score for r in search.merge_hybrid(v, k.limit(0)).collect()}
    only_k = {r.id: r.score for r in search.merge_hybrid(v.limit(0), k).collect()}
    assert only_v == {"a": 0.9, "b": 0.2} and only_k == {"b": 1.0, "c": 1.0}
    assert search.merge_hybrid(v.limit(0), k.limit(0)).count() == 0
    assert [r.id for r in search.best(search.merge_hybrid(v, k), 10, 0.4).collect()] == ["a", "b"]


def test_candidates():
    assert [search.candidate_count(n) for n in (10, 0, 500)] == [20, 1, 200] and search.oversampled(10) == 15


def test_many_vector_queries_equal_one_by_one(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.when(F.col("vec_id") == 7, F.array()).when(F.col("vec_id") == 8, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    queries = [(i, v) for i, v in enumerate([[1.0] * 64, [0.5, -1.0] * 5, [1.0] * 70, [0.0] * 64])]
    many = {}
    for r in search.vector_topk_many(rows, queries, 5, "vec_id", block=2).orderBy("query_id", "rank").collect():
        many.setdefault(r.query_id, []).append((r.id, round(r.vector_score, 9)))
    for i, v in queries[:3]:
        assert many[i] == [(r.vec_id, round(r.vector_score, 9)) for r in search.vector_topk(rows, v, 5, "vec_id").collect()]
    assert search.vector_topk(rows, [0.0] * 64, 5, "vec_id").count() == 0


def test_deterministic_vectors_agree(spark):
    texts = ["Project meeting, todo: FIX the bug bug", "", "a", "Écrire une note"]
    provider = embed.DeterministicProvider()
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("hash", F.col("i").cast("string"))
    by_column = {r.i: r.v for r in docs.select("i", embed.keyword_vector(F.col("text")).alias("v")).collect()}
    by_batch = {int(r.hash): r.embedding for r in embed.embed_missing(docs, provider, batch=2).collect()}
    for i, t in enumerate(texts):
        assert by_column[i] == pytest.approx(provider.embed_query(t)) and by_batch[i] == pytest.approx(provider.embed_query(t))


def test_providers():
    def missing():
        raise embed.MissingKey("no key")

    def broken():
        raise OSError("down")

    ready = embed.DeterministicProvider
    assert embed.choose_provider("none", {})[0].id == "none"
    assert embed.choose_provider("auto", {"a": missing, "b": ready})[0].id == "deterministic"
    assert [embed.choose_provider("auto", {"a": missing})[i] for i in (1,)] == ["auto"]
    with pytest.raises(OSError):
        embed.choose_provider("auto", {"a": broken})
    assert embed.choose_provider("a", {"a": broken, "b": ready}, "b")[1] == "a"
    with pytest.raises(OSError):
        embed.choose_provider("a", {"a": broken})
    waits, calls = [], iter([OSError(), OSError(), "ok"])

    def flaky():
        if isinstance(x := next(calls), Exception):
            raise x
        return x

    assert embed.with_retries(flaky, sleep=waits.append) == "ok" and waits == [0.5, 1.0]


def files(spark, *rows):
    return spark.createDataFrame([(p, t, float(m)) for p, t, m in rows], "path string, text string, mtime double")


def test_index_life_cycle(spark):
    old = index.file_entries(files(spark, ("a", "1", 1), ("b", "2", 1), ("c", "3", 1)))
    now = files(spark, ("a", "1", 1), ("b", "2x", 2), ("d", "4", 1))
    entries = index.file_entries(now)
    assert row_set(index.diff(entries, old), "path", "status") == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")}
    assert tuple(index.is_stale(entries, old).first()) == (True, 3) and tuple(index.is_stale(old, old).first()) == (False, 0)
    assert row_set(index.to_index(now, old), "path") == {("b",), ("d",)} and index.to_index(now, old, full=True).count() == 3
    assert row_set(index.without_stale(old, entries), "path") == {("a",), ("b",)}
    assert row_set(index.replaced(old, entries.where("path <> 'a'")), "path") == {("a",), ("b",), ("c",), ("d",)}
    chunks = index.chunk_rows(now, "m", 5)
    assert chunks.select("id").distinct().count() == 3 and row_set(chunks, "id") == row_set(index.chunk_rows(now, "m", 6), "id")


def test_full_reindex():
    meta = index.IndexMeta("m", "p", "k", 256, 32, 64)
    assert index.read_meta(meta.to_json()) == meta and index.read_meta("bad") is None and index.read_meta(None) is None
    assert not index.needs_full_reindex(meta, meta) and index.needs_full_reindex(meta, meta, force=True) and index.needs_full_reindex(None, meta)
    for change in ({"model": "x"}, {"provider": "x"}, {"provider_key": "x"}, {"chunk_tokens": 1}, {"chunk_overlap": 1}):
        assert index.needs_full_reindex(index.IndexMeta(**{**meta.__dict__, **change}), meta)
    assert index.needs_full_reindex(index.IndexMeta("m", "p", "k"), meta, vectors=True)


def test_cache(spark):
    schema = "provider string, model string, provider_key string, hash string, embedding array<double>, updated_at long"
    cache = spark.createDataFrame([("p", "m", "k", "h1", [1.0], 1), ("p", "m", "k", "h2", [2.0], 2), ("p", "other", "k", "h3", [3.0], 3)], schema)
    chunks = spark.createDataFrame([("h1", "one"), ("h3", "three"), ("h3", "three")], "hash string, text string")
    assert row_set(index.cache_hits(chunks, cache, "p", "m", "k"), "hash") == {("h1",)}
    assert [tuple(r) for r in index.cache_misses(chunks, cache, "p", "m", "k").collect()] == [("h3", "three")]
    new = spark.createDataFrame([("p", "m", "k", "h1", [9.0], 7)], schema)
    assert {(r.hash, r.embedding[0]) for r in index.cache_upserted(cache, new).where("model = 'm'").collect()} == {("h1", 9.0), ("h2", 2.0)}
    assert row_set(index.cache_touched(cache, chunks, 99), "hash", "updated_at") == {("h1", 99), ("h2", 2), ("h3", 99)}
    assert row_set(index.cache_pruned(cache, 2), "hash") == {("h2",), ("h3",)}
    assert index.migrated(cache, {"dims": "int"}, {"dims": 4}).first()["dims"] == 4


def test_batches(spark):
    out = index.segment_groups(spark.range(25).withColumn("k", F.col("id") % 3), ["k", "id"], 10).orderBy("position").collect()
    assert [r.position for r in out] == list(range(25)) and [r.batch for r in out] == [i // 10 for i in range(25)]
    assert [(r.k, r.id) for r in out] == sorted((i % 3, i) for i in range(25))
    assert index.segment_groups(spark.range(0), ["id"]).count() == 0
    lines = ["", '{"custom_id":"a","response":{"status_code":200,"body":{"data":[{"embedding":[1,2]}]}}}', '{"key":"b","response":{"embedding":{"values":[3]}}}', '{"request_id":"c","error":{"message":"bad"}}', '{"custom_id":"d","response":{"status_code":500}}', "{}"]
    results = embed.batch_results(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert row_set(results, "id", "problem") == {("a", None), ("b", None), ("c", "bad"), ("d", "status 500"), (None, "no id")}
    asked = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    assert row_set(embed.batch_problems(results.where("id is not null"), asked), "id", "problem") == {("c", "bad"), ("d", "status 500"), ("e", "missing")}


def side(spark, **names):
    return spark.createDataFrame([(f, h) for f, h in names.items()], "file string, hash string")


def test_sync_plans(spark):
    changed = sync.changes(side(spark, a="1", b="2", c="3"), side(spark, a="1", b="x", d="4"))
    assert row_set(changed, "file", "status") == {("a", "unchanged"), ("b", "local-modified"), ("c", "local-only"), ("d", "remote-only")}
    assert sync.summary(changed).first().asDict() == {"unchanged": 1, "local_only": 1, "remote_only": 1, "local_modified": 1}
    assert row_set(sync.push_plan(changed), "file", "action") == {("a", "none"), ("b", "push"), ("c", "push"), ("d", "skip")}
    assert row_set(sync.pull_plan(changed), "file", "action") == {("a", "none"), ("b", "skip"), ("c", "skip"), ("d", "pull")}
    assert row_set(sync.pull_plan(changed, force=True), "file", "action") == {("a", "none"), ("b", "pull"), ("c", "skip"), ("d", "pull")}
    assert row_set(sync.bidirectional_plan(changed), "file", "action") == {("a", "none"), ("b", "push"), ("c", "push"), ("d", "pull")}
    state = spark.createDataFrame([("a", "1", "1", "t"), ("b", "2", "", "t")], "file string, local_hash string, remote_hash string, last_modified string")
    assert row_set(sync.state_updated(state, side(spark, b="9"), "n"), "file", "remote_hash", "last_modified") == {("a", "1", "t"), ("b", "9", "n")}
    assert row_set(sync.state_without(state, side(spark, a="1")), "file") == {("b",)}


def test_registry(spark):
    rows = [("p/", "~/1", "m1", "2024-03-01 00:00:00", 0), ("p/", "~/2", "m2", "2024-01-01 00:00:00", 1), ("q/", "~/3", "m1", "2024-03-01 00:00:00", 2), ("q/", "~/4", "m1", None, 3)]
    reg = spark.createDataFrame(rows, "path string, local_path string, machine_id string, last_sync string, position int")
    timed = reg.withColumn("last_sync", F.to_timestamp("last_sync"))
    now = F.lit("2024-03-02 12:00:00").cast("timestamp")
    assert row_set(sync.collisions(reg), "path", "n_mappings") == {("p/", 2)}
    assert row_set(sync.stale_mappings(timed, now), "local_path", "days") == {("~/2", 61)}
    assert sync.validation_stats(timed, now).first().asDict() == {"total": 4, "active": 3, "stale": 1, "collisions": 1}
    asked = spark.createDataFrame([("p", "m1"), ("p", "m2"), ("z", "m1")], "path string, machine_id string")
    assert row_set(sync.collision_checks(reg, asked), "path", "machine_id", "result") == {("p", "m1", "same-machine"), ("p", "m2", "collision"), ("z", "m1", "none")}
    new = spark.createDataFrame([("p", "~/n", "m1", None, 9)], reg.schema)
    assert row_set(sync.with_mapping(reg, new), "path", "local_path") == {("p/", "~/n"), ("p/", "~/2"), ("q/", "~/3"), ("q/", "~/4")}
    assert sync.without_mapping(reg, "p", "m1").count() == 3 and sync.machine_mappings(reg, "m1").count() == 3
    assert row_set(sync.touched_mapping(reg, "p//", "m2", "X"), "local_path", "last_sync") >= {("~/2", "X"), ("~/4", None)}
    assert row_set(sync.validation_issues(timed, now, timed.where("local_path = '~/3'")), "type", "path") == {("collision", "p/"), ("stale", "p/"), ("missing", "q/")}


def test_logs_and_quarantine(spark):
    log = spark.createDataFrame([(i,) for i in range(30)], "i long")
    assert [r.i for r in sync.tail(log, ["i"], 3).collect()] == [27, 28, 29]
    assert sync.log_appended(log, spark.range(30, 40).toDF("i"), ["i"], 5).count() == 5
    copies = spark.createDataFrame([("2024-01-01T00-00-00-000Z", "MEMORY.md.local", "l"), ("2024-01-01T00-00-00-000Z", "memory_a.md.remote", "r"), ("2024-01-01T00-00-00-000Z", "MEMORY.md.remote", "m"), ("2024-03-01T00-00-00-000Z", "x.md.base", "b"), ("odd", "y.md.base", "b")], "timestamp string, file_name string, content string")
    listed = [(r.timestamp, r.files) for r in sync.quarantined(copies).collect()]
    assert listed == [("odd", ["y.md"]), ("2024-03-01T00-00-00-000Z", ["x.md"]), ("2024-01-01T00-00-00-000Z", ["MEMORY.md", "memory/a.md"])]
    assert row_set(sync.expired(copies, F.lit("2024-03-02 00:00:00").cast("timestamp")), "timestamp") == {("2024-01-01T00-00-00-000Z",)}
    assert row_set(sync.merge_files(copies), "file", "local", "remote", "base") >= {("MEMORY.md", "l", "m", None), ("x.md", None, None, "b")}


EVENTS = [("d", "f", "add", "2024-01-01 00:00:00", 1), ("d", "f", "change", "2024-01-01 00:00:01", 2), ("d", "g", "add", "2024-01-01 00:00:02", 3), ("d", "f", "unlink", "2024-01-01 00:00:04", 4), ("e", "f", "add", "2024-01-01 00:00:00", 5)]


def test_debounced_batches(spark):
    events = spark.createDataFrame(EVENTS, "directory string, file string, event string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    found = {(r.directory, r.n, tuple((x.file, x.event) for x in r["last"])) for r in changes.debounced(events, 2).collect()}
    assert found == {("d", 3, (("f", "change"), ("g", "add"))), ("d", 1, (("f", "unlink"),)), ("e", 1, (("f", "add"),))}
    assert row_set(changes.last_events(events, 2), "directory", "burst", "file", "event") == {("d", 1, "f", "change"), ("d", 1, "g", "add"), ("d", 2, "f", "unlink"), ("e", 1, "f", "add")}


def test_debounced_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame(EVENTS + [("z", "z", "add", "2024-01-02 00:00:00", 9)], "directory string, file string, event string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.json(str(source))
    stream = spark.readStream.schema(changes.CHANGE_SCHEMA).json(str(source)).withWatermark("ts", "1 second")
    query = changes.debounced(stream, 2).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.directory, r.n) for r in spark.table("bursts").collect()} == {("d", 3), ("d", 1), ("e", 1)}


def test_index_follows_a_stream(spark, tmp_path):
    source, schema = tmp_path / "in", "file string, event string, text string, ts timestamp, event_id long"
    follow = changes.FollowingIndex(str(tmp_path / "states"))

    def put(name, rows):
        spark.createDataFrame([(f, e, t, n) for f, e, t, n in rows], "file string, event string, text string, event_id long").withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1).write.mode("append").json(str(source))
        changes.follow(spark.readStream.schema(schema).json(str(source)), follow, str(tmp_path / "c")).awaitTermination()
        return {(r.path, r.text) for r in follow.table(spark).collect()}

    assert put("1", [("a", "add", "1", 1), ("b", "add", "2", 2), ("a", "change", "1x", 3)]) == {("a", "1x"), ("b", "2")}
    assert put("2", [("b", "unlink", None, 4), ("c", "add", "3", 5)]) == {("a", "1x"), ("c", "3")}


def test_index_goes_on_in_a_new_process(spark, tmp_path):
    """A new object on the same folder and checkpoint has all files, also after states were put together and old ones deleted."""
    source, schema = tmp_path / "in", "file string, event string, text string, ts timestamp, event_id long"
    for k in range(7):
        rows = [(f"f{k}", "add", str(k), 10 * k), ("f0", "change", f"0.{k}", 10 * k + 1)] + [(f"f{k - 1}", "unlink", None, 10 * k + 2)] * (k % 2)
        spark.createDataFrame(rows, "file string, event string, text string, event_id long").withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1).write.mode("append").json(str(source))
        follow = changes.FollowingIndex(str(tmp_path / "states"), compact=2)
        changes.follow(spark.readStream.schema(schema).json(str(source)), follow, str(tmp_path / "c")).awaitTermination()
        found = {(r.path, r.text) for r in changes.FollowingIndex(str(tmp_path / "states")).table(spark).collect()}
        gone = {f"f{i - 1}" for i in range(1, k + 1, 2)} - {"f0"}
        expected = {(f"f{i}", str(i)) for i in range(1, k + 1) if f"f{i}" not in gone}
        assert found == expected | ({("f0", f"0.{k}")} if k != 1 else set())
    follow(spark.createDataFrame([("f9", "add", "9", None, 1)], schema), 5)  # an old batch again changes nothing
    assert {(r.path, r.text) for r in follow.table(spark).collect()} == found
    assert len(list((tmp_path / "states").glob("state=*"))) == 2 and len(list((tmp_path / "states").glob("changes=*"))) <= 3


def test_a_long_burst(spark):
    """30,000 events of 10,000 files in one burst."""
    events = spark.range(30_000).select(F.lit("d").alias("directory"), F.concat(F.lit("f"), F.col("id") % 10_000).alias("file"), F.concat(F.lit("e"), F.floor(F.col("id") / 10_000)).alias("event"), F.timestamp_millis(F.col("id")).alias("ts"), F.col("id").alias("event_id"))
    burst = changes.debounced(events, 2).first()
    assert burst.n == 30_000 and [tuple(x) for x in burst["last"]] == [(f"f{i}", "e2") for i in range(10_000)]


@pytest.mark.parametrize("splits", ["64k", "4m"])
def test_positions_of_a_larger_table(spark, splits):
    """Ranges are drawn from samples: numbers are right at sf0.1 too."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    try:
        out = index.segment_groups(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("source", "doc_id"), ["source", "doc_id"], 300)
        rows = sorted((r.position, r.batch, r.source, r.doc_id) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[0] for r in rows] == list(range(10_000)) and all(r[1] == r[0] // 300 for r in rows)
    assert [r[2:] for r in rows] == sorted(r[2:] for r in rows)


def test_merged_streams(spark):
    one = spark.createDataFrame([("f", "add")], "file string, event string")
    assert row_set(changes.merged_streams({"x": one, "y": one}), "directory", "file") == {("x", "f"), ("y", "f")}
