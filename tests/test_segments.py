from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.facade import Memory, offline
from quarry.operators import blocks, search, segments
from quarry.operators.embed import DeterministicProvider
from quarry.sources import places

WORDS = ["alpha", "beta", "gamma", "delta", "the", "the", "the", "of", "of", "rare", "café", "plan"]
QUERIES = ["the", "the of", "rare", "alpha beta", "of_the", "the_of rare", "the the", "absent", "cafe plan", "rare_absent", "", "_"]


def text(rng, n=60):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for _ in range(n))


def scan(m, query, k):
    """The best k chunks by a scan of all: (path, start, rank)."""
    found = search.keyword_topk(search.with_tokens(m.table("chunks")), query, k)
    return [(r.path, r.start_line, round(r["rank"], 9)) for r in found.collect()]


def pruned(m, query, k):
    store = m.store()
    found = store.with_chunks(store.index().topk(query, k)).orderBy("rank", "id").limit(k)
    return [(r.path, r.start_line, round(r["rank"], 9)) for r in found.collect()]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    (tmp_path / "memory").mkdir()
    for i in range(12):
        (tmp_path / "memory" / f"f{i}.md").write_text(text(rng))
    return tmp_path


def written(folder):
    return {p for p in folder.rglob("*.parquet")}


def test_changes_write_what_changed(spark, folder, monkeypatch):
    """Adds, edits, touches, deletes and merges: ranks and rows are those of an index made anew."""
    monkeypatch.setattr(segments, "MERGE", 3)
    rng = random.Random(2)
    m = Memory(spark, str(folder), chunking={"tokens": 32, "overlap": 4})
    assert m.sync() == {"new": 12}
    first = m.store().segments
    assert m.sync() == {"unchanged": 12} and m.store().manifest["version"] == 1
    for step in range(3):
        before, n_chunks = written(folder), m.store().totals()["chunks"]
        kept = {r.path: r.updated_at for r in m.table("chunks").collect()}
        (folder / "memory" / f"f{step}.md").write_text(text(rng, 50))
        (folder / "memory" / f"[{step}] new?.md").write_text(text(rng, 5))
        os.utime(folder / "memory" / "f11.md", (1000 + step, 1000 + step))
        gone = {"deleted": 1} if step % 2 else {}
        if gone:
            (folder / "memory" / f"[{step - 1}] new?.md").unlink()
        assert m.sync() == {"changed": 1, "new": 1, "unchanged": 11 + step // 2} | gone
        if step == 0:
            new = written(folder) - before
            assert not any(str(p).split("seg=")[1].startswith(s) for p in new if "seg=" in str(p) for s in first)
            chunk_files = [p for p in new if "/chunks/" in str(p)]
            assert sum(len(spark.read.parquet(str(p)).collect()) for p in chunk_files) < n_chunks // 3
        now = {r.path: r.updated_at for r in m.table("chunks").collect()}
        assert all(now[p] == kept[p] for p in now if p in kept and p != f"memory/f{step}.md")
        for query in ("the", "of_the", "the_of rare", "absent") if step == 2 else ("the_of rare",):
            assert pruned(m, query, 7) == scan(m, query, 7)
        totals = m.store().totals()
        assert totals["files"] == len(m.list_files()) == m.table("files").count()
        assert totals["chunks"] == m.table("chunks").count() and totals["tokens"] == m.table("chunks").agg(F.sum("n_tokens")).first()[0]
    assert len(m.store().segments) < 5
    with_index = sorted((r.path, r.start_line, r.hash) for r in m.table("chunks").collect())
    m.sync(force=True)
    assert sorted((r.path, r.start_line, r.hash) for r in m.table("chunks").collect()) == with_index and len(m.store().segments) == 1
    # what older manifests named is deleted
    assert len(places.children(spark, f"{folder}/.quarry/chunks")) <= 2 + segments.MERGE and len(places.children(spark, f"{folder}/.quarry/lists")) <= segments.LISTS


def test_a_sync_that_dies_leaves_the_state_before(spark, folder, monkeypatch):
    m = Memory(spark, str(folder))
    m.sync()
    want = pruned(m, "the of", 5)
    (folder / "memory" / "f0.md").unlink()
    (folder / "memory" / "f1.md").write_text("rare plan " * 50)

    def dies(*args, **more):
        raise OSError("no space")

    for step in ("write_segment", "write_lists", "publish"):
        with monkeypatch.context() as patch:
            patch.setattr(segments.SegmentStore, step, dies)
            with pytest.raises(OSError):
                m.sync()
        assert pruned(m, "the of", 5) == want and m.store().manifest["version"] == 1 and m.is_stale()
    assert m.sync() == {"changed": 1, "deleted": 1, "unchanged": 10} and pruned(m, "the of", 5) == scan(m, "the of", 5)


def test_two_syncs_at_a_time(spark, folder, monkeypatch):
    """The slower one begins again from the state of the faster one; nothing is lost or twice there."""
    m = Memory(spark, str(folder))
    m.sync()
    (folder / "memory" / "f0.md").write_text("rare plan")
    other, write = Memory(spark, str(folder)), segments.SegmentStore.write_segment
    inside = []

    def slow(self, *args):
        if not inside:
            inside.append(True)
            (folder / "memory" / "late.md").write_text("rare rare")
            assert other.sync()["new"] == 1
        return write(self, *args)

    monkeypatch.setattr(segments.SegmentStore, "write_segment", slow)
    assert m.sync() == {"unchanged": 13}
    assert sorted(r.path for r in m.table("files").collect()) == m.list_files() and pruned(m, "rare", 9) == scan(m, "rare", 9)


def test_vectors_of_large_segments_lie_in_clusters(spark, folder, monkeypatch):
    """A clustered segment, its deleted rows and a small one: the rows of a scan, ties by id."""
    monkeypatch.setattr(segments, "CLUSTERED", 100)
    m = offline(spark, str(folder), chunking={"tokens": 32, "overlap": 4}, query={"minScore": 0.0})
    m.sync()
    (folder / "memory" / "f0.md").write_text((folder / "memory" / "f1.md").read_text())
    (folder / "memory" / "f2.md").unlink()
    m.sync()
    store = m.store()
    assert [v["clustered"] for v in store.segments.values()] == [1, 0]
    for query in ("rare plan", "the of the", "zzz"):
        q = m.provider.embed_query(query)
        want = search.vector_topk(m.table("chunks"), q, 9).collect()
        found = store.with_chunks(store.vector_topk(q, 9)).orderBy(F.desc("vector_score"), "id").collect()
        assert [(r.id, r.path) for r in found] == [(r.id, r.path) for r in want] and len(found) == 9
    assert m.search("rare plan", 3) and store.vector_topk([], 5).count() == 0


def test_damaged_manifest_and_another_service(spark, folder):
    class Service(DeterministicProvider):
        url = "https://one"

    m = Memory(spark, str(folder), Service())
    m.sync()
    assert m.sync() == {"unchanged": 12}
    Service.url = "https://two"
    assert m.provider_key() != Memory(spark, str(folder), DeterministicProvider()).provider_key()
    m.sync()
    assert m.store().manifest["version"] == 2 and {r.provider_key for r in m.table("cache").collect()} >= {m.provider_key()}
    (folder / ".quarry" / "manifest-3.json").write_text("{")
    assert m.store().manifest["version"] == 2
    with pytest.raises(places.Taken):
        m.store().publish()


def test_listing_opens_no_file(spark, folder):
    m = Memory(spark, str(folder))
    plan = m._listed()._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert not m.store().manifest["version"] and m.is_stale()


@pytest.mark.parametrize("k", [1, 3, 10, 10_000])
@pytest.mark.parametrize("query", QUERIES[:8])
def test_pruned_topk_equals_the_scan(spark, tmp_path_factory, k, query):
    rows = spark.range(6000).select(F.col("id"), F.concat_ws(" ", *[F.when(F.xxhash64("id", F.lit(i)) % (3 + 5 * i) == 0, F.repeat(F.lit(f"{w} "), (F.pmod(F.xxhash64("id", F.lit(w)), F.lit(i + 1)) + 1).cast("int"))) for i, w in enumerate(dict.fromkeys(WORDS))]).alias("text"))
    place = f"{tmp_path_factory.getbasetemp()}/blocks"
    if not os.path.isdir(place):
        blocks.posting_blocks(search.with_tokens(rows).select(F.col("id").alias("docno"), "tokens")).write.parquet(place)
    tokenised = search.with_tokens(rows)
    n, total = tokenised.agg(F.count("id"), F.sum(F.size("tokens"))).first()
    index = blocks.PrunedIndex(spark.read.parquet(place).withColumn("seg", F.lit("s")), n, total)
    found = index.topk(query, k).orderBy("rank", "docno").limit(k)
    want = search.keyword_topk(tokenised, query, k)
    assert [(r.docno, pytest.approx(r["rank"])) for r in found.collect()] == [(r.id, r["rank"]) for r in want.collect()]
    assert index.read["read"] <= index.read["windows"]


def test_blocks_are_left_unread(spark):
    """One window has all the good rows; the others are told by their headers."""
    rows = spark.range(100_000).select(F.col("id").alias("docno"), F.when(F.col("id") < 900, F.split(F.lit("rare rare rare"), " ")).otherwise(F.split(F.lit("rare of a long row of other words"), " ")).alias("tokens"))
    index = blocks.PrunedIndex(blocks.posting_blocks(rows).withColumn("seg", F.lit("s")), 100_000, 99_100 * 8 + 900 * 3)
    assert index.topk("rare", 10).count() == 900 and index.read["windows"] == 98 and index.read["read"] == blocks.FIRST_WINDOWS
