"""A memory folder as one object: sync, search, read, write."""

from __future__ import annotations

import datetime as dt
import hashlib
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config as settings
from quarry.functions import frontmatter
from quarry.functions.paths import may_be_written
from quarry.functions.text import snippet
from quarry.operators import index, search
from quarry.operators.embed import DeterministicProvider, NoProvider, Provider, embed_missing, query_vector
from quarry.operators.segments import CACHE, SegmentStore
from quarry.session import shared_path
from quarry.sources import places
from quarry.sources.files import HIDDEN, memory_files

#: Changed files that are opened by their names; if more changed, the folder is read.
NAMED_FILES = 10_000
#: How often a sync begins again because another one was faster.
ATTEMPTS = 5


class InvalidPath(ValueError):
    """A path that must not be written."""


class Memory:
    """A folder of Markdown files with an index of its chunks.

    The index is a store of segments below the hidden folder. A sync writes the
    files and chunks that changed as one more segment, lists what is gone, and
    then makes the next manifest. A sync that fails half way leaves the old
    state; of two at a time the slower one begins again from the other's state.
    """

    def __init__(self, spark: SparkSession, folder: str, provider: Provider | None = None, **config: Any):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.config = settings.merged(settings.DEFAULTS, config)
        self.provider = provider if provider is not None else NoProvider()
        self.home = f"{self.folder}/{HIDDEN}"

    # --- files of the folder, through the file system that Spark knows ---

    def read_file(self, name: str) -> str | None:
        """A file's text; None if it isn't there."""
        return places.read_text(self.spark, f"{self.folder}/{name}")

    def read_lines(self, name: str, first: int = 1, count: int | None = None) -> dict[str, Any] | None:
        """content, start_line and end_line of some lines; lines count from 1."""
        text = self.read_file(name)
        if text is None:
            return None
        first = max(1, first)
        lines = text.split("\n")[first - 1 :]
        lines = lines if count is None else lines[:count]
        return {"content": "\n".join(lines), "start_line": first, "end_line": first - 1 + len(lines)}

    def _write(self, name: str, text: str) -> None:
        places.replace_text(self.spark, f"{self.folder}/{name}", text)

    def check_path(self, name: str) -> None:
        if not self.spark.range(1).select(may_be_written(F.lit(name))).first()[0]:
            raise InvalidPath(name)

    def write_file(self, name: str, text: str, session: dict[str, str | None] | None = None) -> None:
        """Write a file; with a session (id, source, project) its head says where it comes from, over a head that is there."""
        self.check_path(name)
        if session is not None:
            of = F.struct(*[F.lit(session.get(k)).cast("string").alias(k) for k in frontmatter.SESSION_KEYS])
            now = dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            text = self.spark.range(1).select(frontmatter.merged(F.lit(text), of, F.lit(None).cast("array<string>"), F.lit(now), str(Path.home()))).first()[0]
        self._write(name, text)

    def append_file(self, name: str, text: str) -> None:
        """Add a text on a line of its own."""
        self.check_path(name)
        old = self.read_file(name)
        gap = "\n" if old and not old.endswith("\n") else ""
        self._write(name, (old or "") + gap + text)

    def append_today(self, text: str, today: dt.date | None = None) -> str:
        """Add a text to the day's file (UTC) and give its name."""
        name = f"memory/{(today or dt.datetime.now(dt.UTC).date()).isoformat()}.md"
        self.append_file(name, text)
        return name

    def list_files(self) -> list[str]:
        return sorted(r["path"] for r in memory_files(self.spark, self.folder).select("path").collect())

    # --- index ---

    def store(self) -> SegmentStore:
        """The index as it is now."""
        return SegmentStore(self.spark, self.home)

    def table(self, name: str) -> DataFrame:
        """files, chunks or cache."""
        return getattr(self.store(), name)()

    def meta(self) -> index.IndexMeta:
        c = self.config["chunking"]
        return index.IndexMeta(self.provider.model, self.provider.id, self.provider_key(), c["tokens"], c["overlap"])

    def provider_key(self) -> str:
        """A hash of all that vectors depend on: provider, model and, for a service, its address."""
        parts = [self.provider.id, self.provider.model, getattr(self.provider, "url", "")]
        return hashlib.sha256(":".join(filter(None, parts)).encode()).hexdigest()

    def _listed(self) -> DataFrame:
        """path, mtime and size of the folder's files, none of which is opened."""
        return memory_files(self.spark, self.folder).select("path", F.floor("mtime").cast("long").alias("mtime"), "size")

    def is_stale(self) -> bool:
        return bool(index.is_stale(self._listed(), self.table("files")).first()["stale"])

    def sync(self, force: bool = False, verify: bool = False) -> dict[str, int]:
        """Bring the index up to date; what is unchanged is neither cut nor embedded nor written again.

        A file whose time and size are as they were is taken to be unchanged;
        `verify` reads all files instead, `force` makes everything anew.
        """
        for attempt in range(ATTEMPTS):
            try:
                return self._synced(self.store(), force, verify)
            except places.Taken:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError

    def _synced(self, store: SegmentStore, force: bool, verify: bool) -> dict[str, int]:
        spark, now, wanted = self.spark, int(time.time() * 1000), self.meta()
        full = index.needs_full_reindex(index.read_meta(store.manifest.get("meta")), wanted, force)
        passing = shared_path(spark, "sync")
        # what may have changed, by names, times and sizes
        found = self._listed().select(F.col("path").alias("f_path"), F.col("mtime").alias("f_mtime"), F.col("size").alias("f_size"))
        known = store.files().select(F.col("path").alias("k_path"), F.col("hash").alias("old_hash"), F.col("mtime").alias("k_mtime"), F.col("size").alias("k_size"), F.col("seg").alias("old_seg"))
        same = F.lit(not (full or verify)) & F.col("f_mtime").eqNullSafe(F.col("k_mtime")) & F.col("f_size").eqNullSafe(F.col("k_size"))
        moves = found.join(known, F.col("f_path") == F.col("k_path"), "full_outer").select(F.coalesce("f_path", "k_path").alias("path"), "old_hash", "old_seg", F.col("f_path").isNull().alias("gone"), same.alias("same"))
        moves.where(~F.col("same")).drop("same").write.parquet(f"{passing}/moves")
        moves = spark.read.schema("path string, old_hash string, old_seg string, gone boolean").parquet(f"{passing}/moves")
        n_read, n_gone = moves.agg(F.count_if(~F.col("gone")), F.count_if("gone")).first()
        counts = {"deleted": n_gone, "unchanged": store.totals()["files"] - n_gone}
        if n_read + n_gone == 0 and not full:
            places.delete(spark, passing)
            return {k: v for k, v in counts.items() if v}
        # their contents, read once
        named = [r["path"] for r in moves.where(~F.col("gone")).select("path").collect()] if n_read <= NAMED_FILES else None
        texts = memory_files(spark, self.folder, named).select("path", F.lit("memory").alias("source"), "hash", F.floor("mtime").cast("long").alias("mtime"), "size", "text")
        status = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("hash"), "unchanged").otherwise("changed")
        incoming = texts.join(moves.where(~F.col("gone")).drop("gone"), "path").withColumn("status", status)
        incoming.write.parquet(f"{passing}/incoming")
        incoming = spark.read.schema(incoming.schema).parquet(f"{passing}/incoming")
        for r in incoming.groupBy("status").count().collect():
            counts[r["status"]] = r["count"] if r["status"] != "unchanged" else counts["unchanged"]
        counts["unchanged"] -= counts.get("changed", 0)
        fresh = incoming if full else incoming.where("status <> 'unchanged'")
        c = self.config["chunking"]
        new = index.chunk_rows(fresh, wanted.model, now, tokens=c["tokens"], overlap=c["overlap"])
        new, cache = self._embedded(new, store, wanted, now, passing)
        seg, figures = store.write_segment(incoming.select("path", "source", "hash", "mtime", "size"), new)
        segments, lists = ({seg: figures}, []) if full else (store.segments | {seg: figures}, store.manifest["lists"])
        if not full and moves.where(F.col("old_seg").isNotNull()).limit(1).count():
            going = moves.where("gone").select("path").unionByName(incoming.where("status = 'changed'").select("path"))
            dead = store.chunks().join(going, "path", "left_semi")
            at, sums = store.write_lists(moves.where(F.col("old_seg").isNotNull()).select(F.col("old_seg").alias("seg"), "path"), dead)
            segments, lists = sums | {seg: figures}, [*store.manifest["lists"], at]
        done = store.publish(segments={s: v for s, v in segments.items() if v["files"] or v["chunks"]}, lists=lists, cache=cache, meta=wanted.to_json(), schema=index.SCHEMA_VERSION)
        places.delete(spark, passing)
        try:
            done.compacted()
        except places.Taken:
            pass  # another sync is at it; the next one merges
        return {k: v for k, v in counts.items() if v}

    def _embedded(self, new: DataFrame, store: SegmentStore, wanted: index.IndexMeta, now: int, passing: str) -> tuple[DataFrame, str | None]:
        """Chunks with their vectors, from the cache or just made, and the folder of the next cache."""
        if self.provider.id == "none":
            return new.withColumn("embedding", F.array().cast("array<double>")), store.manifest.get("cache")
        spark, cache = self.spark, store.cache()
        who = (wanted.provider, wanted.model, wanted.provider_key)
        missing = index.cache_misses(new, cache, *who)
        made = embed_missing(missing, self.provider).select(*[F.lit(v).alias(k) for k, v in zip(index.CACHE_KEYS, who, strict=False)], "hash", "embedding", F.size("embedding").alias("dims"), F.lit(now).cast("long").alias("updated_at"))
        made.write.parquet(f"{passing}/embedded")
        made = spark.read.schema(CACHE).parquet(f"{passing}/embedded")
        hits = index.cache_hits(new, cache, *who)
        name = f"cache-{uuid.uuid4().hex}"
        index.cache_pruned(index.cache_upserted(index.cache_touched(cache, hits, now), made), self.config["cache"]["maxEntries"]).write.parquet(f"{self.home}/{name}")
        return index.embedded(new, hits, made), name

    def status(self) -> dict[str, Any]:
        store = self.store()
        totals = store.totals()
        return {"files": totals["files"], "chunks": totals["chunks"], "cache": store.cache().count(), "provider": self.provider.id, "model": self.provider.model, "stale": self.is_stale(), "schema": index.SCHEMA_VERSION}

    # --- search ---

    def results(self, query: str, max_results: int | None = None, min_score: float | None = None) -> DataFrame:
        """path, start_line, end_line, score and snippet of the best chunks, as a table."""
        h, q = self.config["hybrid"], self.config["query"]
        max_results = q["maxResults"] if max_results is None else max_results
        min_score = q["minScore"] if min_score is None else min_score
        # all chunks are of this provider's model: another one makes the index anew
        store = self.store()
        limit = search.candidate_count(max_results, h["candidateMultiplier"])
        out = ["path", "start_line", "end_line", "score", "snippet"]
        near = store.vector_topk(query_vector(self.provider, query) if query.strip() else [], limit)
        vector = store.with_chunks(near).withColumn("snippet", snippet(F.col("text")))
        if not h["enabled"]:
            return search.best(vector.withColumn("score", F.col("vector_score")).withColumn("text_score", F.lit(None).cast("double")), max_results, min_score).select(out)
        ranked = store.with_chunks(store.index().topk(query, limit)).orderBy("rank", "id").limit(limit)
        words = ranked.withColumn("text_score", search.rank_to_score(F.col("rank"))).withColumn("snippet", snippet(F.col("text")))
        return search.best(search.merge_hybrid(vector, words, h["vectorWeight"], h["textWeight"]), max_results, min_score).select(out)

    def search(self, query: str, max_results: int | None = None, min_score: float | None = None) -> list[dict[str, Any]]:
        """The best chunks; the index is brought up to date first. A blank query has no results."""
        if self.is_stale() or not self.store().manifest["version"]:
            self.sync()
        if not query.strip():
            return []
        return [r.asDict() for r in self.results(query, max_results, min_score).collect()]


def offline(spark: SparkSession, folder: str, **config: Any) -> Memory:
    """A memory with deterministic vectors."""
    return Memory(spark, folder, DeterministicProvider(), **config)
