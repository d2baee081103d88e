"""An index of chunks as immutable segments: a change writes what changed and nothing else.

Below one folder lie Parquet tables by segment: files, chunks and the posting
blocks of the chunks. What is gone is not rewritten but listed: file rows by
segment and path, chunk rows by segment and number, and the terms that go with
them as counts. All figures that a search needs of the whole (rows, lengths, rows
of a term) are sums over segments less such lists. A manifest names the segments
that count; it has a number and is made in one step, so of two writers one wins
and the other begins again, and a writer that dies leaves the state before.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators import clusters, search
from quarry.operators.blocks import BLOCKS, PrunedIndex, posting_blocks
from quarry.sources import places

FILES = "path string, source string, hash string, mtime long, size long"
CHUNKS = "id string, path string, source string, start_line int, end_line int, hash string, model string, text string, updated_at long, embedding array<double>, n_tokens int, docno long"
CACHE = "provider string, model string, provider_key string, hash string, embedding array<double>, dims int, updated_at long"
DEAD_FILES, DEAD_DOCS, WITHDRAWN = "seg string, path string", "seg string, docno long, id string, n_tokens int", "seg string, term string, n long"
#: What vectors are known by: the chunk's id, which ties go by, and its number.
VECTORS = "id struct<id:string,docno:bigint>, embedding array<double>, angle double, ring int, cluster int"
#: Chunks from which on a segment's vectors are dealt to clusters; fewer are scanned.
CLUSTERED = 50_000
#: Segments of about one size that become one, and how many times larger the next size is.
MERGE, TIER = 8, 4
#: Lists of what is gone that become one.
LISTS = 16
#: Tokens above which a segment's blocks are written where they are made.
SPLIT_TOKENS = 5_000_000
#: Rows that are picked by their keys; more are joined.
PICKED = 1000


class SegmentStore:
    """The segments below a folder, as of the newest manifest or of a given one."""

    def __init__(self, spark: SparkSession, home: str, manifest: dict[str, Any] | None = None):
        self.spark, self.home = spark, home.rstrip("/")
        self.manifest = self._newest() if manifest is None else manifest

    # --- manifests ---

    def _numbers(self) -> list[int]:
        names = [n[9:-5] for n in places.children(self.spark, self.home) if n.startswith("manifest-") and n.endswith(".json")]
        return sorted(int(n) for n in names if n.isdigit())

    def _load(self, number: int) -> dict[str, Any] | None:
        try:
            found = json.loads(places.read_text(self.spark, f"{self.home}/manifest-{number}.json") or "")
            return found if isinstance(found, dict) and isinstance(found.get("segments"), dict) else None
        except ValueError:
            return None

    def _newest(self) -> dict[str, Any]:
        for number in reversed(self._numbers()):
            if found := self._load(number):
                return found | {"version": number}
        return {"version": 0, "segments": {}, "lists": []}

    def publish(self, **changed: Any) -> SegmentStore:
        """The next manifest; places.Taken if another writer has made it meanwhile."""
        number = self.manifest["version"] + 1
        made = self.manifest | changed | {"version": number}
        places.create_text(self.spark, f"{self.home}/manifest-{number}.json", json.dumps(made))
        self._forget(number)
        return SegmentStore(self.spark, self.home, made)

    def _forget(self, number: int) -> None:
        """Delete what only manifests before the last two name; searches under way may still read the one before this."""
        for old in [n for n in self._numbers() if n < number - 1]:
            named = self._load(old) or {"segments": {}}
            kept = [m for n in (number - 1, number) if (m := self._load(n))]
            for seg in named["segments"]:
                if not any(seg in m["segments"] for m in kept):
                    for table in ("files", "chunks", "blocks", "vectors"):
                        places.delete(self.spark, f"{self.home}/{table}/seg={seg}")
            for at in named.get("lists", []):
                if not any(at in m["lists"] for m in kept):
                    places.delete(self.spark, f"{self.home}/lists/{at}")
            cache = named.get("cache")
            if cache and not any(m.get("cache") == cache for m in kept):
                places.delete(self.spark, f"{self.home}/{cache}")
            places.delete(self.spark, f"{self.home}/manifest-{old}.json")

    # --- tables ---

    @property
    def segments(self) -> dict[str, dict[str, int]]:
        return self.manifest["segments"]

    def _read(self, table: str, schema: str, segments: list[str] | None = None) -> DataFrame:
        names = list(self.segments) if segments is None else segments
        paths = [f"{self.home}/{table}/seg={s}" for s in names]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, seg string")
        return self.spark.read.schema(f"{schema}, seg string").option("basePath", f"{self.home}/{table}").parquet(*paths)

    def _list(self, table: str, schema: str) -> DataFrame | None:
        """What is gone from the segments that count; None if nothing is."""
        if not any(s["dead"] or s["dead_files"] for s in self.segments.values()):
            return None
        rows = self.spark.read.schema(schema).parquet(*[f"{self.home}/lists/{at}/{table}" for at in self.manifest["lists"]])
        return rows.where(F.col("seg").isin(list(self.segments)))

    def files(self, segments: list[str] | None = None) -> DataFrame:
        """FILES and seg of the files that are there."""
        rows, dead = self._read("files", FILES, segments), self._list("dead_files", DEAD_FILES)
        return rows if dead is None else rows.join(dead, ["seg", "path"], "left_anti").select(rows.columns)

    def chunks(self, segments: list[str] | None = None) -> DataFrame:
        """CHUNKS and seg of the chunks that are there."""
        rows, dead = self._read("chunks", CHUNKS, segments), self._list("dead_docs", DEAD_DOCS)
        return rows if dead is None else rows.join(dead.select("seg", "docno"), ["seg", "docno"], "left_anti").select(rows.columns)

    def cache(self) -> DataFrame:
        name = self.manifest.get("cache")
        return self.spark.read.schema(CACHE).parquet(f"{self.home}/{name}") if name else self.spark.createDataFrame([], CACHE)

    def totals(self) -> dict[str, int]:
        """files, chunks and tokens: sums over the segments."""
        of = lambda what, dead: sum(s[what] - s[dead] for s in self.segments.values())
        return {"files": of("files", "dead_files"), "chunks": of("chunks", "dead"), "tokens": of("tokens", "dead_tokens")}

    def index(self) -> PrunedIndex:
        """Keyword search over the chunks that are there."""
        dead, withdrawn = self._list("dead_docs", DEAD_DOCS), self._list("withdrawn", WITHDRAWN)
        totals = self.totals()
        blocks = self._read("blocks", f"{BLOCKS}, bucket int")
        return PrunedIndex(blocks, totals["chunks"], totals["tokens"], None if dead is None else dead.select("seg", "docno"), withdrawn, {s: v["buckets"] for s, v in self.segments.items()})

    def vector_topk(self, query: list[float], k: int) -> DataFrame:
        """seg, docno and vector_score of the best k chunks: clusters of large segments, as far as their bounds ask for it, and a scan of small ones."""
        large = [s for s, v in self.segments.items() if v.get("clustered")]
        small = [s for s in self.segments if s not in large]
        found = search.vector_topk(self.chunks(small).select("seg", "docno", "id", "embedding"), query, k).drop("embedding")
        dead = self._list("dead_docs", DEAD_DOCS)
        for seg in large:
            gone = None if dead is None else dead.where(F.col("seg") == seg).select(F.struct("id", "docno").alias("id"))
            best = clusters.VectorIndex(self.spark, f"{self.home}/vectors/seg={seg}", VECTORS).topk(query, k, without=gone)
            found = found.unionByName(best.select(F.lit(seg).alias("seg"), "id.docno", "id.id", "vector_score"))
        return found.orderBy(F.desc("vector_score"), "id").limit(k).drop("id")

    def with_chunks(self, found: DataFrame) -> DataFrame:
        """The chunks of rows (seg, docno, ...): few rows are picked by their numbers, so other row groups are passed over."""
        few = found.limit(PICKED + 1).collect()
        rows = self._read("chunks", CHUNKS)
        if len(few) > PICKED:
            return found.join(rows, ["seg", "docno"])
        mine = self.spark.createDataFrame(few, found.schema)
        if not few:
            return mine.join(rows.where(F.lit(False)), ["seg", "docno"])
        picked = F.lit(False)
        for seg in dict.fromkeys(r["seg"] for r in few):
            picked = picked | ((F.col("seg") == seg) & F.col("docno").isin([r["docno"] for r in few if r["seg"] == seg]))
        return mine.join(rows.where(picked), ["seg", "docno"])

    # --- writing ---

    def write_segment(self, files: DataFrame, chunks: DataFrame) -> tuple[str, dict[str, int]]:
        """Write FILES and chunks (CHUNKS without the last two) as a segment that nothing names yet: its name and figures.

        The blocks of a segment of few tokens are one file; those of a large one
        are not shuffled: each task writes what it made of its chunks.
        """
        seg = f"s{uuid.uuid4().hex}"
        files.write.parquet(f"{self.home}/files/seg={seg}")
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        numbered = chunks.drop("n_tokens", "docno").sortWithinPartitions("path", "start_line")
        numbered = numbered.withColumn("n_tokens", F.size(tokens(F.col("text")))).withColumn("docno", F.monotonically_increasing_id())
        numbered.select(names).write.parquet(f"{self.home}/chunks/seg={seg}")
        written = self._read("chunks", CHUNKS, [seg])
        n, length = written.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        blocks = posting_blocks(written.select("docno", tokens(F.col("text")).alias("tokens"))).drop("bucket")
        # numbers rise within a file, so a task has whole windows; its runs are sorted by term, which page indexes tell
        blocks = blocks if length > SPLIT_TOKENS else blocks.repartition(1).sortWithinPartitions("term", "window")
        blocks.write.parquet(f"{self.home}/blocks/seg={seg}/bucket=0")
        count = self._read("files", FILES, [seg]).count()
        clustered = n >= CLUSTERED and bool(written.where(F.size("embedding") > 0).limit(1).count())
        if clustered:
            clusters.build(written.select(F.struct("id", "docno").alias("id"), "embedding"), f"{self.home}/vectors/seg={seg}")
        return seg, {"files": count, "chunks": n, "tokens": int(length), "buckets": 1, "clustered": int(clustered), "dead": 0, "dead_tokens": 0, "dead_files": 0}

    def write_lists(self, dead_files: DataFrame, dead_chunks: DataFrame) -> tuple[str, dict[str, dict[str, int]]]:
        """Write what goes: file rows (seg, path) and chunk rows with their terms. The list's name and the segments' new figures."""
        at = f"l{uuid.uuid4().hex}"
        place = f"{self.home}/lists/{at}"
        dead_files.select("seg", "path").write.parquet(f"{place}/dead_files")
        going = dead_chunks.select("seg", "docno", "id", "n_tokens", F.array_distinct(tokens(F.col("text"))).alias("terms"))
        going.write.parquet(f"{place}/going")
        going = self.spark.read.schema(going.schema).parquet(f"{place}/going")
        going.select("seg", "docno", "id", "n_tokens").write.parquet(f"{place}/dead_docs")
        terms = going.select("seg", F.explode("terms").alias("term")).groupBy("seg", "term").agg(F.count(F.lit(1)).alias("n"))
        terms.sortWithinPartitions("term").write.parquet(f"{place}/withdrawn")
        sums = {s: dict(v) for s, v in self.segments.items()}
        for r in going.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect():
            sums[r["seg"]]["dead"] += r["n"]
            sums[r["seg"]]["dead_tokens"] += r["t"]
        for r in self.spark.read.schema(DEAD_FILES).parquet(f"{place}/dead_files").groupBy("seg").agg(F.count(F.lit(1)).alias("n")).collect():
            sums[r["seg"]]["dead_files"] += r["n"]
        places.delete(self.spark, f"{place}/going")
        return at, sums

    def to_merge(self) -> list[str]:
        """The segments that are half gone, and those of a size of which there are many."""
        there = {s: v["chunks"] - v["dead"] for s, v in self.segments.items()}
        picked = {s for s, v in self.segments.items() if 2 * (v["dead"] + v["dead_files"]) > v["chunks"] + v["files"]}
        tiers: dict[int, list[str]] = {}
        for s, n in there.items():
            tiers.setdefault(int(math.log(max(n, 1), TIER)) if n > 256 else 0, []).append(s)
        for same in tiers.values():
            picked |= set(same) if len(same) >= MERGE else set()
        return [s for s in self.segments if s in picked]

    def compacted(self) -> SegmentStore:
        """The store after segments and lists that call for it were merged; itself if none do. Others' rows are not touched."""
        picked = self.to_merge()
        if not picked and len(self.manifest["lists"]) < LISTS:
            return self
        rest = {s: v for s, v in self.segments.items() if s not in picked}
        made = {}
        if picked:
            columns = [c.split()[0] for c in FILES.split(", ")]
            seg, figures = self.write_segment(self.files(picked).select(columns), self.chunks(picked))
            made = {seg: figures} if figures["files"] or figures["chunks"] else {}
        lists = []
        if any(v["dead"] or v["dead_files"] for v in rest.values()):
            at = f"l{uuid.uuid4().hex}"
            for table, schema in (("dead_files", DEAD_FILES), ("dead_docs", DEAD_DOCS), ("withdrawn", WITHDRAWN)):
                rows = self._list(table, schema).where(F.col("seg").isin(list(rest)))
                (rows.groupBy("seg", "term").agg(F.sum("n").alias("n")) if table == "withdrawn" else rows).write.parquet(f"{self.home}/lists/{at}/{table}")
            lists = [at]
        return self.publish(segments=rest | made, lists=lists)
