"""Keeping an index of files and chunks: what changed, what is stale, the embedding cache.

All are joins of slim tables on path or hash; contents are moved for files that
changed only. Tables are never overwritten where they are read: `replaced`
gives the next state, which is written to a new place.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.chunking import OVERLAP, TOKENS, chunked
from quarry.functions.text import text_hash
from quarry.session import passing_path

SCHEMA_VERSION = 2
META_KEY = "memory_index_meta_v1"
CACHE_KEYS = ["provider", "model", "provider_key", "hash"]


@dataclass(frozen=True)
class IndexMeta:
    """With what settings an index was made."""

    model: str
    provider: str
    provider_key: str | None = None
    chunk_tokens: int = TOKENS
    chunk_overlap: int = OVERLAP
    vector_dims: int | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def read_meta(value: str | None) -> IndexMeta | None:
    """The settings of a stored JSON value; None for a missing or damaged one."""
    try:
        found = json.loads(value or "")
        return IndexMeta(**{k: found[k] for k in IndexMeta.__dataclass_fields__ if k in found})
    except (ValueError, TypeError, KeyError):
        return None


def needs_full_reindex(stored: IndexMeta | None, wanted: IndexMeta, force: bool = False, vectors: bool = False) -> bool:
    """Whether nothing stored can be kept: forced, unknown, or made with other settings. Vectors ask for dims only where there are vectors."""
    if force or stored is None:
        return True
    same = (stored.model, stored.provider, stored.provider_key, stored.chunk_tokens, stored.chunk_overlap) == (wanted.model, wanted.provider, wanted.provider_key, wanted.chunk_tokens, wanted.chunk_overlap)
    return not same or (vectors and wanted.vector_dims is not None and stored.vector_dims is None)


def reindex_needed(force: Column, stored: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """`needs_full_reindex` over columns."""
    out = force
    for key, value in wanted.items():
        out = out | ~stored[key].eqNullSafe(value)
    return out


def file_entries(files: DataFrame, path: str = "path", text: str = "text", source: str = "memory") -> DataFrame:
    """path, source, hash, mtime (whole milliseconds) and size of each file."""
    mtime = F.floor(F.col("mtime")).cast("long") if "mtime" in files.columns else F.lit(0).cast("long")
    return files.select(F.col(path).alias("path"), F.lit(source).alias("source"), text_hash(F.coalesce(F.col(text), F.lit(""))).alias("hash"), mtime.alias("mtime"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"))


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path and status (new, changed, unchanged, deleted) of every path on either side."""
    c = current.select(F.col("path").alias("c_path"), F.col("hash").alias("c_hash"))
    s = stored.select(F.col("path").alias("s_path"), F.col("hash").alias("s_hash"))
    status = F.when(F.col("s_path").isNull(), "new").when(F.col("c_path").isNull(), "deleted").when(F.col("c_hash") == F.col("s_hash"), "unchanged").otherwise("changed")
    return c.join(s, F.col("c_path") == F.col("s_path"), "full_outer").select(F.coalesce("c_path", "s_path").alias("path"), status.alias("status"))


def is_stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: whether a file was added, removed or has another modification time."""
    c = current.select(F.col("path").alias("c_path"), F.col("mtime").alias("c_mtime"))
    s = stored.select(F.col("path").alias("s_path"), F.col("mtime").alias("s_mtime"))
    differs = ~F.col("c_path").eqNullSafe(F.col("s_path")) | ~F.col("c_mtime").eqNullSafe(F.col("s_mtime"))
    return c.join(s, F.col("c_path") == F.col("s_path"), "full_outer").agg(F.coalesce(F.bool_or(differs), F.lit(False)).alias("stale"), F.sum(differs.cast("long")).alias("n_differing"))


def to_index(files: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """The files whose path and hash are not stored."""
    if full:
        return files
    hashed = files.withColumn("_hash", text_hash(F.coalesce(F.col("text"), F.lit(""))))
    return hashed.join(stored.select("path", F.col("hash").alias("_hash")), ["path", "_hash"], "left_anti").drop("_hash")


def without_stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The stored rows (files or chunks) whose path is still there."""
    return stored.join(current.select("path").distinct(), "path", "left_semi")


def replaced(stored: DataFrame, new: DataFrame, keys: list[str] | str = "path") -> DataFrame:
    """Stored rows with the rows of `new` in place of those that agree in the keys."""
    keys = [keys] if isinstance(keys, str) else keys
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def chunk_rows(files: DataFrame, model: str, now: int, source: str = "memory", tokens: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """The chunk table's rows of some files (path, text); the id is a hash of path and place."""
    parts = chunked(files, "text", tokens, overlap, ("path",))
    return parts.select(
        F.sha2(F.concat_ws(":", "path", F.col("ordinal").cast("string"), F.lit(model)), 256).alias("id"), "path", F.lit(source).alias("source"), "start_line", "end_line", "hash",
        F.lit(model).alias("model"), "text", F.lit(now).cast("long").alias("updated_at"),
    )


def cache_hits(chunks: DataFrame, cache: DataFrame, provider: str, model: str, provider_key: str) -> DataFrame:
    """hash and embedding of the chunk hashes that are cached."""
    mine = cache.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("provider_key") == provider_key))
    return mine.join(chunks.select("hash").distinct(), "hash", "left_semi").select("hash", "embedding")


def cache_misses(chunks: DataFrame, cache: DataFrame, provider: str, model: str, provider_key: str) -> DataFrame:
    """hash and text, once, of the chunks that have to be embedded."""
    mine = cache.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("provider_key") == provider_key)).select("hash")
    return chunks.join(mine, "hash", "left_anti").groupBy("hash").agg(F.min("text").alias("text"))


def cache_upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with one row per key, the newest."""
    rest = [c for c in cache.columns if c not in CACHE_KEYS]
    both = cache.unionByName(new.select(cache.columns))
    newest = both.groupBy(*CACHE_KEYS).agg(F.max_by(F.struct(*rest), "updated_at").alias("_r"))
    return newest.select(*CACHE_KEYS, "_r.*").select(cache.columns)


def cache_touched(cache: DataFrame, hashes: DataFrame, now: int) -> DataFrame:
    """The cache with `updated_at` set to now where a hash was hit."""
    hit = hashes.select("hash").distinct().withColumn("_hit", F.lit(True))
    touched = F.when(F.col("_hit"), F.lit(now).cast("long")).otherwise(F.col("updated_at"))
    return cache.join(hit, "hash", "left").withColumn("updated_at", touched).select(cache.columns)


#: Rows up to which the newest are sorted out by every task and then in one.
ONE_TASK = 100_000
#: Parts that a range of times is cut into, again and again, to find the last row that stays.
PARTS = 1024


def cache_pruned(cache: DataFrame, max_entries: int) -> DataFrame:
    """The `max_entries` newest rows; of one time, the first by their keys."""
    if max_entries <= ONE_TASK:
        return cache.orderBy(F.desc("updated_at"), *CACHE_KEYS).limit(max_entries)
    return newest(cache, max_entries, "updated_at", CACHE_KEYS)


def newest(table: DataFrame, n: int, when: str, keys: list[str]) -> DataFrame:
    """The `n` rows with the largest `when` (long), ties by `keys`; null times come last. For any n, as no task gets them all.

    Counts by parts of the range of times narrow it down to a part with few rows
    or of one time; each is a scan of that column, and 1024 numbers. Rows above
    are taken where they are. What is still wanted is counted off in order over ranges.
    """
    at = F.col(when)
    total, lo, hi = table.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
    if total <= n:
        return table
    wanted, dated = n, lo is not None
    if dated:
        known = table.where(at.isNotNull()).count()
        dated = known > n
        wanted = n if dated else n - known
    while dated and lo < hi:
        width = (hi - lo) // PARTS + 1
        part = F.floor((F.lit(hi) - at) / width).cast("int") if hi - lo < 1 << 52 else ((F.lit(hi).cast("decimal(20,0)") - at.cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("decimal(20,0)").cast("int")
        counts = {r["p"]: (r["n"], r["lo"], r["hi"]) for r in table.where(at.between(lo, hi)).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).collect()}
        for p in sorted(counts):
            count, lo, hi = counts[p]
            if count >= wanted:
                break
            wanted -= count
        if count <= ONE_TASK:
            break
    above = table.where(at > hi) if dated else table.where(at.isNotNull())
    edge = table.where(at.between(lo, hi)) if dated else table.where(at.isNull())
    numbered = segment_groups(edge.withColumn("_late", F.lit(1) if not dated else -at), ["_late", *keys])
    return above.unionByName(numbered.where(F.col("position") < wanted).select(table.columns))


def embedded(chunks: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each chunk with its embedding, from the cache or just made."""
    known = cached.select("hash", "embedding").unionByName(fresh.select("hash", "embedding"))
    return chunks.join(known, "hash", "left")


def status(files: DataFrame, chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """One row of counts."""
    sums = files.agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("what"), "n")
    for what, table in (("chunks", chunks), ("cache", cache)):
        sums = sums.unionByName(table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n"))
    return sums


def migrated(table: DataFrame, columns: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """`table` with the columns a newer schema has, filled with defaults."""
    return table.select("*", *[F.lit(defaults.get(c)).cast(kind).alias(c) for c, kind in columns.items() if c not in table.columns])


def segment_groups(requests: DataFrame, order: list[str], size: int = 50_000) -> DataFrame:
    """Requests numbered in order, in groups of at most `size`, as batch interfaces take them.

    Rows are dealt to ranges of the order and written with their range, once: a
    second run would sample other ranges. Each range is then numbered from the
    rows in the ranges before it, so no task gets all rows. Rows that are equal
    in `order` are numbered in any order.
    """
    spark = requests.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = passing_path(spark, "ranges")
    ranges = requests.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    ranges.write.parquet(path)
    dealt = spark.read.schema(ranges.schema).parquet(path)
    counts = {r["_p"]: r["n"] for r in dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, at = {}, 0
    for p in sorted(counts):
        start[p], at = at, at + counts[p]
    if not start:
        return requests.select("*", F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("batch"))
    base = F.element_at(F.create_map(*[F.lit(v) for p in start for v in (p, start[p])]), F.col("_p"))
    here = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("position", (base + here - 1).cast("long")).drop("_p").withColumn("batch", F.floor(F.col("position") / size).cast("long"))
