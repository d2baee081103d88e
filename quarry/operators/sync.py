"""Two-sided file sets: status, plans, state; the mapping registry; logs and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import quarantine_time, quarantined_file, repository_path

LOG_ENTRIES = 1000
STALE_DAYS = 30


def sync_status(local: Column, remote: Column) -> Column:
    """The status of two hashes: files that differ count as changed here, whichever side changed."""
    return F.when(local.eqNullSafe(remote), "unchanged").when(remote.isNull(), "local-only").when(local.isNull(), "remote-only").otherwise("local-modified")


def changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """file, status, local_hash and remote_hash of all files of either side (file, hash)."""
    a = local.select(F.col("file").alias("l_file"), F.col("hash").alias("local_hash"))
    b = remote.select(F.col("file").alias("r_file"), F.col("hash").alias("remote_hash"))
    both = a.join(b, F.col("l_file") == F.col("r_file"), "full_outer")
    return both.select(F.coalesce("l_file", "r_file").alias("file"), sync_status(F.col("local_hash"), F.col("remote_hash")).alias("status"), "local_hash", "remote_hash")


def summary(changed: DataFrame) -> DataFrame:
    """One row: how many files have each status."""
    return changed.agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("unchanged", "local-only", "remote-only", "local-modified")])


def push_plan(changed: DataFrame) -> DataFrame:
    """What a push does to each file: files of this side are pushed, others skipped; nothing is deleted."""
    action = F.when(F.col("status").isin("local-only", "local-modified"), "push").when(F.col("status") == "remote-only", "skip").otherwise("none")
    return changed.select("file", "status", action.alias("action"))


def pull_plan(changed: DataFrame, force: bool = False) -> DataFrame:
    """What a pull does: new files are pulled, changed ones only by force."""
    take = ["remote-only", "local-modified"] if force else ["remote-only"]
    action = F.when(F.col("status").isin(take), "pull").when(F.col("status").isin("local-modified", "local-only"), "skip").otherwise("none")
    return changed.select("file", "status", action.alias("action"))


def after_push(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The other side's files after a push."""
    return remote.join(local.select("file"), "file", "left_anti").unionByName(local.select(remote.columns))


def bidirectional_plan(changed: DataFrame) -> DataFrame:
    """Push, then pull: what is on this side goes over, so only files that are new there come back."""
    action = F.when(F.col("status").isin("local-only", "local-modified"), "push").when(F.col("status") == "remote-only", "pull").otherwise("none")
    return changed.select("file", "status", action.alias("action"))


def built_state(local: DataFrame, remote: DataFrame, now: str) -> DataFrame:
    """file, local_hash, remote_hash (empty for a missing side) and last_modified: this side's, else the other's, else now."""
    a = local.select(F.col("file").alias("l_file"), F.col("hash").alias("l_hash"), F.col("mtime").alias("l_mtime"))
    b = remote.select(F.col("file").alias("r_file"), F.col("hash").alias("r_hash"), F.col("mtime").alias("r_mtime"))
    both = a.join(b, F.col("l_file") == F.col("r_file"), "full_outer")
    return both.select(F.coalesce("l_file", "r_file").alias("file"), F.coalesce("l_hash", F.lit("")).alias("local_hash"), F.coalesce("r_hash", F.lit("")).alias("remote_hash"), F.coalesce("l_mtime", "r_mtime", F.lit(now)).alias("last_modified"))


def state_updated(state: DataFrame, synced: DataFrame, now: str) -> DataFrame:
    """The state with the synced files (file, hash) equal on both sides."""
    new = synced.select("file", F.col("hash").alias("local_hash"), F.col("hash").alias("remote_hash"), F.lit(now).alias("last_modified"))
    return state.join(new.select("file"), "file", "left_anti").unionByName(new)


def state_without(state: DataFrame, removed: DataFrame) -> DataFrame:
    return state.join(removed.select("file").distinct(), "file", "left_anti")


def with_mapping(registry: DataFrame, mapping: DataFrame) -> DataFrame:
    """The registry (path, local_path, machine_id, last_sync) with mappings put in place of those of equal path and machine."""
    new = mapping.withColumn("path", repository_path(F.col("path"))).select(registry.columns)
    key = registry.withColumn("_path", repository_path(F.col("path")))
    kept = key.join(new.select(F.col("path").alias("_path"), "machine_id").distinct(), ["_path", "machine_id"], "left_anti")
    return kept.select(registry.columns).unionByName(new)


def without_mapping(registry: DataFrame, path: str, machine_id: str) -> DataFrame:
    same = (repository_path(F.col("path")) == repository_path(F.lit(path))) & (F.col("machine_id") == machine_id)
    return registry.where(~same)


def machine_mappings(registry: DataFrame, machine_id: str) -> DataFrame:
    return registry.where(F.col("machine_id") == machine_id)


def touched_mapping(registry: DataFrame, path: str, machine_id: str, now: str) -> DataFrame:
    same = (repository_path(F.col("path")) == repository_path(F.lit(path))) & (F.col("machine_id") == machine_id)
    return registry.withColumn("last_sync", F.when(same, F.lit(now)).otherwise(F.col("last_sync")))


def collision_checks(registry: DataFrame, asked: DataFrame, order: str = "position") -> DataFrame:
    """path, machine_id and result of each mapping asked for: none, same-machine or collision, by the first mapping of the path."""
    first = registry.groupBy(repository_path(F.col("path")).alias("_path")).agg(F.min_by("machine_id", order).alias("_machine"))
    both = asked.withColumn("_path", repository_path(F.col("path"))).join(first, "_path", "left")
    result = F.when(F.col("_machine").isNull(), "none").when(F.col("_machine") == F.col("machine_id"), "same-machine").otherwise("collision")
    return both.select("path", "machine_id", result.alias("result"))


def collisions(registry: DataFrame) -> DataFrame:
    """Paths that more than one machine maps, with the machines. A path with very many mappings is still a sum of each task's own."""
    found = registry.groupBy("path").agg(F.count(F.lit(1)).alias("n_mappings"), F.sort_array(F.collect_set("machine_id")).alias("machines"))
    return found.where((F.col("n_mappings") >= 2) & (F.size("machines") > 1))


def stale_mappings(registry: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Mappings last synced more than `days` days ago, with the whole days since."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_sync")) / 86400)
    return registry.where(F.unix_timestamp("last_sync") < F.unix_timestamp(now) - days * 86400).withColumn("days", age.cast("long"))


def validation_stats(registry: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """One row: total, active and stale mappings, and colliding paths."""
    by_path = registry.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.unix_timestamp("last_sync") < F.unix_timestamp(now) - days * 86400).alias("stale"), (F.min("machine_id") != F.max("machine_id")).alias("collides")
    )
    total, stale = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("stale"), F.lit(0))
    return by_path.agg(total.alias("total"), (total - stale).alias("active"), stale.alias("stale"), F.count_if("collides").alias("collisions"))


def validation_issues(registry: DataFrame, now: Column, missing: DataFrame | None = None, days: int = STALE_DAYS) -> DataFrame:
    """type, severity, path and machine_id of each issue; `missing` has the mappings whose folder isn't there."""
    out = collisions(registry).select(F.lit("collision").alias("type"), F.lit("error").alias("severity"), "path", F.lit(None).cast("string").alias("machine_id"))
    late = stale_mappings(registry, now, days).select(F.lit("stale").alias("type"), F.lit("warning").alias("severity"), "path", "machine_id")
    out = out.unionByName(late)
    if missing is not None:
        out = out.unionByName(missing.select(F.lit("missing").alias("type"), F.lit("warning").alias("severity"), "path", "machine_id"))
    return out


def log_appended(log: DataFrame, entries: DataFrame, order: list[str], most: int = LOG_ENTRIES) -> DataFrame:
    """The last `most` entries of the log with new ones."""
    return log.unionByName(entries).orderBy(*[F.desc(c) for c in order]).limit(most)


def tail(log: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last `n` rows, in order."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def quarantined(copies: DataFrame) -> DataFrame:
    """timestamp and files of each quarantine folder (timestamp, file_name), newest first."""
    named = copies.select("timestamp", quarantined_file(F.col("file_name")).alias("file"))
    return named.groupBy("timestamp").agg(F.sort_array(F.collect_set("file")).alias("files")).orderBy(F.desc("timestamp"))


def expired(copies: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The folders older than `days` days; names that are no times stay."""
    when = F.try_to_timestamp(quarantine_time(F.col("timestamp")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))
    return copies.select("timestamp").distinct().where(when < now - F.expr(f"interval {days} days"))


def merge_files(copies: DataFrame) -> DataFrame:
    """file with its local, remote and base copy in one row (timestamp, file_name, content)."""
    side = F.regexp_extract("file_name", r"\.(local|remote|base)\z", 1)
    rows = copies.select("timestamp", quarantined_file(F.col("file_name")).alias("file"), side.alias("side"), "content")
    return rows.groupBy("timestamp", "file").agg(*[F.max(F.when(F.col("side") == s, F.col("content"))).alias(s) for s in ("local", "remote", "base")])
