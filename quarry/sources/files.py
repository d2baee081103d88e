"""Files as tables: memory folders, syncable files, JSON settings and logs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import matches_globs
from quarry.functions.text import text_hash
from quarry.sources.places import exists, located

LOG_SCHEMA = "timestamp string, operation string, result string, pushed int, pulled int, conflicts int, errors array<string>"
REGISTRY_SCHEMA = "struct<version:int,mappings:array<struct<path:string,localPath:string,machineId:string,lastSync:string>>>"
STATE_SCHEMA = "struct<version:int,lastSync:string,centralPath:string,files:map<string,struct<localHash:string,remoteHash:string,lastModified:string>>>"
#: The folder of the engine's own files in a memory folder.
HIDDEN = ".quarry"


class AmbiguousMemory(ValueError):
    """MEMORY.md and memory.md are both there and are different files."""


def _relative(spark: SparkSession, folder: str, only: list[str] | None = None) -> tuple[str, DataFrame]:
    """The files of a folder, or some of them by their relative paths. Contents are read only where the column is used."""
    root = folder.rstrip("/")
    jpath, files = located(spark, root)
    if not files.exists(jpath) or only == []:
        return root, spark.createDataFrame([], "path string, abs_path string, mtime double, size long, content binary")
    full = files.resolvePath(jpath).toUri().getPath().rstrip("/")
    reader = spark.read.format("binaryFile")
    # names are taken as they are, not as globs
    table = reader.option("recursiveFileLookup", "true").load(root) if only is None else reader.load([f"{root}/{re.sub(r'([][{}*?^\\])', r'\\\1', p)}" for p in only])
    inside = F.regexp_replace(F.col("path"), r"\A[a-z0-9+.-]+:(//[^/]*)?", "")
    return root, table.select(
        F.substring(inside, F.lit(len(full) + 2), F.length(inside)).alias("path"), F.col("path").alias("abs_path"), (F.unix_micros("modificationTime") / 1000).alias("mtime"), F.col("length").alias("size"), "content"
    )


def memory_files(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """path, abs_path, mtime (milliseconds), size, text and hash of MEMORY.md (or memory.md) and memory/**/*.md, or of the ones named.

    A folder that isn't there has no files. Both root files with different
    contents are an error; the same content twice is one file. Only those two are
    read to tell; who takes paths, times and sizes alone has no file opened.
    """
    _, files = _relative(spark, folder, only)
    root = F.col("path").isin("MEMORY.md", "memory.md")
    files = files.where(root | (F.col("path").startswith("memory/") & F.col("path").endswith(".md")))
    files = files.withColumn("text", F.decode("content", "UTF-8")).drop("content").withColumn("hash", text_hash(F.col("text")))
    if all(exists(spark, f"{folder.rstrip('/')}/{name}") for name in ("MEMORY.md", "memory.md")):
        _, two = _relative(spark, folder, ["MEMORY.md", "memory.md"])
        if len({bytes(r["content"]) for r in two.select("content").collect()}) > 1:
            raise AmbiguousMemory(folder)
        files = files.where(F.col("path") != "memory.md")
    return files


def syncable_files(spark: SparkSession, folder: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """file, hash and mtime of the files that the globs choose; the engine's own folder is never one of them."""
    _, files = _relative(spark, folder)
    own = F.exists(F.split("path", "/"), lambda p: p == HIDDEN)
    chosen = files.where(~own & matches_globs(F.col("path"), list(include), list(exclude)))
    return chosen.select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash"), F.timestamp_millis(F.col("mtime").cast("long")).cast("string").alias("mtime"))


def read_json(spark: SparkSession, path: str, default: dict) -> dict:
    """A small settings file; the default for a missing or damaged one."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        found = json.loads(text)
        return found if isinstance(found, dict) else default
    except Exception:
        return default


def parsed_registry(files: DataFrame, content: str = "content") -> DataFrame:
    """The mappings of registry texts, with their position; damaged ones have none."""
    found = F.from_json(content, REGISTRY_SCHEMA)
    return files.select(F.posexplode(found["mappings"]).alias("position", "m")).select("position", F.col("m.path").alias("path"), F.col("m.localPath").alias("local_path"), F.col("m.machineId").alias("machine_id"), F.col("m.lastSync").alias("last_sync"))


def parsed_state(files: DataFrame, central_path: str, content: str = "content") -> DataFrame:
    """file, local_hash, remote_hash, last_modified and central_path of sync state texts; fields of old versions fall away."""
    found = F.from_json(content, STATE_SCHEMA)
    rows = files.select(F.explode(found["files"]).alias("file", "s"))
    return rows.select("file", F.col("s.localHash").alias("local_hash"), F.col("s.remoteHash").alias("remote_hash"), F.col("s.lastModified").alias("last_modified"), F.lit(central_path).alias("central_path"))


def parsed_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """The entries of JSON lines; none at all if any line that isn't blank is damaged."""
    rows = lines.where(F.trim(F.col(line)) != "").select(F.from_json(line, LOG_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    if rows.where(F.col("e._bad").isNotNull() | F.col("e").isNull()).limit(1).count():
        return rows.where(F.lit(False)).select("e.*").drop("_bad")
    return rows.select("e.*").drop("_bad")
