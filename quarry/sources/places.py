"""Small files and folders in whatever store Spark knows, through its file systems."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """A file that was to be made is there already."""


def located(spark: SparkSession, name: str) -> tuple[Any, Any]:
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, files = located(spark, name)
    return files.exists(path)


def read_text(spark: SparkSession, name: str) -> str | None:
    """A file's text; None if it isn't there."""
    path, files = located(spark, name)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def _put(spark: SparkSession, name: str, text: str, over: bool) -> None:
    target, files = located(spark, name)
    draft, _ = located(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    stream = files.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    how = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if over else how.NONE
    context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        # one step: a crash leaves the old file or the new one
        context.rename(files.makeQualified(draft), files.makeQualified(target), options)
    except Exception as e:
        files.delete(draft, False)
        if not over and files.exists(target):
            raise Taken(name) from e
        raise


def replace_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a file in one step, over one that is there."""
    _put(spark, name, text, True)


def create_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a file in one step; Taken if there is one, whoever wrote it."""
    if exists(spark, name):
        raise Taken(name)
    _put(spark, name, text, False)


def delete(spark: SparkSession, name: str) -> None:
    path, files = located(spark, name)
    files.delete(path, True)


def children(spark: SparkSession, name: str) -> list[str]:
    """The names in a folder; none for a folder that isn't there."""
    path, files = located(spark, name)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []
