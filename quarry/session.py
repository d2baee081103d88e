"""Session settings the engine is written for."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution with skewed joins split, UTC, Arrow.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the cluster's own with SETTINGS."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quarry").config("spark.driver.memory", memory)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(partitions), **more}.items():
        builder = builder.config(key, value)
    spark = with_package(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine find the package; clusters get it with --py-files."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


#: Bytes a core of a table that is dealt out; a larger one is left in its splits.
SPREAD_BYTES = 8 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table that has fewer splits than there are cores dealt out to all of them; others as they are.

    A small file with one row group is one task otherwise, however much work its
    rows are. A larger table is not worth the shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return table.repartition(cores) if size <= cores * SPREAD_BYTES else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, as in tests, gets a folder of its own if none is set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir() or folder
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def passing_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that goes when the driver ends; a driver that is killed leaves it."""
    path = shared_path(spark, name)
    on_disk = spark._jvm.org.apache.hadoop.fs.Path(path)
    # the store notes only paths that are there
    store = on_disk.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(on_disk)
    store.deleteOnExit(on_disk)
    return f"{path}/table"
