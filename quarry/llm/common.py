"""What the operators of this subpackage share: written tables, row batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir, shared_path, spread

__all__ = ["WORD", "discard", "document_fold", "let", "passing_path", "per_batch", "read_table", "shared_dir", "shared_path", "written"]

#: Words of most operators: runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def passing_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that goes when the driver ends; one that is killed leaves it."""
    path = shared_path(spark, name)
    on_disk = spark._jvm.org.apache.hadoop.fs.Path(path)
    # the store notes only paths that are there
    store = on_disk.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(on_disk)
    store.deleteOnExit(on_disk)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder; its lineage ends there. The table goes when the driver ends."""
    spark = df.sparkSession
    path = passing_path(spark, name) + "/table"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of tables that `written` made."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def document_fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(folds)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where the body has lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 2000):
    """A mapInArrow function that calls `function` on at most `rows` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = function(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
