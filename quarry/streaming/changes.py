"""Streams of file changes: debounced batches and an index that follows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGE_SCHEMA = "directory string, file string, event string, ts timestamp, event_id long"


def debounced(events: DataFrame, gap_seconds: float, directory: str = "directory", file: str = "file", event: str = "event", when: str = "ts", order: str = "event_id") -> DataFrame:
    """directory, start, end, n and last of each burst of changes; a burst ends when nothing comes for `gap_seconds`.

    `last` has the last event of each file, in the order of the events. Works on
    tables and, with a watermark on `when`, on streams. A burst's events are one
    array, sorted twice; `last_events` has the same for tables without arrays.
    """
    # session windows still join at exactly their gap; here a new burst starts then
    gap = f"{round(gap_seconds * 1_000_000) - 1} microseconds"
    burst = events.groupBy(F.col(directory).alias("directory"), F.session_window(when, gap).alias("w"))
    by_file = F.sort_array(F.collect_list(F.struct(F.col(file).alias("file"), F.col(when).alias("t"), F.col(order).alias("o"), F.col(event).alias("event"))))
    out = burst.agg(F.count(F.lit(1)).alias("n"), by_file.alias("e"))
    ended = F.filter("e", lambda x, i: ~F.coalesce(F.get("e", i + 1)["file"].eqNullSafe(x["file"]) & (i + 1 < F.size("e")), F.lit(False)))
    last = F.sort_array(F.transform(ended, lambda x: F.struct(x["t"].alias("t"), x["o"].alias("o"), x["file"].alias("file"), x["event"].alias("event"))))
    return out.select("directory", F.col("w.start").alias("start"), F.timestamp_micros(F.unix_micros("w.end") + 1).alias("end"), "n", F.transform(last, lambda x: F.struct(x["file"].alias("file"), x["event"].alias("event"))).alias("last"))


def bursts(events: DataFrame, gap_seconds: int, directory: str, when: str, order: str) -> DataFrame:
    """`events` with the number of their burst: a new one starts `gap_seconds` or more after the event before it.

    For tables. Only time and order are sorted within a directory; a directory
    with very many events is a sorted, spillable window.
    """
    w = Window.partitionBy(directory).orderBy(when, order)
    seconds = F.unix_micros(F.col(when).cast("timestamp"))
    before = F.lag(seconds).over(w)
    fresh = (before.isNull() | (seconds - before >= gap_seconds * 1_000_000)).cast("long")
    return events.withColumn("_new", fresh).withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def last_events(events: DataFrame, gap_seconds: int, directory: str = "directory", file: str = "file", event: str = "event", when: str = "ts", order: str = "event_id") -> DataFrame:
    """directory, burst, file and event: of each file in a burst its last event."""
    marked = bursts(events, gap_seconds, directory, when, order)
    last = marked.groupBy(directory, "burst", file).agg(F.max_by(F.col(event), F.struct(when, order)).alias(event))
    return last.select(F.col(directory).alias("directory"), "burst", F.col(file).alias("file"), F.col(event).alias("event"))


def merged_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """The change streams of many directories as one, each with its directory."""
    out = None
    for directory, stream in streams.items():
        named = stream.withColumn("directory", F.lit(directory))
        out = named if out is None else out.unionByName(named)
    return out


def follow(changes: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call `update(batch, id)` for each micro-batch. Without `every`, all that is there now is taken and the query ends."""
    writer = changes.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class FollowingIndex:
    """A file table kept up to date from a stream of changes (file, event, text, ts, event_id).

    Each micro-batch writes the last change of each of its files under `folder`;
    the table is the newest whole state with the changes after it. Every
    `compact` batches they are written as a new state, and what is older than the
    state before that goes. All is found by the names in the folder, so a new
    process goes on where the last one stopped, and a batch that runs again
    writes the same again.
    """

    def __init__(self, folder: str, schema: str = "path string, text string", compact: int = 20):
        self.folder, self.schema, self.compact = folder, schema, compact

    def _store(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _written(self, spark: SparkSession, kind: str) -> list[int]:
        """The numbers of the states or changes that were written to their end."""
        path, store = self._store(spark)
        if not store.exists(path):
            return []
        names = [s.getPath().getName() for s in store.listStatus(path)]
        done = [n for n in names if n.startswith(f"{kind}=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def table(self, spark: SparkSession) -> DataFrame:
        states = self._written(spark, "state")
        base = spark.read.schema(self.schema).parquet(f"{self.folder}/state={states[-1]}") if states else spark.createDataFrame([], self.schema)
        after = [n for n in self._written(spark, "changes") if not states or n > states[-1]]
        if not after:
            return base
        parts = [spark.read.schema(f"{self.schema}, event string").parquet(f"{self.folder}/changes={n}").withColumn("_n", F.lit(n)) for n in after]
        changed = parts[0]
        for part in parts[1:]:
            changed = changed.unionByName(part)
        last = changed.groupBy("path").agg(F.max_by(F.struct("event", "text"), "_n").alias("r")).select("path", "r.event", "r.text")
        return base.join(last.select("path"), "path", "left_anti").unionByName(last.where("event <> 'unlink'").select("path", "text"))

    def __call__(self, changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        states = self._written(spark, "state")
        if states and states[-1] >= batch:
            return  # run again after all of it was written
        last = changes.groupBy("file").agg(F.max_by(F.struct("event", "text"), F.struct("ts", "event_id")).alias("r"))
        last.select(F.col("file").alias("path"), "r.text", "r.event").write.mode("overwrite").parquet(f"{self.folder}/changes={batch}")
        if (batch + 1) % self.compact == 0:
            self.table(spark).write.mode("overwrite").parquet(f"{self.folder}/state={batch}")
            path, store = self._store(spark)
            old = states[-1] if states else -1
            for kind in ("state", "changes"):
                for n in self._written(spark, kind):
                    if n < old or (kind == "changes" and n <= old):
                        store.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"{kind}={n}"), True)
