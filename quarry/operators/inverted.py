"""A written inverted index for many keyword queries over one large table.

Scanning and cutting all texts for each query is right for a few queries; for
many, the postings are written once, sorted by bucket and term, and a query
reads the buckets of its terms only. Tasks gather the postings of their rows by
term before anything is shuffled, so that a term is sent once for many rows. The
postings of a very frequent term are spread over files by the tasks they come from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import query_phrases, tokens
from quarry.operators.search import K1, B, CorpusStats

BUCKETS = 64
#: Tokens that are gathered at a time, about.
TOKENS_AT_ONCE = 2_000_000
#: Tasks whose postings may lie in one file, as bits.
TASK_BITS = 3
FRONT = "array<struct<tf:int,d:int>>"
#: A term's postings over some rows: how many, their tokens, the best (count, length) pairs; by row its length, count and the place of its positions.
PART = f"bucket int, term string, window long, n long, total long, front {FRONT}, ids array<{{kind}}>, d array<int>, f array<int>, at array<int>, places array<int>"


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def earlier(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def posting_parts(rows: DataFrame, buckets: int, bits: int | None = None) -> DataFrame:
    """PART of rows (id, tokens): each task gathers the postings of a term over the rows of one window that it has at hand.

    A window has the ids that agree but for their last `bits`; without `bits` ids may
    be of any type and a window is a task. What comes of a window in several tasks or
    batches is several rows of a term. A task's rows are in runs sorted by term.
    """
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TOKENS_AT_ONCE, "right")) - 1)
                part = batch.slice(first, last - first)
                ids = part.column(0)
                windows = np.full(len(ids), here) if bits is None else ids.to_numpy(zero_copy_only=False) >> bits
                if offsets[last] > offsets[first]:
                    yield _gathered(ids, windows, part.column(1), buckets)
                first = last

    return rows.mapInArrow(run, PART.format(kind=kind))


def _gathered(ids: pa.Array, windows: np.ndarray, words: pa.ListArray, buckets: int) -> pa.RecordBatch:
    offsets = words.offsets.to_numpy()
    coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    names, window = np.unique(windows, return_inverse=True)
    by_term = pc.sort_indices(coded.dictionary)
    names_of, rank = coded.dictionary.take(by_term), np.empty(len(by_term), np.int64)
    rank[by_term.to_numpy()] = np.arange(len(by_term))
    key = rank[coded.indices.to_numpy()] * len(names) + window[row]
    order = np.argsort(key, kind="stable")  # rows and places stay in order
    key, row, place = key[order], row[order], place[order]
    posting = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
    f = np.diff(np.append(posting, len(key)))
    key, row = key[posting], row[posting]
    part = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(part, len(key)))
    d = sizes[row]
    # (count, length) pairs that no other pair of the part beats in both: those shorter than all with a higher count
    of = np.repeat(np.arange(len(part)), n)
    best = np.lexsort((d, -f, of))
    value = d[best] - of[best] * (int(sizes.max()) + 1)
    kept = best[np.concatenate([[True], value[1:] < np.minimum.accumulate(value)[:-1]])]
    tokens_to = np.append(posting[part], len(place))
    terms = names_of.take(pa.array(key[part] // len(names)))
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    to = np.append(part, len(key))
    pairs = pa.StructArray.from_arrays([pa.array(f[kept], pa.int32()), pa.array(d[kept], pa.int32())], names=["tf", "d"])
    columns = [
        pa.array([bucket_of(t, buckets) for t in terms.to_pylist()], pa.int32()), terms, pa.array(names[key[part] % len(names)], pa.int64()), pa.array(n, pa.int64()), pa.array(np.diff(tokens_to), pa.int64()),
        lists(np.searchsorted(of[kept], np.arange(len(part) + 1)), pairs), lists(to, ids.take(pa.array(row))), lists(to, pa.array(d, pa.int32())), lists(to, pa.array(f, pa.int32())),
        lists(to, pa.array(posting - np.repeat(posting[part], n) + 1, pa.int32())), lists(tokens_to, pa.array(place, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "term", "window", "n", "total", "front", "ids", "d", "f", "at", "places"])


def listed(parts: DataFrame, *keep: str, positions: Column | bool = False) -> DataFrame:
    """`keep`, id, d and f of each posting of PART; with its positions where `positions` holds."""
    each = F.arrays_zip(F.col("ids").alias("id"), F.col("d").alias("d"), F.col("f").alias("f"), F.col("at").alias("at"))

    def one(x: Column) -> Column:
        fields = [x[c].alias(c) for c in ("id", "d", "f")]
        if positions is not False:
            places = F.slice("places", x["at"], x["f"])
            fields.append((places if positions is True else F.when(positions, places)).alias("positions"))
        return F.struct(*fields)

    return parts.select(*keep, F.inline(F.transform(each, one)))


def dealt(parts: DataFrame, bits: int) -> DataFrame:
    """PART by bucket and ranges of windows that agree but for the last `bits`, so that a very frequent term lies in many tasks."""
    return parts.repartition("bucket", F.shiftright("window", bits)).sortWithinPartitions("bucket", "term", "window")


def build(table: DataFrame, path: str, id_col: str = "id", text: str = "text", buckets: int = BUCKETS) -> TextIndex:
    """Write the index of a table's texts below `path`; null texts are empty."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    dealt(posting_parts(rows, buckets), TASK_BITS).drop("window", "front").write.partitionBy("bucket").parquet(f"{path}/postings")
    made, n = TextIndex(spark, path), F.lit(table.count())
    sums = made.parts().agg(F.coalesce(F.sum("total"), F.lit(0)).alias("t"))
    sums.select(n.alias("n"), F.when(n > 0, F.col("t") / n).otherwise(0.0).alias("mean_length"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/stats")
    return made


@dataclass
class TextIndex:
    """A written index, opened for queries."""

    spark: SparkSession
    path: str

    def stats(self) -> tuple[int, float, int]:
        row = self.spark.read.parquet(f"{self.path}/stats").first()
        return row["n"], row["mean_length"], row["buckets"]

    def parts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def _of(self, terms: list[str], buckets: int) -> DataFrame:
        """The rows of some terms: other buckets' folders are not opened, other terms' row groups are passed over."""
        return self.parts().where(F.col("bucket").isin(sorted({bucket_of(t, buckets) for t in terms})) & F.col("term").isin(sorted(set(terms)))).drop("bucket")

    def postings(self, terms: list[str], buckets: int) -> DataFrame:
        """term, id, d, f and positions of some terms."""
        return listed(self._of(terms, buckets), "term", positions=True)

    def phrase(self, words: list[str], buckets: int) -> DataFrame:
        """id, d and f: how often the words stand one after another."""
        if len(words) == 1:
            return listed(self._of(words, buckets))
        found = self.postings(words, buckets)
        out = found.where(F.col("term") == words[0]).select("id", "d", "positions")
        for k, word in enumerate(words[1:], 1):
            next_ = found.where(F.col("term") == word).select("id", F.col("positions").alias("_next"))
            out = out.join(next_, "id").select("id", "d", F.array_intersect("positions", earlier("_next", k)).alias("positions"))
        return out.where(F.size("positions") > 0).select("id", "d", F.size("positions").alias("f"))

    def bm25(self, query: str) -> DataFrame:
        """id and rank, the lower the better, where every phrase of the query occurs."""
        phrases = query_phrases(query)
        if not phrases or not all(phrases):
            return listed(self.parts()).select("id", F.lit(0.0).alias("rank")).where(F.lit(False))
        n, mean_length, buckets = self.stats()
        sides = [self.phrase(p, buckets).select("id", F.col("d").alias(f"d{i}"), F.col("f").alias(f"f{i}")) for i, p in enumerate(phrases)]
        counted = None
        for i, (p, side) in enumerate(zip(phrases, sides, strict=True)):
            # rows with one word are told by its headers
            rows = self._of(p, buckets).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")) if len(p) == 1 else side.agg(F.count(F.lit(1)).alias("n"))
            one = rows.select(F.lit(i).alias("i"), "n")
            counted = one if counted is None else counted.unionByName(one)
        with_phrase = {r["i"]: r["n"] for r in counted.collect()}
        stats = CorpusStats(n, mean_length, tuple(with_phrase[i] for i in range(len(phrases))))
        out = sides[0]
        for side in sides[1:]:
            out = out.join(side, "id")
        total = F.lit(0.0)
        for i in range(len(phrases)):
            f = F.col(f"f{i}").cast("double")
            total = total + F.lit(stats.idf(i)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d0") / F.lit(mean_length)))
        return out.select("id", (-total).alias("rank"))
