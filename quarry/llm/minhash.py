"""Near duplicates by the Jaccard similarity of word shingles: SimHash balls, MinHash bands beyond them, then an exact check.

Texts are near duplicates if the sets of their lower-cased five-word shingles
have a similarity of at least 4/5, and groups are connected components of such
pairs. Texts with equal sets are one node. Nodes first meet by the SimHash of their
shingles, in balls around its halves (`simhash.met_in_halves`); pairs that the
exact check confirms are components. Pairs at the similarity differ in about ten
bits, further than balls of a bearable size reach, so components meet again by
bands: each node emits BANDS keys, each the
hash of ROWS minima; nodes that share a key are candidates. A pair at
similarity s shares none with probability (1 - s^ROWS)^BANDS: 6 in 100,000 at
0.8, 3 in 1,000,000,000 at 0.9. Every link rests on the shingle sets
themselves, so no pair below the similarity is linked.

Keys whose members are one component are settled. Within another all members are first held against one of them, the hub: the one
that shares its keys with the most others, which for copies of one text is that
text or the copy nearest to it. So a large group costs as many comparisons as it
has members. Sets that are then still in different components of a key go by
prefixes: of n shingles, ordered from rare to frequent among these sets, the
first n - ceil(4n/5) + 1 must have one in common with the first
m - ceil(8m/9) + 1 of any near duplicate of m <= n shingles, and what follows the
first common one must be enough for the similarity. So texts that only share a
frequent passage do not meet.

Defined cases: null texts, empty ones and ones of white space only are alike; a
text of fewer words than a shingle is one shingle; repeated rows and null ids
are as in `simhash.one_of_each`; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import per_batch, written
from quarry.llm.graph import components
from quarry.llm.simhash import SEED, kept_rows, met_in_halves, of_hashes

BANDS, ROWS = 32, 6
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The XXH64 of the text's distinct shingles, in order."""
    import xxhash

    words = (text or "").lower().encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    spaces = [*np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20).tolist(), len(joined)]
    starts = [0, *(s + 1 for s in spaces[: n - 1])]
    ends = spaces[min(shingle, len(words)) - 1 :]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, n))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set, as unsigned longs; an empty set has none."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(least, (short[at : at + 4096] * _TIMES + _PLUS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _set_id(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def prints(tagged: DataFrame, text: str, carry: tuple[str, ...], shingle: int = 5) -> DataFrame:
    """`carry`, the set's name in _fp, its SimHash in _sim, its size in _n and its keys in _bands."""
    slim = tagged.select(*carry, F.col(text).alias("_text"))
    schema = slim.drop("_text").withColumns({"_fp": F.lit(0).cast("long"), "_sim": F.lit(0).cast("long"), "_n": F.lit(0), "_bands": F.lit([]).cast("array<bigint>")}).schema
    k = len(carry)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle) for t in batch.column(k).to_pylist()]
        names = pa.array(np.array([_set_id(s) for s in sets], np.uint64).view(np.int64))
        sims = pa.array(np.array([of_hashes(s) for s in sets], np.uint64).view(np.int64))
        keys = pa.array([np.array(bands(s), np.uint64).view(np.int64) for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), names, sims, pa.array([len(s) for s in sets], pa.int32()), keys], names=[*carry, "_fp", "_sim", "_n", "_bands"])

    return slim.mapInArrow(per_batch(run, 500), schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """f, s: the shingles of each of the texts (_fp, _text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["f", "s"])

    return texts.select(F.col("_fp").alias("f"), "_text").mapInArrow(per_batch(run, 500), "f bigint, s array<bigint>")


def _alike(i: Column, a: Column, b: Column) -> Column:
    """Whether `i` common ones of `a` and `b` make a similarity of at least 4/5, in whole numbers."""
    return 9 * i >= 4 * (a + b)


def links(docs: DataFrame, tagged: DataFrame, text: str = "text", shingle: int = 5, broadcast_keys: int = 200_000) -> DataFrame:
    """a, b: pairs of different sets at or above the similarity, enough of them to connect all that are found.

    `tagged` are written `prints` with _text_key; `docs` has the texts.
    """
    small = lambda keys: F.broadcast(keys) if keys.count() <= broadcast_keys else keys
    keyed = tagged.select(F.explode("_bands").alias("v"), F.col("_fp").alias("f"), F.col("_n").alias("n"))
    # copies have one name, so that a key's least and greatest differ only where sets do
    shared = written(keyed.groupBy("v").agg(F.min("f").alias("least"), F.max("f").alias("most")).where("least < most").select("v"), "shared")
    members = written(keyed.join(small(shared), "v").distinct(), "members")
    near = written(met_in_halves(tagged.groupBy("_fp").agg(F.first("_sim").alias("_sim")), "_fp", "_sim"), "near")
    named = members.select("f").unionByName(near.select(F.col("a").alias("f"))).unionByName(near.select(F.col("b").alias("f"))).distinct()
    keys = tagged.groupBy("_fp").agg(F.min("_text_key").alias("_key")).join(named.withColumnRenamed("f", "_fp"), "_fp", "left_semi")
    keys = written(keys, "candidates")
    texts = docs.select(F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key")).join(small(keys), "_key")
    # copies are merged in each task first
    sets = written(_sets(texts, shingle).groupBy("f").agg(F.first("s").alias("s")).withColumn("n", F.size("s")), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        out = pairs.where(F.least("a", "b") != F.greatest("a", "b")).distinct()
        out = out.join(sets.select(F.col("f").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a")
        out = out.join(sets.select(F.col("f").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
        return out.where(_alike(F.least("na", "nb"), F.col("na"), F.col("nb"))).where(_alike(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"))).select("a", "b")

    # grouped by keys as text, so that a join on the key itself can split one with very many members
    by_key, key = F.col("v").cast("string").alias("_v"), F.col("_v").cast("long").alias("v")

    def apart(known: DataFrame) -> DataFrame:
        """v, f, n and the component r of members whose key has several components of the links so far."""
        roots = written(components(known), "roots")
        placed = members.join(roots, members["f"] == roots["node"], "left").select("v", "f", "n", F.coalesce("root", "f").alias("r"))
        open_keys = placed.groupBy(by_key).agg(F.min("r").alias("r0"), F.max("r").alias("r1")).where("r0 < r1").select(key)
        return placed.join(open_keys, "v", "left_semi")

    near = written(checked(near), "links")
    banded = written(apart(near), "banded")
    sizes = banded.groupBy(by_key).agg(F.count(F.lit(1)).alias("m")).select(key, "m")
    company = banded.join(sizes, "v").groupBy("f").agg(F.sum("m").alias("w"))
    hub = F.max_by(F.struct("f", "n", "r"), F.struct("w", "f")).alias("h")
    hubs = banded.join(company, "f").groupBy(by_key).agg(hub).select(key, F.col("h.f").alias("a"), F.col("h.n").alias("na"), F.col("h.r").alias("ra"))
    against = banded.join(hubs, "v").where("r <> ra").where(_alike(F.least("n", "na"), F.col("n"), F.col("na")))
    first = written(near.unionByName(checked(against.select("a", F.col("f").alias("b")))), "links")
    rest = apart(first).select("f", "r").distinct()
    return written(first.unionByName(checked(_by_prefix(sets.join(rest, "f")))), "links")


def _by_prefix(sets: DataFrame) -> DataFrame:
    """a, b: the pairs of sets (f, s, n) of different components r that can be alike, as they share a shingle of their prefixes."""
    each = written(sets.select("f", "n", "r", F.explode("s").alias("g")), "rest")
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    place = F.row_number().over(Window.partitionBy("f").orderBy("k", "g"))
    prefix = each.join(often, "g").withColumn("p", place).where("k > 1").where("p <= n - div(4 * n + 4, 5) + 1")
    prefix = written(prefix.select("g", "f", "n", "r", "p"), "prefixes")
    lesser = prefix.where("p <= n - div(8 * n + 8, 9) + 1").select("g", *(F.col(c).alias(f"{c}_") for c in ("f", "n", "r", "p")))
    met = prefix.join(lesser, "g").where("r <> r_ and (n_ < n or n_ = n and f_ < f)").where(_alike(F.col("n_"), F.col("n"), F.col("n_")))
    return met.where(_alike(1 + F.least(F.col("n") - F.col("p"), F.col("n_") - F.col("p_")), F.col("n"), F.col("n_"))).select(F.col("f_").alias("a"), F.col("f").alias("b"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, broadcast_keys: int = 200_000) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the least by id (null last), then by the text's hash."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    tagged = written(prints(docs.select(doc_id, text).withColumn("_text_key", key), text, (doc_id, "_text_key"), shingle), "prints")
    roots = components(links(docs, tagged, text, shingle, broadcast_keys))
    return kept_rows(docs, tagged.drop("_n", "_bands", "_sim"), roots, text, doc_id, broadcast_keys)
