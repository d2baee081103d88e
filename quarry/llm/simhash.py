"""Near duplicates by SimHash, found by meet-in-the-middle ball hashing.

Each distinct fingerprint emits all fingerprints within half the radius of it.
Two fingerprints are within the radius exactly if such balls meet, so equal
variants are brought together by a shuffle and colliding fingerprints are
linked after their distance is checked. A variant is met by at most as many
fingerprints as its own ball holds (65 for radius 2), however large the input
is, and copies are one fingerprint before anything is emitted.

Defined cases: null and empty texts have fingerprint zero and link like any
other; a text of fewer words than a shingle is one shingle; repeated rows and
null ids keep their rows (a component of null ids only has a null id); an empty
table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import per_batch, written
from quarry.llm.graph import components

SEED = 42
#: Variants that a task makes, about.
VARIANTS_A_TASK = 2_000_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, SEED)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = np.concatenate([[0], spaces[: len(words) - shingle] + 1]).tolist()
    ends = np.concatenate([spaces[shingle - 1 :], [len(joined)]]).tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of shingles that are given by their hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """The columns `carry` and the fingerprint as a signed long in _fp."""
    slim = docs.select(*carry, F.col(text).alias("_text"))
    schema = slim.drop("_text").withColumn("_fp", F.lit(0).cast("long")).schema
    arrow_fields = len(carry)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, shingle) for t in batch.column(arrow_fields).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(arrow_fields)), pa.array(prints)], names=[*carry, "_fp"])

    return slim.mapInArrow(per_batch(run, 500), schema)


def _masks(radius: int) -> list[int]:
    """Signed longs with at most `radius` bits set."""
    out = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def variants(fp: Column, radius: int) -> Column:
    """All fingerprints within `radius` bits of one, itself first."""
    return F.transform(F.lit(_masks(radius)).cast("array<bigint>"), lambda m: fp.bitwiseXOR(m))


def links(prints: DataFrame, radius: int = 2, fp: str = "_fp") -> DataFrame:
    """a, b: pairs of different fingerprints within the radius, enough of them to connect all that are.

    For an even radius both sides emit balls of half of it. Fingerprints that
    meet in a variant are then within the radius of each other, and each is
    linked with the one before it in that variant: no chain is lost and no group
    is paired out. For an odd radius the balls have the larger half and the
    distance of every two of a variant is looked at.
    """
    half = (radius + 1) // 2
    distinct = prints.select(F.col(fp).alias("f")).where(F.col("f").isNotNull()).distinct()
    # each row becomes many: as many tasks as the variants need, however few bytes the fingerprints are
    spread = max(prints.sparkSession.sparkContext.defaultParallelism, prints.count() * len(_masks(half)) // VARIANTS_A_TASK)
    distinct = distinct.repartition(spread)
    balls = distinct.select("f", F.explode(variants(F.col("f"), half)).alias("v"))
    if radius % 2 == 0:
        before = F.lag("f").over(Window.partitionBy("v").orderBy("f"))
        pairs = balls.select(before.alias("a"), F.col("f").alias("b")).where(F.col("a").isNotNull())
    else:
        met = balls.groupBy("v").agg(F.sort_array(F.collect_set("f")).alias("s")).where(F.size("s") > 1)
        pairs = met.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where(F.col("a") < F.col("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def met_in_halves(prints: DataFrame, node: str, fp: str = "_fp", within: int = 20) -> DataFrame:
    """a, b: nodes within `within` bits of each other that meet in the balls of a half of their fingerprints.

    Each half emits all within one bit of it, as many variants as a whole fingerprint
    does for radius 2. Of two fingerprints within 5 bits one half has at most 2, so
    they always meet; at 10 bits about a fifth do. As in `links` each is linked with
    the one before it in a variant, and the distance of the whole is looked at.
    """
    masks = F.lit([0, *(1 << b for b in range(32))]).cast("array<bigint>")
    low, high = F.col("_w").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("_w", 32)
    keys = F.concat(F.transform(masks, lambda m: low.bitwiseXOR(m)), F.transform(masks, lambda m: high.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))
    spread = max(prints.sparkSession.sparkContext.defaultParallelism, prints.count() * 66 // VARIANTS_A_TASK)
    balls = prints.select(F.col(node).alias("b"), F.col(fp).alias("_w")).where(F.col("_w").isNotNull()).repartition(spread).select("b", "_w", F.explode(keys).alias("v"))
    before = F.lag(F.struct("b", "_w")).over(Window.partitionBy("v").orderBy("_w", "b"))
    pairs = balls.select(before.alias("_before"), "b", "_w").where(F.bit_count(F.col("_before._w").bitwiseXOR(F.col("_w"))) <= within)
    return pairs.select(F.col("_before.b").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id, _fp and component_id of every document: the least id that links of the radius reach.

    The fingerprints are written once; links and components are over distinct
    fingerprints only, and ids are joined to them at the end.
    """
    prints = written(fingerprints(docs, text, (doc_id,), shingle), "prints")
    roots = components(links(prints, radius))
    least = prints.groupBy("_fp").agg(F.min(doc_id).alias("_least"))
    known = least.join(roots, least["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    # grouped by another key than the join's, so that a large component can be split in the join
    of_root = known.groupBy(F.col("_root").cast("string").alias("_of")).agg(F.min("_least").alias("component_id")).withColumn("_of", F.col("_of").cast("long"))
    by_print = known.join(of_root, F.col("_root") == F.col("_of")).select(F.col("_fp").alias("_print"), "component_id")
    return prints.join(by_print, prints["_fp"] == by_print["_print"], "left").select(prints[doc_id].alias("doc_id"), "_fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, broadcast_keys: int = 200_000) -> DataFrame:
    """`docs` with one row of each component: the least by id (null last), then by the text's hash.

    Rows that agree in id and text are one document; one of them stays. Texts
    are not moved as long as the keys of what goes are few enough to broadcast.
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    tagged = docs.select(doc_id, text).withColumn("_text_key", key)
    prints = written(fingerprints(tagged, text, (doc_id, "_text_key"), shingle), "prints")
    return kept_rows(docs, prints, components(links(prints, radius)), text, doc_id, broadcast_keys)


def kept_rows(docs: DataFrame, prints: DataFrame, roots: DataFrame, text: str, doc_id: str, broadcast_keys: int) -> DataFrame:
    """The rows that `one_of_each` keeps, by the components of the names in _fp."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_text_key").alias("key"))
    best = prints.groupBy("_fp").agg(F.min(order).alias("_best"))
    known = best.join(roots, best["_fp"] == roots["node"], "left").select("_fp", "_best", F.coalesce("root", "_fp").alias("_root"))
    least = known.groupBy(F.col("_root").cast("string").alias("_of")).agg(F.min("_best").alias("_keep")).withColumn("_of", F.col("_of").cast("long"))
    verdict = known.join(least, F.col("_root") == F.col("_of")).select(F.col("_fp").alias("_print"), "_keep")
    judged = prints.join(verdict, prints["_fp"] == verdict["_print"])
    stays = F.col(doc_id).eqNullSafe(F.col("_keep.id")) & (F.col("_text_key") == F.col("_keep.key"))
    # keys that go, and keys of rows that agree in id and text, of which one stays
    odd = judged.groupBy(F.col(doc_id).alias("_odd_id"), F.col("_text_key").alias("_odd_key")).agg(F.bool_or(stays).alias("_stays"), F.count(F.lit(1)).alias("_times"))
    odd = written(odd.where(~F.col("_stays") | (F.col("_times") > 1)), "odd")
    repeated = odd.where("_stays")
    n_odd, n_repeated = odd.count(), repeated.count()
    small = lambda keys, n: F.broadcast(keys) if n <= broadcast_keys else keys
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), key.alias("_text_key"))

    def joined(keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, rows["_id"].eqNullSafe(keys["_odd_id"]) & (rows["_text_key"] == keys["_odd_key"]), how)

    kept = joined(small(odd, n_odd), "left_anti").select("_row.*")
    if n_repeated:
        kept = kept.unionByName(joined(small(repeated, n_repeated), "left_semi").dropDuplicates(["_id", "_text_key"]).select("_row.*"))
    return kept
