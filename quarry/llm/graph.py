"""Connected components of a graph given as an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, written


def pointed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v, m of the edges (u, v), m being the least of u and its neighbours; and u, m alone.

    Every task takes the minimum of its own rows first. The minima are grouped by the node as
    text, another key than the join's: grouped by the node itself they would be
    dealt out as the join needs it, and adaptive execution could not split
    the rows of a node that has a large share of them.
    """
    kind = edges.schema["u"].dataType
    least = edges.groupBy(F.col("u").cast("string").alias("_u")).agg(F.min("v").alias("m"))
    least = least.select(F.col("_u").cast(kind).alias("u"), F.least(F.col("m"), F.col("_u").cast(kind)).alias("m"))
    return edges.join(least, "u"), least


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, root: every node of an edge with the least node of its component.

    Alternating large-star and small-star rounds; a node's edges are pointed at
    its least neighbour, see `pointed`. Each round is a written table. Null ends are left
    out; an empty table gives an empty result.
    """
    spark = edges.sparkSession

    def cleaned(e: DataFrame) -> DataFrame:
        return e.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = both.where(F.col("v") < F.col("u"))
        out, least = pointed(both)
        moved = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return cleaned(moved)

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(cleaned(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))), "edges")
    before = state(now)
    for _ in range(max_rounds):
        after_large = written(star(now, True), "edges")
        after = written(star(after_large, False), "edges")
        discard(spark, now, after_large)
        now, seen = after, state(after)
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
