"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.columns import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 for empty vectors or a zero norm."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def of(x: Column) -> Column:
        both = x["p"]
        dot = _sum(F.transform(both, lambda p: p["u"] * p["v"]))
        norms = F.sqrt(_sum(F.transform(both, lambda p: p["u"] * p["u"]))) * F.sqrt(_sum(F.transform(both, lambda p: p["v"] * p["v"])))
        return F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))

    def cut(u: Column, v: Column) -> Column:
        n = F.least(F.size(u), F.size(v))
        return F.struct(F.zip_with(F.slice(u, F.lit(1), n), F.slice(v, F.lit(1), n), lambda x, y: F.struct(x.alias("u"), y.alias("v"))).alias("p"))

    return F.when((F.size(a) > 0) & (F.size(b) > 0), let(cut(a, b), of)).otherwise(F.lit(0.0))


def parsed_embedding(text: Column) -> Column:
    """A JSON array of numbers; an empty array for anything else."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def nonzero(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def l2_normalised(vector: Column) -> Column:
    """A vector of norm 1; a zero vector stays as it is."""

    def of(v: Column) -> Column:
        return let(F.sqrt(_sum(F.transform(v, lambda x: x * x))), lambda n: F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(F.lit(1.0))))

    return let(vector, of)
