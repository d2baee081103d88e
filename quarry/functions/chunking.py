"""Cutting texts into overlapping chunks of whole lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import let
from quarry.functions.text import text_hash

CHARS_PER_TOKEN = 4
TOKENS, OVERLAP = 256, 32


def _segments(text: Column, most: int) -> Column:
    """Each line in pieces of at most `most` characters, with its number; an empty line is one empty piece."""

    def of_line(line: Column, i: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / most).cast("int") - 1, F.lit(0))), lambda k: F.substring(line, k * most + 1, F.lit(most)))
        return F.transform(pieces, lambda p: F.struct(p.alias("t"), (i + 1).alias("n")))

    return F.flatten(F.transform(F.split(text, "\n", -1), of_line))


def chunk_ranges(sizes: Column, most: int, overlap: int) -> Column:
    """(lo, hi) segment ranges: a chunk ends before a segment that would take it over `most`; the next one starts with the
    last segments that have `overlap` characters together. A fold over the segments whose state is where the chunk starts."""

    def ranges(s: Column) -> Column:
        none = F.expr("cast(array() as array<struct<lo:int,hi:int>>)")
        start = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("cur"), none.alias("out"))
        indexed = F.transform(s, lambda x, i: F.struct(x.alias("s"), i.alias("i")))

        def carried(a: Column, i: Column) -> Column:
            if overlap <= 0:
                return F.struct(i.alias("j"), F.lit(0).alias("acc"))
            behind = F.reverse(F.slice(s, a["lo"] + 1, i - a["lo"]))
            return F.aggregate(behind, F.struct(i.alias("j"), F.lit(0).alias("acc")), lambda k, x: F.when(k["acc"] >= overlap, k).otherwise(F.struct((k["j"] - 1).alias("j"), (k["acc"] + x).alias("acc"))))

        def step(a: Column, x: Column) -> Column:
            full = (a["cur"] + x["s"] > most) & (x["i"] > a["lo"])
            done = F.concat(a["out"], F.array(F.struct(a["lo"].alias("lo"), (x["i"] - 1).alias("hi"))))
            flushed = let(carried(a, x["i"]), lambda k: F.struct(k["j"].alias("lo"), (k["acc"] + x["s"]).alias("cur"), done.alias("out")))
            return F.when(full, flushed).otherwise(F.struct(a["lo"].alias("lo"), (a["cur"] + x["s"]).alias("cur"), a["out"].alias("out")))

        return F.aggregate(indexed, start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["lo"].alias("lo"), (F.size(s) - 1).alias("hi")))))

    return let(sizes, ranges)


def chunks(text: Column, tokens: int = TOKENS, overlap: int = OVERLAP) -> Column:
    """An array of start_line, end_line, text and hash. An empty text is one empty chunk; pieces of a long line are joined by line ends."""
    most, over = max(32, tokens * CHARS_PER_TOKEN), max(0, overlap * CHARS_PER_TOKEN)

    def of(seg: Column) -> Column:
        sizes = F.transform(seg, lambda x: F.length(x["t"]) + 1)

        def one(r: Column) -> Column:
            body = F.array_join(F.transform(F.slice(seg, r["lo"] + 1, r["hi"] - r["lo"] + 1), lambda x: x["t"]), "\n")
            return let(body, lambda b: F.struct(F.get(seg, r["lo"])["n"].alias("start_line"), F.get(seg, r["hi"])["n"].alias("end_line"), b.alias("text"), text_hash(b).alias("hash")))

        return F.transform(chunk_ranges(sizes, most, over), one)

    return let(_segments(text, most), of)


def chunked(docs: DataFrame, text: str = "text", tokens: int = TOKENS, overlap: int = OVERLAP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per chunk: the kept columns, ordinal, start_line, end_line, text and hash."""
    rows = docs.where(F.col(text).isNotNull()).select(*keep, F.posexplode(chunks(F.col(text), tokens, overlap)).alias("ordinal", "_c"))
    return rows.select(*keep, "ordinal", "_c.start_line", "_c.end_line", "_c.text", "_c.hash")
