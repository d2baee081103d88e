"""Spelling variants by symmetric deletion: words that share a key differ by one edit at most.

Every word emits itself and what is left of it without one code point. The keys
are 64-bit fingerprints, so a word of any length takes rows of a few bytes; rows
whose key is shared get their strings back and are told apart by them. Words
that are equal without their code point at the same place differ in that place
alone; a word that is another one without a code point is one deletion away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, written
from quarry.llm.textvec import _INV, _POW, mix, slices, string_buffer

#: What words are made of, and the letters that are lower-cased; fixed values.
LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, changed: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, n: the words of at least `least_length` code points with at least `least_count` occurrences in all texts.

    `changed(doc_id, word)` may give another word for an occurrence, of at most as
    many code points. Null texts have no words.
    """
    # a maximal run of enough letters; shorter ones can't become words
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))
    each = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(runs).alias("word"))
    if changed is not None:
        each = each.select(changed(F.col("doc_id"), F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keys(words: DataFrame) -> DataFrame:
    """key, place, first, word_id: of each word itself (place -1) and of each of its single deletions.

    Deletions from a run of equal letters are one string; the first of them says so.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            _, offsets = string_buffer(column)
            for lo, hi in slices(offsets):
                yield _emitted(batch.column("word_id").slice(lo, hi - lo), column.slice(lo, hi - lo).to_pylist())

    return words.select("word_id", "word").mapInArrow(emit, "key long, place int, first boolean, word_id long")


def _emitted(ids: pa.Array, words: list[str]) -> pa.RecordBatch:
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    start = end - size
    total = np.zeros(len(letters) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(letters * _POW(len(letters)), out=total[1:])
        shift = _INV(len(letters) + 2)
        whole = (total[end] - total[start]) * shift[start]
        owner = np.repeat(np.arange(len(words)), size)
        s, e, p = start[owner], end[owner], np.arange(len(letters))
        # what follows the place moves one to the left
        without = (total[p] - total[s]) * shift[s] + (total[e] - total[p + 1]) * shift[s + 1]
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (p[1:] == s[1:])
    keys = np.concatenate([mix(whole ^ mix(size.astype(np.uint64))), mix(without ^ mix((size[owner] - 1).astype(np.uint64)))]).view(np.int64)
    places = np.concatenate([np.full(len(words), -1), p - s]).astype(np.int32)
    which = np.concatenate([np.arange(len(words)), owner])
    columns = [pa.array(keys), pa.array(places), pa.array(np.concatenate([np.ones(len(words), bool), first])), ids.take(pa.array(which))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "place", "first", "word_id"])


def _near(words: DataFrame) -> DataFrame:
    """word, n_near and best: how many words are one edit away, and the most frequent of them as struct<less, form>.

    No pairs are written within a key: words that share a deletion and its place
    are at most as many as there are letters, and each needs only their number
    and the two best of them. Deletions that are words themselves are links.
    """
    shared = _keys(words).groupBy("key").agg(F.collect_list(F.struct("place", "first", "word_id")).alias("m")).where(F.size("m") > 1)
    # the strings decide: a fingerprint that two strings share is no link
    rows = shared.select(F.inline("m")).join(words, "word_id")
    place = F.col("place")
    left = F.when(place < 0, F.col("word")).otherwise(F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word"))))
    rows = written(rows.select(left.alias("left"), "place", "first", "word", "n"), "shared_keys")
    # frequent words first, then by code points
    one = F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"))
    same = rows.where(place >= 0).groupBy("left", "place").agg(F.sort_array(F.collect_list(one)).alias("m")).where(F.size("m") > 1)
    same = same.select((F.size("m") - 1).cast("long").alias("k"), F.get("m", F.lit(0)).alias("b1"), F.get("m", F.lit(1)).alias("b2"), F.explode("m.form").alias("word"))
    replaced = same.select("word", "k", F.when(F.col("b1.form") == F.col("word"), F.col("b2")).otherwise(F.col("b1")).alias("best"))
    shorter = rows.where(place < 0).select("left", one.alias("short"))
    longer = rows.where((place >= 0) & F.col("first")).select("left", one.alias("long"))
    links = longer.join(shorter, "left")
    cut = links.select(F.col("long.form").alias("word"), F.lit(1).cast("long").alias("k"), F.col("short").alias("best"))
    added = links.select(F.col("short.form").alias("word"), F.lit(1).cast("long").alias("k"), F.col("long").alias("best"))
    return replaced.unionByName(cut).unionByName(added).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of a table of words and how often they occur.

    A word's form is the most frequent word one edit away (an inserted, deleted or
    replaced code point), if it is at least `ratio` times as frequent; of equally
    frequent ones the first in code-point order. The root is where the forms lead
    to, for a word without one the word itself. Forms get more frequent from step
    to step, so they can't go in circles if `ratio` is over 1.

    Null words are left out; rows that repeat a word add up; an empty table gives
    an empty result. A word of any length takes time in proportion to it. Other
    columns are not looked at.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than what they stand for")
    each = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    each = written(each.withColumn("word_id", F.monotonically_increasing_id()), "words")
    found = each.select("word", "n").join(_near(each), "word", "left")
    best_n = -F.col("best.less")
    has = F.coalesce(best_n >= ratio * F.col("n"), F.lit(False))
    out = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, best_n).alias("form_n")), "forms")
    roots = _roots(out.where(F.col("form").isNotNull()).select("word", "form"))
    rooted = out.join(roots, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words with a form. Each round doubles the steps taken; a root that has no form is settled."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        there = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(now.join(there, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(now.sparkSession, now)
        now = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return now


def damaged(doc_id: Column, word: Column, one_in: int = 199) -> Column:
    """The word, or in one of `one_in` occurrences the word without one code point: a fixed choice by a checksum of both."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
