from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import spelling
from tests.llm.brute import ASCII_LOWER


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(n, ratio=5):
    """word -> (form, root, n, n_near, form_n)."""
    forms, counts = {}, {}
    for w in n:
        links = [x for x in n if near(w, x)]
        counts[w] = len(links)
        best = min(links, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return {w: (forms[w], root(w), n[w], counts[w], n[forms[w]] if forms[w] else None) for w in n}


def as_dict(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def plain_words(docs):
    out = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_random_words(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(400)}
    n = {w: rng.choice([1, 1, 2, 5, 10, 25, 26, 125, 700]) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_dict(spelling.variant_groups(table)) == plain_groups(n)


def test_chains_ties_repeats_and_nulls(spark):
    n = {"aaaaaaaa": 10_000, "aaaaaaab": 1000, "aaaaaabb": 100, "aaaaabbb": 10, "aaaabbbb": 1, "cabcabc": 50, "cabcabd": 50, "cabcabx": 2, "": 3, "q": 2, "ÿ": 90}
    rows = [(w, k, "x") for w, k in n.items()] + [(None, 5, "x"), ("q", 1, "y"), ("q", 2, "y")]
    found = as_dict(spelling.variant_groups(spark.createDataFrame(rows, "word string, n long, form string")))
    assert found == plain_groups(n | {"q": 5})
    assert found["aaaabbbb"][:2] == ("aaaaabbb", "aaaaaaaa") and found["cabcabx"][0] == "cabcabc"
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_words_of_any_length(spark):
    long = "abcdefghij" * 4000
    n = {long: 50, long[:-1]: 3, "x" + long: 2, long[:777] + "ß" + long[778:]: 1, long + "yz": 9}
    found = as_dict(spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert found == plain_groups(n) and found[long][3] == 3


def test_words_of_texts(spark):
    rng = random.Random(5)
    stems = ["Straße", "naïveté", "gardener", "gardeners", "ABCDEFG", "École", "pneumonia", "über", "×÷×÷×÷", "Ärmelkanal"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", ",", "'s", "1"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(1, texts[1]), (None, texts[2]), (7, None), (8, ""), (9, "gardener" * 5000)]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, word long")
    words = spelling.counted_words(table, changed=spelling.damaged)
    n = plain_words(docs)
    assert {r.word: r.n for r in words.collect()} == n
    assert as_dict(spelling.variant_groups(words)) == plain_groups(n)
    without = {r.word: r.n for r in spelling.counted_words(table, least_length=3, least_count=1).collect()}
    assert without["über"] > 0 and without["gardener" * 5000] == 1 and "École".translate(ASCII_LOWER) in without
    assert spelling.counted_words(table.where(F.lit(False))).count() == 0
