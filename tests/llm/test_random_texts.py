"""Random texts from small alphabets, where matches, ties and repeats are frequent, against the plain versions."""

from __future__ import annotations

import random

import pytest

from quarry.llm import packing, pii, positional, quality, simhash, substring
from tests.llm import brute


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(5)
    pieces = ["a", "b.", "@", "x-y", ".", "_", "%", "+", "1", "22", "255", "256", "0", "4111", "1111", " ", "-", "(", ")", "\n", "é", "😀", "+1 234", "a@b.c", "1.2.3.4", "4111 1111 1111 1111"]
    return ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(3000)]


@pytest.fixture(scope="module")
def word_texts():
    rng = random.Random(6)
    vocabulary = ["a", "bb", "ccc", "d,", "É", "the"]
    space = [" ", "  ", "\n", "\t", " ", "\x0b", "\n\n"]
    out = []
    for _ in range(500):
        words = rng.choices(vocabulary[: rng.randint(1, 6)], k=rng.randint(0, 120))
        out.append("".join(w + rng.choices(space, [20, 2, 3, 1, 1, 1, 1])[0] for w in words))
    return out


def test_pii(spark, strings):
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.all_spans(frame(spark, strings)).collect()}
    for i, t in enumerate(strings):
        assert found[i] == brute.pii(t), t
        for s in found[i]:
            assert t[s[1] : s[2]]


def test_quality(spark, word_texts, strings):
    texts = word_texts + strings
    out = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measured(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert out[i] == brute.quality(t), t


@pytest.mark.parametrize("window,gram,group_rows", [(35, 10, 20_000), (12, 4, 30), (12, 4, 0), (5, 5, 3), (3, 1, 50)])
def test_repeats(spark, word_texts, window, gram, group_rows):
    expected = brute.repeats(word_texts, window)
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(frame(spark, word_texts), window, gram, group_rows=group_rows, with_text=False).collect()}
    assert [out[i] for i in range(len(word_texts))] == expected


def test_simhash(spark, word_texts):
    texts = word_texts[:300]
    prints = [brute.simhash(t) for t in texts]
    least = brute.components(prints, list(range(len(texts))))
    out = {r.doc_id: (r._fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == list(zip(prints, least, strict=True))


@pytest.mark.parametrize("window", [10, 3, 1])
def test_decontamination(spark, word_texts, window):
    items = [(i, t) for i, t in enumerate(word_texts[::60])] + [(50, "the"), (51, "a bb"), (52, "É É É")]
    texts = word_texts[:200]
    expected = brute.contamination(texts, items, window)
    index = positional.build_index(frame(spark, texts), segment_words=700)
    out = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in positional.phrases(index, spark.createDataFrame(items, "item_id long, text string"), window).collect()}
    assert [out[i] for i in range(len(texts))] == expected


@pytest.mark.parametrize(("window", "slop"), [(10, 20), (3, 2), (2, 40)])
def test_proximity(spark, word_texts, window, slop):
    items = [(str(i), t) for i, t in enumerate(word_texts[::60])] + [("50", "the"), ("51", "a bb a")]
    texts = word_texts[:200]
    index = positional.build_index(frame(spark, texts), segment_words=700)
    out = {r.doc_id: (r.n_near, r.near_items) for r in positional.matches(index, spark.createDataFrame(items, "item_id string, text string"), window, slop=slop).collect()}
    for i, text in enumerate(texts):
        words, places, near = brute.bench_words(text), set(), set()
        for item, t in items:
            w = brute.bench_words(t)
            n = min(window, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                at = {j for j, x in enumerate(words) if x == w[k] and set(w[k : k + n]) <= set(words[max(0, j - slop) : j + slop + 1])}
                places |= at
                near |= {item} if at else set()
        assert out[i] == (len(places), sorted(near))


def test_encoding(strings, word_texts):
    """The quick path gives the tokenizer's own ids, and keeps doing so when what it has kept is dropped."""
    encoder = packing.Encoder(packing.default_vocabulary())
    extra = ["it's IT'S we'll ''ll x's3 don't\x85stop", "naïve café ÀÉÎ ß ÿ ŉ İI ı", "a<|endoftext|>b", "²³ ½ ª º × ÷", "\x1c\x1d a\x00b", "日本 한국 العربية", "é Å"]
    texts = strings[:400] + word_texts[:100] + extra
    plain = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for at in range(0, len(texts), 50):
        assert [x.tolist() for x in encoder.encode(texts[at : at + 50])] == plain[at : at + 50]
        if at % 100:
            encoder._forget()
