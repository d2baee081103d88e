"""The lexicon: exceptions that are learned, long texts, ties, clashing columns, against a plain version."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from quarry.llm import toxicity
from quarry.llm.letters import look_folded


def plain_total(lexicon, folded):
    """The weights that count, found by looking at every place and every entry."""
    covered = [(i, i + len(k)) for p in lexicon.exceptions for k in [f" {p} "] for i in range(len(folded)) if folded.startswith(k, i)]
    total = 0.0
    for i in range(len(folded)):
        found = [(len(e), w) for e, w in lexicon.weights.items() if folded.startswith(e, i)]
        if found and not any(s <= i and i + max(found)[0] <= e for s, e in covered):
            total += max(found)[1]
    return total


def test_matches_against_a_plain_version():
    rng = random.Random(2)
    words = ["abc", "abcd", "abcde", "xyz", "xyzz", "good", "bad"]
    lexicon = toxicity.Lexicon({" abc": 1.0, " abcd ": 2.0, " xyz ": 3.0, " bad ": 1.5, " ba": 0.5}, ["abcde", "good bad", "xyz abc good", "bad bad"])
    matcher = lexicon.matcher()
    for _ in range(200):
        folded = f" {' '.join(rng.choices(words, k=rng.randint(0, 9)))} "
        assert sum(w for *_, w in lexicon.matches(matcher, folded)) == pytest.approx(plain_total(lexicon, folded))


def test_many_matches_and_exceptions_take_time_in_proportion():
    lexicon = toxicity.Lexicon({" stupid": 5.0}, ["stupid question", "stupidity"])
    text = "stupid question stupidity stupid " * 100_000
    began = time.process_time()
    found = lexicon.features(lexicon.matcher(), text)
    assert time.process_time() - began < 10 and found[2] == pytest.approx(500_000 / 400_020)


def test_exception_phrases_are_learned(spark):
    """A word that is toxic but for one phrase, and a word that only begins like it."""
    texts = [(i, f"note {i} " + ("trash talk you trash" if i % 2 else {0: "throw the trash bin out", 10: "trashcan is full"}.get(i // 2 % 20, "all is well"))) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts], "doc_id long, text string, score string, y double")
    labels = spark.createDataFrame([(i, i % 2, "z") for i, _ in texts], "doc_id long, toxic int, text string")
    lexicon = toxicity.trained(docs, labels)
    matcher = lexicon.matcher()
    found = lambda t: sum(w for *_, w in lexicon.matches(matcher, look_folded(t)))
    exceptions = {look_folded(e).strip() for e in lexicon.exceptions}
    assert any(" " in e for e in exceptions)
    assert found("you trash") > 0 and found("the trash bin") == 0 and found("a trashcan") == 0
    out = {r.doc_id: r for r in toxicity.scored(docs, lexicon).collect()}
    assert all(out[i].predicted == i % 2 for i, _ in texts) and toxicity.scored(docs, lexicon).columns == ["doc_id", "score", "predicted"]


def test_equal_texts_have_equal_scores(spark):
    lexicon = toxicity.Lexicon({" trash ": 3.0}, [], np.array([0.0, 0, 0, 0, 0]))
    docs = spark.createDataFrame([(1, "trash"), (1, "trash"), (2, "fine"), (None, None)], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in toxicity.scored(docs, lexicon).collect()] == [(0.5, 1)] * 4


ORDINARY = ["The train to work takes more time over the distance.", "We discussed the path of the moral story with distant workers.", "A trader sold tracks, morning papers and workshop tools.", "Idiomatic words about patterns and disks."]


def test_beginnings_need_several_words(spark):
    """Words of one form are entries as they are; a stem with many endings is one; ordinary English scores low."""
    rng = random.Random(11)
    plain = "the report says that many people met in town and talked about rain food music and games for hours".split()
    single = ["trash", "moron", "pathetic", "disgusting", "worthless", "idiot"]
    texts = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(single) if i % 2 else "zorbl" + rng.choice(["", "ing", "ed", "ette", "or", "ix", "um", "an"]))
        texts.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    # labels of documents that aren't there, and labels more than once
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] * 2 + [(10_000 + i, 1) for i in range(5000)], "doc_id long, toxic int")
    lexicon = toxicity.trained(docs, labels)
    assert set(lexicon.weights) == {f" {look_folded(w).strip()} " for w in single} | {f" {look_folded('zorbl').strip()}"}
    rows = [(i, t) for i, t in enumerate(ORDINARY)] + [(10, "you moron"), (11, "zorblish things you say"), (12, "w0rthless and disgu5ting")]
    found = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()}
    assert all(found[i] < 0.2 for i in range(len(ORDINARY))) and all(found[i] > 0.5 for i in (10, 11, 12))


def test_ordinary_english_after_the_given_labels(spark, sf_dir):
    from quarry.llm.common import read_table

    lexicon = toxicity.trained(read_table(spark, sf_dir.replace("sf0.001", "sf0.1"), "documents"), read_table(spark, sf_dir.replace("sf0.001", "sf0.1"), "labels"))
    assert all(len(e) >= 5 for e in lexicon.weights)
    rows = spark.createDataFrame(list(enumerate(ORDINARY)), "doc_id long, text string")
    assert all(r.score < 0.2 for r in toxicity.scored(rows, lexicon).collect())
