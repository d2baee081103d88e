"""The pipeline's near-copy stage against all pairs of shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline
from quarry.llm import minhash


def least_of_groups(texts):
    """The least index of each component of the pairs with a similarity of at least 4/5."""

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if root[a] != root[b] and (sets[a] == sets[b] or 9 * common >= 4 * (len(sets[a]) + len(sets[b]))):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def test_near_copies_with_a_few_changed_words(spark, sf_dir):
    rng = random.Random(3)
    texts = [None, "", " \n", "One two", "one  TWO", "one two three"]
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 100, 300]))]
        texts.append(" ".join(words))
        for changed in (1, 2, 3, 4, 6):  # about 5 shingles each, so that some are under the similarity and some in chains
            words = list(words)
            for _ in range(changed):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    expected = least_of_groups(texts)
    kept = corpus_pipeline.simhash_dedup(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == expected and kept.columns == docs.columns
    twice = minhash.one_of_each(docs.unionByName(docs), broadcast_keys=-1)
    assert sorted(r.doc_id for r in twice.collect()) == sorted(expected)
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_fingerprints_meet_in_halves(spark):
    """All within five bits meet, whatever the bits; those far apart do not."""
    from quarry.llm import simhash

    rng = random.Random(5)
    prints, pairs = [], []
    for k in range(60):
        word = rng.getrandbits(64)
        other = word
        for bit in rng.sample(range(64), k % 6):
            other ^= 1 << bit
        pairs.append((2 * k, 2 * k + 1))
        prints += [(2 * k, word), (2 * k + 1, other)]
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints], "f long, p long")
    assert {tuple(sorted((r.a, r.b))) for r in simhash.met_in_halves(table, "f", "p").collect()} == set(pairs)


def test_the_stage_makes_fingerprints(spark):
    tagged = minhash.prints(spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "doc_id long, text string"), "text", ("doc_id",))
    made = {r.doc_id: r._sim for r in tagged.collect()}
    assert made[2] == 0 and made[1] not in (0, None)
