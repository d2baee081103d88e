"""Terms that disclose protected values: rare support, whole documents, groups of copies."""

from __future__ import annotations

import math
import random
import re
import time

import pytest

from quarry.llm import pii
from tests.llm import brute

FILLER = [(5000 + i, f"unrelated text about tea and help today number {i}") for i in range(120)]


def terms(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts), *FILLER], "doc_id long, text string")
    return {r.doc_id: [s.value for s in r.term_spans] for r in pii.all_spans(docs).collect() if r.doc_id < 5000}


def test_a_term_of_two_documents_far_from_the_value(spark):
    """Two texts of one value, and two values used once each; words of one text only stay."""
    far = " tea and help today" * 20
    found = terms(spark, [f"Wonder was here{far} ada@lace.org", f"ada@lace.org{far} says Wonder", f"Byron once{far} +1 234 567 8900", f"george@sea.org{far} for Byron"])
    assert found == {0: ["Wonder"], 1: ["Wonder"], 2: ["Byron"], 3: ["Byron"]}


def test_a_large_group_of_copies_counts_once(spark):
    near = ["Ada Wonder wrote from ada@lace.org about tea", "Mail by Wonder sent via ada@lace.org today", "Ask Wonder or ada@lace.org for help"]
    assert terms(spark, near) == {i: ["Wonder"] for i in range(3)}
    assert terms(spark, near + [near[0]] * 600) == {i: ["Wonder"] for i in range(603)}


def test_words_beside_values_by_chance_disclose_nothing(spark):
    """A word in every twentieth text, one in twenty of them with a value: at any size."""
    for size in (400, 4000):
        docs = spark.createDataFrame([(i, f"chance {i}" if i % 20 == 0 else f"text {i}") for i in range(size)], "doc_id long, text string")
        docs = docs.selectExpr("doc_id", "if((doc_id * 7) % 20 = 0 and (doc_id div 20) % 20 = 0 or doc_id % 20 = 3, text || ' u' || doc_id || '@ab.c', text) AS text")
        assert not any(r.term_spans for r in pii.all_spans(docs).collect())


def plain_shares(texts, shrinkage=2.0):
    """entity and term to share, by counting in plain loops."""
    distinct = sorted({t or "" for t in texts})
    entities = [{_entity(k, t[s:e]) for k, s, e in brute.pii(t)} for t in distinct]
    words = [set(re.findall(r"[^\W\d_]{3,}", re.sub(brute.PII["email"], " ", t).lower())) for t in distinct]
    n, out = len(distinct), {}
    for c in set().union(*entities):
        n_c = sum(c in e for e in entities)
        for t in set().union(*words):
            n_t, n_ct = sum(t in w for w in words), sum(t in w and c in e for w, e in zip(words, entities, strict=True))
            m_t = sum(t in w and bool(e) for w, e in zip(words, entities, strict=True))
            if n_ct and n_c < n:
                out[c, t] = m_t / n_t * m_t**2 / (m_t**2 + shrinkage) * math.log(n * n_ct / (n_c * n_t)) / math.log(n / n_c)
    return out


def _entity(kind, value):
    return f"{kind}:{re.sub('[^0-9]', '', value) if kind in ('card', 'phone') else value.lower()}"


@pytest.mark.parametrize("limit", [200_000, -1])
def test_shares_against_plain_counts(spark, limit):
    rng = random.Random(5)
    names, values = ["ada", "byron", "wonder", "lace", "tea", "élan"], ["ada@lace.org", "x@y.org", "+1 234 567 8900", "10.0.0.1", "4111 1111 1111 1111"]
    pairs = dict(zip(names, values, strict=False))
    with_name = lambda n: f"{n} {pairs[n]} {rng.choice(names)}" if n in pairs and rng.random() < 0.8 else n
    texts = [f"{with_name(rng.choice(names))} {rng.choice(['the', 'and', 'of'])} {i}" for i in range(60)]
    texts += [texts[0]] * 30 + [t for _, t in FILLER] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.entity, r.term): r.share for r in pii.disclosing_terms(docs, pii.found_spans(docs), broadcast_keys=limit).collect()}
    expected = {k: v for k, v in plain_shares(texts).items() if v >= 0.5}
    assert expected and found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in found)


def test_terms_become_the_class_of_what_they_disclose(spark):
    texts = [f"{n} has {v} here" for n, v in (("Byron", "+1 234 567 8900"), ("Wonder", "ada@lace.org")) for _ in range(2)]
    texts = [f"{t} {i}" for i, t in enumerate(texts)] + ["Byron at sea", "Wonder at sea"]
    docs = spark.createDataFrame([*enumerate(texts), *FILLER], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, pii.Disclosure(generalise_at=0.3, remove_at=0.9)).collect()}
    assert clean[0].startswith("[PHONE-TERM]") and clean[2].startswith("[EMAIL-TERM]") and "[PHONE]" in clean[1] and "[EMAIL]" in clean[3] and clean[4] == "Byron at sea"


def test_many_matches_take_time_in_proportion(spark):
    n = 100_000
    texts = [" ".join(f"u{i}@ab.c" for i in range(n)), " ".join(["+1 234 567 8900, 4111 1111 1111 1111, 10.0.0.1,"] * (n // 10))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.all_spans(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert time.monotonic() - began < 90
    assert spans == {i: brute.pii(t) for i, t in enumerate(texts)}
    assert clean[0] == " ".join(["[EMAIL]"] * n) and clean[1].count("[PHONE]") == n // 10 and "1111" not in clean[1]
