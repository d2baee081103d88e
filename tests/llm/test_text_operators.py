"""Quality, PII, repeats, SimHash, decontamination and packing against plain versions, edge cases included."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing, pii, positional, quality, simhash, substring
from tests.llm import brute

LONG = " ".join(f"w{i % 7}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
EDGE = [
    (1, "plain words here, nothing else"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "x1 y1 " + PASSAGE + " z1"),
    (7, "x2 " + PASSAGE + " z2 z3"),
    (7, "x2 " + PASSAGE + " z2 z3"),
    (None, "x2 " + PASSAGE + " z2 z3"),
    (8, "same " * 36),
    (9, "u " * 35),
    (10, "Line one here\nLine one here\n\nLine one here # | <b>"),
    (11, "Émile ÀÉ straße 😀 a b   c"),
    (12, "a@b.co_x@y.com x@y 1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 4111 1111 1111 1111 😀 4111-1111-1111-1111 +1 (234) 567-8900."),
    (13, "9" * 20000 + " " + "a" * 20000 + "@"),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").withColumn("doc_id", F.col("doc_id") + 1000)
    edge = spark.createDataFrame([(i, t, None) for i, t in EDGE], "doc_id long, text string, source string")
    # names that clash with what the operators use inside
    return real.unionByName(edge).withColumn("key", F.lit("k")).withColumn("n_words", F.lit(-1)).withColumn("_text", F.lit("t"))


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


def same(found, expected):
    assert Counter(found) == Counter(expected)


def empty(docs):
    return docs.limit(0)


def test_quality(docs, rows):
    out = quality.with_quality(docs, carry=["doc_id", "n_words"]).collect()  # a carried column of a measure's name gives way
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out], [(r.doc_id, *brute.quality(r.text)) for r in rows])
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
    assert all(not (r.kept and r.base_failed) for r in out)
    assert "n_words" in docs.columns and quality.with_quality(empty(docs)).count() == 0
    whole = quality.with_quality(docs)
    assert whole.columns.count("n_words") == 1 and dict(whole.dtypes)["n_words"] == "bigint" and set(docs.columns) - {"text"} <= set(whole.columns)
    clash = docs.withColumn("kept", F.lit("x")).withColumn("_host", F.lit("y")).withColumn("_row", F.lit("z")).withColumn("base_failed", F.lit(0))
    same([r.doc_id for r in quality.kept_documents(clash).collect()], [r.doc_id for r in whole.where("kept").collect()])
    assert quality.kept_documents(clash).columns == clash.columns


def test_hosts_lose_all_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "bad" if i < 40 else "fine", "too short" if i < 36 or i == 40 else good) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id for r in quality.with_quality(docs).where("kept").collect()}
    assert kept == set(range(41, 80))
    assert {r.doc_id for r in quality.kept_documents(docs).collect()} == kept
    assert quality.kept_documents(docs).columns == docs.columns
    shuffled = quality.kept_documents(docs, rules=quality.Rules(broadcast_hosts=-1))
    assert {r.doc_id for r in shuffled.collect()} == kept


def test_pii_base_spans(docs, rows):
    out = pii.all_spans(docs).collect()
    found = [(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in out]
    same(found, [(r.doc_id, tuple(brute.pii(r.text))) for r in rows])
    assert pii.all_spans(empty(docs)).count() == 0


def test_pii_terms_that_disclose(spark):
    near = ["Ada Wonder wrote from ada@lace.org about tea", "Mail by Wonder sent via ada@lace.org today", "Ask Wonder or ada@lace.org for help"]
    filler = [f"unrelated text about tea and help today number {i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate([*near, near[0], *filler])], "doc_id long, text string, n_chars long")
    spans = {r.doc_id: [s.value for s in r.term_spans] for r in pii.all_spans(docs).collect()}
    assert all(spans[i] == ["Wonder"] for i in range(4)) and not any(spans[i] for i in range(4, 64))
    clean = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert clean[2].text == "Ask  or [EMAIL] for help" and clean[2].n_chars == len(clean[2].text)
    assert clean[10].text == filler[6]
    # copies of one text are one context: they disclose nothing by themselves
    copies = spark.createDataFrame([(i, near[0]) for i in range(9)] + [(100 + i, t) for i, t in enumerate(filler)], "doc_id long, text string")
    assert not any(r.term_spans for r in pii.all_spans(copies).collect())


@pytest.mark.parametrize("group_rows", [20_000, 20, 0])
def test_repeats(docs, rows, group_rows):
    out = substring.without_repeats(docs, group_rows=group_rows).collect()
    expected = brute.repeats([r.text for r in rows])
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out], [(r.doc_id, *e) for r, e in zip(rows, expected, strict=True)])
    assert all(r.n_removed == sum(e - s for s, e in r.removed) for r in out)


def test_repeats_of_a_hot_passage(spark):
    """A passage in very many documents, each in a context of its own, and one group of copies."""
    texts = [f"a{i} b{i} {PASSAGE} c{i} d{i}" for i in range(1500)] + ["copy " + LONG] * 300 + [f"own {i} " + " ".join(f"v{i}x{j}" for j in range(40)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute.repeats(texts)
    for group_rows in (20_000, 50):
        out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(docs, group_rows=group_rows, with_text=False).collect()}
        assert [out[i] for i in range(len(texts))] == expected
    assert substring.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [20_000, 0])
def test_repeats_in_a_group_of_many_single_windows(spark, group_rows):
    """Thousands of windows that share a gram, in pairs, and thousands that are all the same."""
    common = " ".join(f"c{i}" for i in range(11))
    texts = [f"{common} u{i % 7000}" for i in range(12_000)] + ["e " * 11 + "f"] * 9000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(docs, 12, 11, group_rows=group_rows, with_text=False).collect()}
    assert [out[i] for i in range(len(texts))] == brute.repeats(texts, 12)


def test_simhash(docs, rows):
    out = simhash.near_duplicates(docs).collect()
    prints = [brute.simhash(r.text) for r in rows]
    least = brute.components(prints, [r.doc_id for r in rows])
    same([(r.doc_id, r._fp % (1 << 64), r.component_id) for r in out], [(r.doc_id, p, c) for r, p, c in zip(rows, prints, least, strict=True)])
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_simhash_chains_and_odd_radius(spark):
    base = 0x0123456789ABCDEF
    chain = [base]
    for k in range(20):
        chain.append(chain[-1] ^ (3 << (3 * k)))
    signed = [p - (1 << 64) if p >> 63 else p for p in [*chain, base ^ (7 << 40), ~base % (1 << 64)]]
    prints = spark.createDataFrame([(p,) for p in signed], "_fp long")
    pairs = {(r.a, r.b) for r in simhash.links(prints, 2).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs) and len(pairs) >= 20
    roots = {r.node: r.root for r in simhash.components(simhash.links(prints, 2)).collect()}
    assert len({roots[p] for p in signed[:21]}) == 1
    odd = {(r.a, r.b) for r in simhash.links(prints, 3).collect()}
    assert (min(signed[0], signed[21]), max(signed[0], signed[21])) in odd


def test_one_of_each(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    least = brute.components([brute.simhash(r.text) for r in rows], [r.doc_id for r in rows])
    found = kept.select("doc_id").collect()
    same([r.doc_id for r in found], set(least))


def test_decontamination(spark, sf_dir, docs, rows, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(900, "w1 w2"), (901, "Plain"), (902, None), (903, ""), (904, "?!"), (None, "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11"), (900, "u u")], "item_id long, text string")
    items = bench.unionByName(more)
    expected = brute.contamination([r.text for r in rows], [(r.item_id, r.text) for r in items.collect()])
    wanted = [(r.doc_id, n, h, tuple(i)) for r, (n, h, i) in zip(rows, expected, strict=True)]
    index = positional.build_index(docs, segment_words=5000)
    same([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in positional.phrases(index, items).collect()], wanted)
    whole, parts = (positional.matches(index, items, block_words=n) for n in (2_000_000, 50))
    same([(r.doc_id, r.n_words, r.n_hit, tuple(r["hit_items"])) for r in parts.collect()], wanted)
    same([tuple(map(str, r)) for r in whole.collect()], [tuple(map(str, r)) for r in parts.collect()])
    monkeypatch.setattr(positional, "_WINDOWS", 7)
    monkeypatch.setattr(positional, "_CANDIDATES", 3)
    same([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in positional.phrases(index, items).collect()], wanted)
    assert positional.phrases(positional.build_index(empty(docs)), items).count() == 0
    assert all(r.n_hit == 0 for r in positional.phrases(index, items.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zeta x x alpha x beta x"), (2, "zeta " + "x " * 50 + "alpha beta"), (3, "alpha beta zeta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta zeta")], "item_id long, text string")
    index = positional.build_index(docs)
    found = {r.doc_id: r for r in positional.matches(index, items, slop=6).collect()}
    assert [(found[i].n_near, found[i].near_items, found[i].n_hit) for i in (1, 2, 3)] == [(1, ["1"], 0), (0, [], 0), (1, ["1"], 3)]
    assert {r.doc_id for r in positional.phrases(index, items).where("n_hit > 0").collect()} == {3}


def test_clean_documents(docs, spark):
    items = spark.createDataFrame([(1, "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11")], "item_id long, text string")
    clean = positional.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 4


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    out = packing.packed(docs, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    wanted = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [packing.END])) for r in rows)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for p in out:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        sequences[p.sequence_id].append(p)
        pieces[p.doc_id].append((p.start, p.doc_tokens, tuple(ids)))
    padding = 0
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding == 0
    for doc_id, ids in wanted:
        parts = pieces[doc_id]
        # repeated rows have equal pieces or are cut differently: every id of every copy is there once
        assert sum(len(p[2]) for p in parts) == sum(len(i) * n for (d, i), n in wanted.items() if d == doc_id)
        if wanted[doc_id, ids] == 1 and sum(d == doc_id for d, _ in wanted) == 1:
            assert sum((p[2] for p in sorted(parts)), ()) == ids
    assert packing.packed(empty(docs)).count() == 0
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed_by"]
    for limit in (100_000, -1):
        assert sorted(map(str, packing.packed(docs, broadcast_rows=limit).select(columns).collect())) == sorted(map(str, packing.packed(docs, with_ids=True).select(columns).collect()))


def test_the_rule_fills_most_sequences(spark):
    """On sf0.1 in eight or more splits; drains in between leave whole results too."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    tokens = packing.encoded(docs)
    pieces = packing.placed(tokens).cache()
    share = {r.closed_by: r.n for r in pieces.groupBy("closed_by").agg(F.countDistinct("sequence_id").alias("n")).collect()}
    assert share["rule"] + share["whole"] > 0.8 * sum(share.values()) and share["rule"] > 0.8 * (share["rule"] + share["drain"])
    often = packing.placed(tokens, task_docs=700)
    for out in (pieces, often):
        assert out.agg(F.sum("length")).first()[0] == tokens.agg(F.sum("tokens")).first()[0]
        fills = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n != {packing.CAPACITY}")
        assert fills.where("n & (n - 1) != 0").count() == 0


def test_sum_of_squares_places_where_the_sum_is_least():
    closed = []
    packer = packing.SumOfSquares(10, lambda window, by: closed.append((window, by)))
    rng = np.random.default_rng(1)
    for size in rng.integers(1, 10, 300).tolist():
        before = packer.count.copy()
        best = None
        for level in range(0, 11 - size):
            if level and not before[level]:
                continue
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 10:
                after[level + size] += 1
            total = int((after**2).sum())
            best = total if best is None else min(best, total)
        packer.place("x", size)
        assert int((packer.count**2).sum()) == best
    packer.drain(lambda piece, n: (piece, piece))
    assert not packer.count.any()
