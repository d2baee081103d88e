"""Language, toxicity, WARC and page extraction; the registered queries against their SQL; the pipeline."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import extraction, language, letters, queries, toxicity, warc
from quarry.llm.common import document_fold
from tests.llm import brute
from tests.llm.test_near_copies import least_of_groups
from tests.oracle import connect, differences

BIGGER = "/root/testdata/sf0.01"


# --- language ---


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet")
    return docs, language.trained(language.training_rows(docs, document_fold()))


def test_languages_of_held_out_documents(model):
    docs, trained = model
    found = language.identified(docs, trained, carry=("doc_id", "lang")).where(document_fold() == 0)
    right, n, low, high = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert n > 100 and right > 0.97 and 0 <= low <= high <= 1


def test_language_edges(spark, model):
    _, trained = model
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (None, "the of and that is"), (4, "the " * 400_000), (5, "x")]
    out = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string"), trained).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3))
    assert out[4].lang_pred == out[None].lang_pred == "en" and out[5].lang_pred in trained.languages
    blank = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.trained(blank) is None
    assert language.identified(blank, None).first().lang_pred == "und"
    one = language.trained(blank.withColumn("lang", F.lit("xx")))
    assert tuple(language.identified(blank, one).first())[1:3] == ("xx", 1.0)
    assert language.identified(blank.limit(0), trained).count() == 0


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 12, 60):
        code = language.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k == 2 else 2) and (np.abs(code.sum(axis=0)) < k).all()


def test_errors_of_single_bits_are_corrected():
    """One classifier that is wrong does not change the language: the nearest codeword still is the right one."""
    code = language.codewords(4)
    weights = np.concatenate([code.astype(np.float32) * 4, np.zeros((1, code.shape[1]), np.float32)])
    trust = np.full(code.shape, 1 / code.shape[1])
    for bit in range(code.shape[1]):
        wrong = weights.copy()
        wrong[:, bit] *= -1
        best, _, _ = language.Model(list("abcd"), code, wrong, trust).predict(np.eye(4, dtype=np.float32))
        assert best.tolist() == [0, 1, 2, 3]
    _, _, unsure = language.Model(list("abcd"), code, weights, trust).predict(np.array([[0.5, 0.5, 0, 0], [1, 0, 0, 0]], np.float32))
    assert unsure.tolist() == [True, False]


def test_texts_are_judged_as_a_whole(model):
    """Sentences of another language at both ends do not outvote the text between them."""
    docs, trained = model
    texts = {r.lang: r.t for r in docs.where(F.length("text") > 1500).groupBy("lang").agg(F.min("text").alias("t")).collect()}
    for a in ("en", "fr"):
        for b in set(texts) - {a}:
            frame, body = texts[b][:250], " ".join(r.text for r in docs.where((F.col("lang") == a) & (F.length("text") > 900)).orderBy("doc_id").limit(3).collect())[:2800]
            best, _, _ = trained.predict(language.scaled(np.stack([language.counts(f"{frame} {body} {frame}")])))
            assert trained.languages[best[0]] == a


def test_decoding_against_plain_loops():
    rng = np.random.default_rng(3)
    for k in (2, 4, 7):
        code = language.codewords(k)
        bits = code.shape[1]
        weights, trust = rng.normal(size=(9, bits)), rng.random((k, bits))
        trust /= trust.sum(axis=1, keepdims=True)
        x = rng.normal(size=(20, 8))
        best, score, unsure = language.Model([str(i) for i in range(k)], code, weights, trust).predict(x)
        for r in range(len(x)):
            margins = [sum(x[r, f] * weights[f, b] for f in range(8)) + weights[8, b] for b in range(bits)]
            loss = [sum(trust[c, b] * np.log(1 + np.exp(-margins[b] * code[c, b])) for b in range(bits)) for c in range(k)]
            near = sorted(loss)
            assert best[r] == loss.index(near[0]) and unsure[r] == (near[1] - near[0] < language.AMBIGUITY * sum(loss) / k)
            assert score[r] == pytest.approx(1 / sum(np.exp(-4 * (v - near[0])) for v in loss))


def test_every_language_is_learned(spark):
    """Also one row among thousands, repeated rows and ids, and training on few rows."""
    rows = [(i, f"the and of that is {i}", "en") for i in range(3000)] + [(5000, "der und das ist nicht", "de")] + [(6000, "los que para una", "es")] * 50 + [(7000, "12 34", "xx"), (None, "le la les", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = language.trained(docs, max_train=30)
    assert trained.languages == ["de", "en", "es"]
    found = language.identified(docs.where("doc_id >= 5000"), trained).distinct().collect()
    assert {(r.doc_id, r.lang_pred) for r in found} == {(5000, "de"), (6000, "es"), (7000, "und")}


# --- toxicity ---


def test_toxic_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.trained(docs.where(document_fold() != 0), labels)
    found = toxicity.scored(docs, lexicon).where(document_fold() == 0).join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in found}
    assert share[1] > 0.85 and share[0] < 0.02


def test_folding_and_matching():
    assert letters.look_folded("Ѕtupіd  S7UP1D, stup!d 1234 $tu $$$").split() == ["stupid", "stupid", "stup", "d", "stu"]
    assert letters.look_folded("ＳＴＵＰＩＤ c1own") == " stupid ciown "
    lexicon = toxicity.Lexicon({" stupid ": 5.0, " ido": 3.0}, ["stupid question"], np.array([-3, 2.0, 0, 0, 0]))
    matcher = lexicon.matcher()
    found = lambda text: lexicon.features(matcher, text)[2] * (len(letters.look_folded(text or "").split()) + 20)
    assert found("so STUP1D and idots idolatry") == pytest.approx(11.0)
    assert found("a stupid question, stupid!") == pytest.approx(5.0)
    assert found("stupidity") == found("") == found(None) == 0
    dense, thin = (lexicon.features(matcher, t) for t in ("stupid", "stupid " + "word " * 500))
    assert dense[2] > 10 * thin[2]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "trash"), (3, "trash " * 100_000)], "doc_id long, text string")
    none = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.scored(docs, none).collect()} == {0}
    rows = [(i, f"word{i} text trash scum more words" if i % 2 else f"word{i} good text of words") for i in range(60)]
    labelled = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(7, None, 1)], "doc_id long, toxic int, quality int")
    lexicon = toxicity.trained(spark.createDataFrame(rows, "doc_id long, text string"), labelled)
    out = {r.doc_id: r for r in toxicity.scored(docs, lexicon).collect()}
    assert out[None].predicted == out[3].predicted == 1 and out[1].predicted == out[2].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


# --- archives ---


def test_archives_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    more = [(-1, "http://a/b c\r\n%41é", "x"), (-2, None, "x"), (7000, "u", None), (7001, "u", ""), (None, "n", "x"), (7002, "z", "yy€"), (7002, "z", "yy€"), (None, "n", "q")]
    pages = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 5000)).unionByName(spark.createDataFrame(more, "page_id long, url string, html string"))
    for limit in (200_000, -1):
        index = warc.write_archives(warc.with_responses(pages, broadcast_groups=limit), file_bytes=20_000)
        found = warc.read_records(index).collect()
        assert index.select("file").distinct().count() > 1
        rows = pages.collect()
        first = {}
        for r in rows:
            if r.page_id is not None:
                first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
        expected = []
        for r in rows:
            payload = (r.html or "").encode()
            revisit = r.html in first and r.page_id != first[r.html or ""]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            expected.append((r.page_id, r.url, len(payload), digest, "revisit" if revisit else "response", first[r.html or ""] if revisit else None, None if revisit else payload))
        key = lambda t: tuple(map(str, t))
        assert sorted(((*r[:6], None if r[6] is None else bytes(r[6])) for r in map(tuple, found)), key=key) == sorted(expected, key=key)
    assert {r.record_id for r in warc.read_records(index.where("record_id = 7002")).collect()} == {7002}
    assert warc.read_records(warc.write_archives(warc.with_responses(pages.limit(0)))).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {r.record_id for r in warc.with_responses(pages, min_bytes=3).where("revisit").collect()} == {4}


def test_ranges_are_joined():
    joined = list(warc.coalesced([(0, 10), (10, 5), (100, 5), (400, 5)], gap=90, block=1000))
    assert [(s, e, len(m)) for s, e, m in joined] == [(0, 105, 3), (400, 405, 1)]
    assert [m for _, _, m in warc.coalesced([(0, 60), (60, 60), (120, 60)], gap=9, block=100)] == [[(0, 60)], [(60, 60)], [(120, 60)]]
    record = warc.record_bytes(1, "u", b"payload", None, False)
    damaged = zlib.compress(zlib.decompress(record, 31).replace(b"payload", b"pAyload"), 6, 31)
    with pytest.raises(ValueError):
        warc.parse_record(damaged)


# --- pages ---


def article(page):
    """The blocks of the article element of the test pages."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"</?(?:b|br)\b[^>]*>", "", body))
    return "\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", html.unescape(b)).strip()))


def test_articles_of_pages(spark):
    pages = spark.read.parquet(f"{BIGGER}/pages.parquet")
    for r, e in zip(extraction.extracted(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        assert r.text == article(e.html) and r.n_chars == len(r.text)


WITHOUT_ARTICLE = """<html><body><header><div class="logo">Site name</div><nav><a href=x>Home</a> <a>About us</a></nav></header><div id="cookie-notice">We use cookies, and more. Accept?</div>
<div class="wrap"><div class="content"><h2>Title &lt;here&gt;</h2><p>First paragraph, with some text. It goes on, and on. <a href="a>b">link</a> more.<p>Second one; also long
 enough to count&nbsp;as text. Yes.</p><ul><li>item one is here, too.<li>item two</ul><p>Short.</p></div>
<div class="sidebar"><p>Related things, which are many. Read them.</p></div></div><div class="comments"><p>I disagree, sir. Very much so, and long.</p></div><form><input>Subscribe, please.</form>
<script>if (a < b) { document.write("<p>no, no, no.</p>"); }</script><footer>&copy; 2020, all rights.</footer></body></html>"""


def test_page_without_article_element():
    assert extraction.main_text(WITHOUT_ARTICLE).split("\n") == [
        "Title <here>", "First paragraph, with some text. It goes on, and on. link more.", "Second one; also long enough to count as text. Yes.", "item one is here, too.", "item two", "Short.",
    ]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "<a href='", "</p></div>", "<p>" * 3000 + "x", "<" * 20_000, "<!--" * 20_000, "<a b='" * 20_000, "text only, no tags."])
def test_odd_pages(spark, page):
    text = extraction.main_text(page)
    assert isinstance(text, str)
    if page == "text only, no tags.":
        assert text == page


def test_extraction_edges(spark):
    rows = [(1, "u", None, "k"), (None, None, "<p>Hello, there.</p>", "k"), (2, "u", "<article><p>a&ampb &euro; x</article>", "k")]
    out = {r.page_id: r for r in extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert (out[1].text, out[1].n_chars, out[None].text, out[2].text) == ("", 0, "Hello, there.", "a&b € x")


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name]) is None


COLUMNS = {
    "op1_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_substring": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_return_all_rows_in_the_columns_agreed(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    base = spark.read.parquet(f"{sf_dir}/{'pages' if name in ('op6_warc', 'op10_extraction') else 'documents'}.parquet")
    key = out.columns[0]
    assert out.select(key).distinct().count() == base.count() and (name == "op4_packing" or out.count() == base.count())


def test_pii_and_simhash_digests(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_pii(spark, sf_dir).collect():
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute.pii(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
    for r in queries.op7_simhash(spark, sf_dir).collect():
        assert r.fingerprint == f"{brute.simhash(docs[r.doc_id]):016x}"


def test_pipeline_stages(spark, sf_dir, tmp_path):
    """Each stage against a plain version of its decision, on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "pii_removal", "token_packing"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, sf_dir)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert now.columns == docs.columns
        got = {r.doc_id: r for r in now.collect()}
        if name == "quality_rules":
            measures = {i: brute.quality(r.text) for i, r in before.items()}
            assert set(got) == {i for i, m in measures.items() if m[0] >= 20 and 100 * m[4] <= 30 * m[0]}
        elif name == "simhash_dedup":
            ids = sorted(before)  # near duplicates are those of five-word shingles at a similarity of 0.8
            assert set(got) == {ids[i] for i in least_of_groups([before[i].text for i in ids])} and len(got) == now.count()
        elif name == "decontamination":
            hits = brute.contamination([r.text for r in before.values()], bench)
            assert set(got) == {i for i, h in zip(before, hits, strict=True) if not h[1]}
        elif name == "pii_removal":
            assert set(got) == set(before) and not any(brute.pii(r.text) for r in got.values())
            assert all(got[i].text == before[i].text for i in got if not brute.pii(before[i].text))
        else:
            assert {r.doc_id for r in now.collect()} == set(before)


def test_a_wrapper_named_like_boilerplate_is_no_boilerplate():
    page = '<body><form id="main-form"><div class="with-sidebar"><div><p>The text of the page, as it is. And more of it.</p><p>End.</p></div><div class="sidebar">Other things, here and there.</div></div></form><div class="comments"><p>Nice, I say.</p></div></body>'
    assert extraction.main_text(page) == "The text of the page, as it is. And more of it.\nEnd."


def test_elements_that_are_never_closed():
    text = "The text of the page, as it is. And more of it."
    assert extraction.main_text(f"<body><nav><ul><li><a href=x>Home</a><li><a>About us, and more of that.</a><article><p>{text}<p>End.</article>") == text + "\nEnd."
    assert extraction.main_text(f'<body><div class="ad">Buy this, and that, and more.<article><p>{text}</article><footer>All rights, as ever, reserved.') == text
    assert extraction.main_text("<body><nav><a>Home</a></nav><footer>All rights reserved, as ever, by all of us.</footer></body>") == ""
