"""Tag-path ratios: against a plain version, on pages of many shapes, and on very deep ones."""

from __future__ import annotations

import statistics
import time
import tracemalloc

import numpy as np
import pytest

from quarry.llm import extraction

LONG = "This is a long paragraph of prose, with clauses, and it goes on for quite some while; it really does. " * 3
LONG = LONG.strip()

#: name: page, blocks expected
PAGES = {
    "wrapper named with-sidebar": (f'<nav><a href=x>Home</a></nav><div class="page with-sidebar"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><p>Sold by the shop, delivered by post.</p>', ["Title", LONG, LONG, "Short."]),
    "wrapper named sidebar": (f'<div class="sidebar-layout"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><p>Sold by the shop, delivered by post.</p>', ["Title", LONG, LONG]),
    "title in a header of the article": (f'<article><header class="entry-header"><h1>The title</h1></header><div class="entry-content"><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><footer>Tags: a, b.</footer></article>', ["The title", LONG, LONG, "End."]),
    "title in an own header, no article": (f'<header class="site"><h1>Site</h1></header><div><header class="entry-header"><h1>The title</h1></header><div><p>{LONG}</p><p>{LONG}</p></div></div>', ["The title", LONG, LONG]),
    "teasers as articles": (f"<h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div><article><p>A teaser, short.</p></article><article><p>A second teaser, short too.</p></article>", ["T", LONG, LONG]),
    "advert of unknown class inside": (f'<article><h1>T</h1><p>{LONG}</p><div class="zzz">Buy our new shoes, now cheap.</div><p>{LONG}</p><h2>Sub</h2><ul><li>one</li><li>two</li></ul><blockquote>Quote.</blockquote></article>', ["T", LONG, LONG, "Sub", "one", "two", "Quote."]),
    "long comments": (f'<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><section id="comments"><ol><li class="comment"><article><p>{LONG} {LONG}</p></article></li><li class="comment"><p>{LONG} {LONG} {LONG}</p></li></ol></section>', ["T", LONG, LONG]),
    "all in a form": (f"<form><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div id=footer>All rights reserved, as ever.</div></form>", ["T", LONG, LONG]),
    "paragraphs as divs": (f'<div class="nav">Home, sweet.</div><div class="text"><h2>Head</h2><div>{LONG}</div><h2>Sub</h2><div>{LONG}</div></div>', ["Head", LONG, "Sub", LONG]),
    "article shorter than the advert": ('<div class="ad">Not even a sentence that is short, this one.</div><article><h1>Of.</h1><p>Of.</p></article><footer>Rights, all of them. Reserved.</footer>', ["Of.", "Of."]),
    "prose right in a form": (f'<nav>Home, sweet.</nav><form>{LONG}<br>{LONG}</form><footer>Rights, all of them. Reserved.</footer>', [f"{LONG} {LONG}"]),
    "a footer only": ("<nav><a>Home</a></nav><footer>All rights reserved, as ever, by all of us.</footer>", []),
    "article without text": ('<div class="ad">Not even a sentence that is short, this one.</div><article><h1></h1></article><footer>Rights, all of them. Reserved.</footer>', []),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_many_shapes(name):
    page, blocks = PAGES[name]
    assert extraction.main_text(f"<html><body>{page}</body></html>") == "\n".join(blocks)


def test_ratios_decide():
    """With every ratio alike, so that only names and tags count, other blocks come out."""
    changed = 0
    for page, blocks in PAGES.values():
        read = extraction.read_page(page)
        without = extraction.content_blocks(read, ratios=lambda p, w: np.ones(len(p.blocks)))
        changed += [b.text for b in without] != blocks
    assert changed >= 3


def plain_ratios(page, weights, neighbours=0.05):
    def path_of(e):
        out = []
        while e:
            out.append(page.tag[e])
            e = page.parent[e]
        return "/".join(reversed(out))

    paths = [path_of(b.element) for b in page.blocks]
    free = [max(len(b.text) - b.linked, 0) for b in page.blocks]
    n = len(paths)
    length, marks, count = ({p: 0.0 for p in paths} for _ in range(3))
    for p, w, f, b in zip(paths, weights, free, page.blocks, strict=True):
        length[p] += w * f
        marks[p] += w * (sum(c in ".,;:!?…。，；：！？、·" for c in b.text) if len(b.text) > b.linked else 0)
        count[p] += w
    text = [length[p] / count[p] + length[p] ** 0.5 for p in paths]
    dots = [(weights[i] + marks[p]) / count[p] for i, p in enumerate(paths)]
    smooth = lambda v: [neighbours * v[max(i - 1, 0)] + (1 - 2 * neighbours) * v[i] + neighbours * v[min(i + 1, n - 1)] for i in range(n)] if n > 1 else v

    def median(v):
        rows, total, upto = sorted((x, i) for i, x in enumerate(v)), sum((f + 1e-9) * w * w for f, w in zip(free, weights, strict=True)), 0.0
        for x, i in rows:
            upto += (free[i] + 1e-9) * weights[i] ** 2
            if upto >= total / 2 - 1e-9:
                return x

    text, dots = smooth(text), smooth(dots)
    a, b = median(text), median(dots)
    fused = [min(1, t / a) * min(1, d / b) ** 0.5 if length[p] > 0 else 0 for t, d, p in zip(text, dots, paths, strict=True)]
    return [statistics.fmean(f for f, q in zip(fused, paths, strict=True) if q == p) for p in paths]


def test_ratios_against_a_plain_version(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()] + [p for p, _ in PAGES.values()]
    for text in pages:
        page = extraction.read_page(text or "")
        if page.blocks:
            weights = extraction.block_weights(page)
            assert np.allclose(extraction.path_ratios(page, weights), plain_ratios(page, weights.tolist()), atol=1e-9)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "Some text, here.", "<ul><li>" * 50_000 + "Some text, here.", "<table><tr><td>" * 30_000 + "Some text, here.", "<p>" * 100_000 + "Some text, here.", "<p " + 'b="c" ' * 100_000 + ">Some text, here."])
def test_depth_and_length_cost_in_proportion(page):
    began = time.process_time()
    assert extraction.main_text(page) == "Some text, here."
    assert time.process_time() - began < 5
    tracemalloc.start()
    extraction.main_text(page)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20


@pytest.mark.parametrize("name,kept", [("social-science", True), ("legalAnalysis", True), ("search-for-meaning", True), ("shared_history", True), ("social-links", False), ("legal", False), ("related-posts", False), ("share-box", False), ("site-search", False)])
def test_names_of_subjects(name, kept):
    """A word that stands for boilerplate as well as for a subject is one of a subject if another word says so."""
    p = "<p>" + "Long words of an article, with commas, and stops. " * 6 + "</p>"
    own = "<p>MARK " + "this section has its own text, and more of it. And again. " * 5 + "</p>"
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1>{p * 2}<section class='{name}'>{own}</section>{p * 2}</article></body></html>"
    assert ("MARK" in extraction.main_text(page)) is kept


def test_repeated_rows_and_clashing_columns(spark):
    page = "<article><h1>T</h1>" + "<p>Some text, with more of it. And more.</p>" * 5 + "</article>"
    rows = spark.createDataFrame([(1, "u", page, "x", 1)] * 2 + [(None, None, None, "y", 2)], "page_id long, url string, html string, text string, n_chars long")
    found = extraction.extracted(rows).collect()
    assert [(r.page_id, r.n_chars) for r in found if r.page_id] == [(1, len(extraction.main_text(page)))] * 2 and [(r.text, r.n_chars) for r in found if r.page_id is None] == [("", 0)]
