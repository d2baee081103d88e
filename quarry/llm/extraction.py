"""Main text of web pages by tag-path ratios.

A page is read into blocks of text with their root-to-leaf tag paths (inline
markup and void elements are no part of a path; paths are interned as a parent
path and a tag). For each path the text length and the punctuation of its blocks
are added up and divided by the number of blocks. Both ratios are smoothed over
the page order, set against their median over the page's text, and fused by
their product; a block's score is its path's fused ratio times the block's
weight, and blocks with a score of at least `strictness` are content.

The weight, between 0 and 1, is what the elements around a block say about it.
Tags, roles, classes and ids that stand for menus, page headers, footers,
sidebars, notices, adverts, forms or comments lower it; text beside an article
or main element loses weight with the share of the page's prose inside that
element. An element gets its weight back with the share of the page's prose in
it, as one that holds the page's paragraphs is a wrapper, whatever its name.

Short blocks have small ratios of their own, so blocks that stand in the
container of content are content too if only text-level elements (headings,
paragraphs, lists, tables, quotations, figures) are in between, and so is the
heading above the first content.

Defined cases: null and empty pages have an empty text; text outside any block
is a block; unclosed and crossed elements are closed as browsers do for
paragraphs and list items; a page cut off inside a tag ends before that tag;
time and memory grow with the page, however deep it is nested; repeated rows and
null ids keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
SKIPPED = frozenset("head script style noscript template textarea title iframe xmp noembed noframes svg math canvas object audio video select option button".split())
#: Elements that say that they are something beside the text.
BESIDE = frozenset("nav aside footer dialog menu form".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ITEM_LISTS = frozenset("ul ol menu dl table tbody thead tfoot select body html div article section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text, and those whose text is one paragraph of what is around them.
TEXT_LEVEL = HEADINGS | frozenset("p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hgroup header details summary address center".split())
PARAGRAPHS = HEADINGS | frozenset("p li dt dd td th caption blockquote pre figcaption summary address".split())
#: Words of class and id names, and roles, of what is no article text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar sidebars side aside widget widgets footer foot masthead header topbar toolbar skip "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search copyright legal disclaimer".split()
)
#: Those of them that name subjects as well, and words that say no subject; with another word beside it a subject is meant.
SUBJECTS = frozenset("social legal related share sharing side notice notices discussion search copyright sponsored banner respond promotion subscription alert".split())
PLACES = frozenset(
    "bar box block blocks link links list lists icon icons button buttons wrap wrapper container section area post posts item items row col column inner outer content module region zone media network networks tool tools panel card cards "
    "site page global main top bottom left right primary secondary mobile desktop article articles story stories entry entries news text title form input field group holder slot unit strip rail js c l u is sticky fixed hidden open this us on more also read cta feed count counts".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
CONTENT = frozenset("article main".split())
#: What a name's first word means that speaks of something else, and names of an article's own header.
ABOUT_OTHERS = frozenset("with has no without not".split())
OWN_HEADER = frozenset("entry post article title content story page".split())
#: Weights of an element whose tag or role, and whose names, say that it is beside the text.
BESIDE_WEIGHT, NAMED_WEIGHT = 0.05, 0.05
#: What text beside an article element loses if the article has all of the page's prose.
OUTSIDE_LOSS = 0.6

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、·]")


@dataclass
class Block:
    """A block of text as it stands in the page."""

    element: int
    parts: list[str] = field(default_factory=list)
    text: str = ""
    linked: int = 0
    marks: int = 0


@dataclass
class Page:
    """The blocks in order, and of each element its parent (less than itself), tag, path and weight; element 0 is the page."""

    blocks: list[Block]
    parent: list[int]
    tag: list[str]
    path: list[int]
    weight: list[float]
    paths: list[tuple[int, str]]  # parent path and tag


def _raw_tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", t, ""), ("start", name, attributes), ("end", name, ""), reading each character a bounded number of times."""
    at, size = 0, len(page)
    missing: set[str] = set()  # quotes and ends that are not found any more

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while at < size:
        less = page.find("<", at)
        if less < 0:
            yield "text", page[at:], ""
            return
        if less > at:
            yield "text", page[at:less], ""
        if page.startswith("<!--", less):
            end = find("-->", less + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), less):
            end = find(">", less)
            at = size if end < 0 else end + 1
            continue
        closing = page.startswith("</", less)
        name = _TAG_NAME.match(page, less + 1 + closing)
        if not name:
            if less + 1 < size:  # a last lone sign is a tag that was cut off
                yield "text", "<", ""
            at = less + 1
            continue
        end = name.end()
        while True:
            stop = _STOP.search(page, end)
            if not stop:
                return  # cut off inside a tag
            if stop[0] == ">":
                break
            before, end = page[end : stop.start()], stop.end()
            if before.rstrip()[-1:] == "=":
                close = find(stop[0], end)
                if close >= 0:
                    end = close + 1
        word = name[0].lower()
        yield ("end" if closing else "start"), word, "" if closing else page[name.end() : stop.start()]
        at = stop.end()
        if not closing and word in RAW:
            close = re.compile(rf"</{word}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else size


def _beside(words: list[str]) -> bool:
    """Whether a name's words say that an element is beside the text: `social-links` does, `social-science` doesn't."""
    said = BOILERPLATE.intersection(words)
    return bool(said - SUBJECTS) or bool(said) and all(w in BOILERPLATE or w in PLACES for w in words)


def _element_weight(tag: str, attributes: str, in_content: bool) -> float:
    """What an element's own tag, role, classes and id say, without regard to what it holds."""
    out, own_header = 1.0, in_content
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if kind.lower() == "role":
            if value.strip().lower() in ROLES:
                out = min(out, BESIDE_WEIGHT)
            continue
        for name in value.split():
            words = [w.lower() for w in _NAME_PARTS.findall(name)]
            if not words or words[0] in ABOUT_OTHERS:
                continue
            if tag == "header" and OWN_HEADER.intersection(words):
                own_header = True
            elif _beside(words) and tag not in ("html", "body", *CONTENT):
                out = min(out, NAMED_WEIGHT)
    if tag in BESIDE or (tag == "header" and not own_header):
        out = min(out, BESIDE_WEIGHT)
    return out


def read_page(page: str) -> Page:
    """The page's blocks of text and its elements."""
    out = Page([], [0], [""], [0], [1.0], [(0, "")])
    interned: dict[tuple[int, str], int] = {}
    stack = [0]  # open elements
    skipping = within = 0  # open elements without text, open article and main elements
    depths: dict[str, list[int]] = {}  # where in the stack elements of a tag are
    now: Block | None = None
    links = 0

    def close(upto: int) -> None:
        nonlocal skipping, within, now
        while len(stack) > upto:
            tag = out.tag[stack.pop()]
            depths[tag].pop()
            skipping -= tag in SKIPPED
            within -= tag in CONTENT
            now = None

    def nearest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    for kind, value, attributes in _raw_tokens(page):
        if kind == "text":
            if skipping:
                continue
            if now is None:
                now = Block(stack[-1])
                out.blocks.append(now)
            now.parts.append(entities.unescape(value))
            if links:
                now.linked += len(value)
            continue
        if value == "a":
            links = max(0, links + (1 if kind == "start" else -1))
        if value == "br" and now is not None:
            now.parts.append(" ")
        if value in INLINE:
            continue
        now = None
        if kind == "end":
            if depths.get(value):
                close(depths[value][-1])
            continue
        if value in CLOSES_P and (open_p := nearest(("p",))) > nearest(("td", "th", "table")):
            close(open_p)
            links = 0
        if value in ITEMS:
            lists = nearest(ITEM_LISTS)
            inner = [d for t in ITEMS[value] for d in depths.get(t, ())[bisect_right(depths.get(t, ()), lists) :]]
            if inner:
                close(min(inner) if value in ("tr", "td", "th") else max(inner))
        if value in VOID or (value in ("html", "body") and depths.get(value)):
            continue
        above = stack[-1]
        key = (out.path[above], value)
        if key not in interned:
            interned[key] = len(out.paths)
            out.paths.append(key)
        depths.setdefault(value, []).append(len(stack))
        stack.append(len(out.parent))
        out.parent.append(above)
        out.tag.append(value)
        out.path.append(interned[key])
        out.weight.append(_element_weight(value, attributes, bool(within)))
        skipping += value in SKIPPED
        within += value in CONTENT
    for block in out.blocks:
        block.text = _SPACE.sub(" ", "".join(block.parts)).strip()
        block.marks = len(_PUNCTUATION.findall(block.text)) if len(block.text) > block.linked else 0
    out.blocks = [b for b in out.blocks if b.text]
    return out


def prose(block: Block) -> int:
    """Characters outside links."""
    return max(len(block.text) - block.linked, 0)


def block_weights(page: Page) -> np.ndarray:
    """The weight of each block: the product over its elements, each lifted by the share of the page's prose that it holds."""
    n = len(page.parent)
    own, paragraphs, dots, marked = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for b in page.blocks:
        own[b.element] += prose(b)
        dots[b.element] += b.marks
        paragraphs[b.element] += page.tag[b.element] in ("p", *HEADINGS)
    direct = own.copy()
    for e in range(n - 1, 0, -1):  # sums over all that an element holds
        own[page.parent[e]] += own[e]
        paragraphs[page.parent[e]] += paragraphs[e]
        if marked[e] or page.tag[e] in CONTENT or page.tag[e] == "h1":
            marked[page.parent[e]] = True
    whole = max(own[0], 1.0)
    product, inside, in_articles = np.ones(n), np.zeros(n, bool), 0.0
    of_text = np.ones(n)  # text that stands in an element itself is lifted by its own share and punctuation only
    for e in range(1, n):
        above = page.parent[e]
        lift = (own[e] / whole) ** 4 * (1.0 if marked[e] else min(1.0, paragraphs[e] / 3))
        product[e] = product[above] * (page.weight[e] + (1 - page.weight[e]) * lift)
        of_text[e] = product[above] * (page.weight[e] + (1 - page.weight[e]) * (direct[e] / whole) ** 4 * min(1.0, dots[e] / 10))
        inside[e] = inside[above] or page.tag[e] in CONTENT
        if inside[e] and not inside[above]:
            in_articles += own[e]
    outside = 1 - OUTSIDE_LOSS * in_articles / whole
    return np.array([of_text[b.element] * (1.0 if inside[b.element] else outside) for b in page.blocks])


def smoothed(values: np.ndarray, neighbours: float = 0.05) -> np.ndarray:
    """A mean over each value and the ones beside it, which count `neighbours` each."""
    if len(values) < 2:
        return values
    return np.convolve(np.pad(values, 1, mode="edge"), [neighbours, 1 - 2 * neighbours, neighbours], "valid")


def middle(values: np.ndarray, weights: np.ndarray) -> float:
    """The weighted median."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])


def path_ratios(page: Page, weights: np.ndarray) -> np.ndarray:
    """For each block the fused ratio of its path, 0 to 1."""
    n = len(page.paths)
    path = np.array([page.path[b.element] for b in page.blocks])
    own = np.array([prose(b) for b in page.blocks], float)
    count = np.bincount(path, weights, n)[path]
    length = np.bincount(path, weights * own, n)[path]
    marks = np.bincount(path, weights * [b.marks for b in page.blocks], n)[path]
    # paths with much text in all count by their sum too, so that many short paragraphs are not lost
    text_ratio = smoothed(length / count + np.sqrt(length))
    mark_ratio = smoothed((weights + marks) / count)
    each = (own + 1e-9) * weights**2
    against = lambda ratio: np.minimum(1.0, ratio / max(middle(ratio, each), 1e-9))
    fused = against(text_ratio) * np.sqrt(against(mark_ratio))
    fused[length <= 0] = 0
    return (np.bincount(path, fused, n) / np.maximum(np.bincount(path, minlength=n), 1))[path]


def content_blocks(page: Page, strictness: float = 0.4, ratios=path_ratios) -> list[Block]:
    """The blocks that are content."""
    if not page.blocks:
        return []
    weights = block_weights(page)
    chosen = ratios(page, weights) * weights >= strictness
    if not chosen.any():
        return []
    n = len(page.parent)
    held, all_held, direct = np.zeros(n), np.zeros(n), np.zeros(n, int)
    for b, good in zip(page.blocks, chosen, strict=True):
        all_held[b.element] += prose(b)
        if good:
            held[b.element] += prose(b)
            direct[page.parent[b.element]] += 1
    containers = direct >= 2
    for b, good in zip(page.blocks, chosen, strict=True):
        if good:
            containers[page.parent[b.element] if page.tag[b.element] in PARAGRAPHS else b.element] = True
    for e in range(n - 1, 0, -1):
        held[page.parent[e]] += held[e]
        all_held[page.parent[e]] += all_held[e]
    beside = np.zeros(n, bool)  # of text-level elements in a container
    for e in range(1, n):
        if page.tag[e] in CONTENT and held[e] * 2 >= all_held[e] > 0:
            containers[e] = True
        beside[e] = page.tag[e] in TEXT_LEVEL and page.weight[e] == 1 and (beside[page.parent[e]] or containers[page.parent[e]])
    path = np.array([page.path[b.element] for b in page.blocks])
    text = np.bincount(path, [len(b.text) for b in page.blocks])
    free = np.bincount(path, [prose(b) for b in page.blocks])
    for i, b in enumerate(page.blocks):
        chosen[i] |= (beside[b.element] or containers[b.element]) and free[path[i]] >= 0.3 * text[path[i]] and weights[i] >= strictness / 2
    first = int(np.argmax(chosen))
    if not any(page.tag[page.blocks[i].element] == "h1" for i in np.flatnonzero(chosen)):
        titles = [i for i in range(first) if page.tag[page.blocks[i].element] == "h1" and weights[i] >= strictness]
        chosen[titles[-1:]] = True
    return [b for b, good in zip(page.blocks, chosen, strict=True) if good]


def main_text(page: str | None) -> str:
    """The blocks of the main text, one a line."""
    return "\n".join(b.text for b in content_blocks(read_page(page or "")))


def extracted(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns, text and n_chars of every page."""
    slim = pages.select(*carry, F.col(html).alias("_html"))
    n = len(carry)
    schema = T.StructType([*slim.schema.fields[:n], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p) for p in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return slim.mapInArrow(run, schema)
