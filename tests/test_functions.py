from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import frontmatter as fm
from quarry.functions import paths, text, vector
from quarry.functions.chunking import chunked


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


@pytest.mark.parametrize(
    "a,b,expected",
    [((1, 2, 3), (1, 2, 3), 1), ((1, 0), (0, 1), 0), ((1, 1), (-1, -1), -1), ((), (), 0), ((), (1,), 0), ((0, 0), (1, 1), 0), ((1, 0, 9), (1, 0), 1), ((1e-10, 1e-10), (1e-10, 1e-10), 1)],
)
def test_cosine(spark, a, b, expected):
    assert one(spark, vector.cosine(vec(*a), vec(*b))) == pytest.approx(expected)


def test_cosine_of_many_dimensions(spark):
    a, b = [math.sin(i) for i in range(1536)], [math.cos(i) for i in range(1536)]
    want = sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    assert one(spark, vector.cosine(vec(*a), vec(*b))) == pytest.approx(want)


@pytest.mark.parametrize("raw,expected", [("[1, 2.5]", [1, 2.5]), ("[]", []), ("no", []), ('{"a":1}', []), (None, [])])
def test_parsed_embedding(spark, raw, expected):
    assert one(spark, vector.parsed_embedding(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize("raw,expected", [("hello world", '"hello" AND "world"'), ("FOO_bar baz-1", '"FOO_bar" AND "baz" AND "1"'), ("   ", None), ('hello "world', '"hello" AND "world"'), ("hello@world.com", '"hello" AND "world" AND "com"'), ("日本", None)])
def test_full_text_query(spark, raw, expected):
    assert one(spark, text.full_text_query(F.lit(raw))) == expected


def test_phrases():
    assert text.query_phrases("FOO_bar the the _") == [["foo", "bar"], ["the"], ["the"], []]


@pytest.mark.parametrize("first,count,content,end", [(1, None, "a\nb\nc", 3), (2, 1, "b", 2), (0, 2, "a\nb", 2), (3, 9, "c", 3), (9, 2, "", 8)])
def test_read_lines(spark, first, count, content, end):
    r = one(spark, text.read_lines(F.lit("a\nb\nc"), first, count))
    assert (r.content, r.start_line, r.end_line) == (content, max(first, 1), end)


@pytest.mark.parametrize("old,expected", [(None, "x"), ("", "x"), ("a", "a\nx"), ("a\n", "a\nx")])
def test_appended(spark, old, expected):
    assert one(spark, text.appended(F.lit(old).cast("string"), F.lit("x"))) == expected


def plain_chunks(content, tokens, overlap):
    most, over = max(32, tokens * 4), max(0, overlap * 4)
    out, held = [], []

    def flush():
        out.append((held[0][1], held[-1][1], "\n".join(t for t, _ in held)))

    for n, line in enumerate(content.split("\n"), 1):
        for piece in [line[i : i + most] for i in range(0, len(line), most)] or [""]:
            if held and sum(len(t) + 1 for t, _ in held) + len(piece) + 1 > most:
                flush()
                kept, size = [], 0
                while over and held and size < over:
                    kept.insert(0, held.pop())
                    size += len(kept[0][0]) + 1
                held = kept
            held.append((piece, n))
    flush()
    return out


@pytest.mark.parametrize("tokens,overlap", [(256, 32), (256, 0), (8, 0), (20, 5), (64, 64), (1, 9)])
def test_chunks(spark, tokens, overlap):
    texts = ["", "\n", "x" * 10_000, "a\r\nb", "   ", "\n".join(f"line {i}" for i in range(400)), "日本語🚀\n" * 60, "end\n"]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    found: dict[int, list] = {}
    for r in chunked(docs, tokens=tokens, overlap=overlap).orderBy("doc_id", "ordinal").collect():
        found.setdefault(r.doc_id, []).append((r.start_line, r.end_line, r.text))
    assert found == {i: plain_chunks(t, tokens, overlap) for i, t in enumerate(texts)}


NOTE = '---\nsession:\n  id: abc\n  source: "vs code"\n other: no\ncreated: 2024-01-01\ntags: [a, \'b\', 3]\nbad line\ncount: 0x1F\nflag: true\n---\nBody\n---\n'


def test_frontmatter(spark):
    r = one(spark, fm.parsed(F.lit(NOTE)))
    assert (r.session.id, r.session.source, r.session.project, r.created, r.tags, r.has_session) == ("abc", "vs code", None, "2024-01-01", ["a", "b", "3"], True)
    assert one(spark, fm.body(F.lit(NOTE))) == "Body\n---\n"
    assert one(spark, fm.fields(F.lit(NOTE))) == {"session": None, "session.id": "abc", "session.source": '"vs code"', "created": "2024-01-01", "tags": "[a, 'b', 3]", "count": "0x1F", "flag": "true"}
    for plain in ("no head", "---\nid: 1\n---", "---\r\nid: 1\r\n---\r\nx", ""):
        assert one(spark, fm.parsed(F.lit(plain))) is None and one(spark, fm.body(F.lit(plain))) == plain


@pytest.mark.parametrize("value,kind", [('"1"', "string"), ("true", "boolean"), ("1e3", "number"), (".5", "number"), ("-Infinity", "number"), ("1.2.3", "string"), ("[a]", "array"), ("0b12", "string")])
def test_value_kinds(spark, value, kind):
    assert one(spark, fm.value_kind(F.lit(value))) == kind


def test_frontmatter_is_merged(spark):
    null = F.lit(None).cast("string")
    session = F.struct(null.alias("id"), F.lit("cli").alias("source"), F.lit("/root/p").alias("project"), null.alias("transcript"))
    out = one(spark, fm.merged(F.lit(NOTE), session, F.array(F.lit("z")), F.lit("NOW")))
    assert out == "---\nsession:\n  id: abc\n  source: cli\n  project: ~/p\ncreated: 2024-01-01\nupdated: NOW\ntags: [z]\n---\nBody\n---\n"
    fresh = one(spark, fm.merged(F.lit("text"), F.struct(*[null.alias(k) for k in fm.SESSION_KEYS]), F.lit(None).cast("array<string>"), F.lit("NOW")))
    assert fresh == "---\nsession:\ncreated: NOW\nupdated: NOW\n---\ntext"


@pytest.mark.parametrize("path,memory,write", [("MEMORY.md", True, True), ("memory.md", True, True), ("memory/a/b.md", True, True), ("./memory/x.md", True, True), ("memory/x.txt", True, False), ("memory/../../x.md", True, False), ("other.md", False, False), ("", False, False), ("memory\\a.md", True, True)])
def test_paths(spark, path, memory, write):
    assert one(spark, paths.is_memory_path(F.lit(path))) is memory
    assert one(spark, paths.may_be_written(F.lit(path))) is write


@pytest.mark.parametrize("glob,path,hit", [("memory/**/*.md", "memory/x.md", True), ("memory/**/*.md", "memory/a/b/x.md", True), ("memory/**/*.md", "memory/x.txt", False), ("*.md", "a/b.md", False), ("**", "a/b", True), ("a?.md", "ab.md", True), ("a+b.md", "a+b.md", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, paths.matches_globs(F.lit(path), [glob])) is hit


def test_other_paths(spark):
    for raw, want in (("a/b", "a/b/"), ("a//", "a/"), ("", "/"), ("/", "/")):
        assert one(spark, paths.repository_path(F.lit(raw))) == want
    assert one(spark, paths.expanded(F.lit("~/x"), "/home/u")) == "/home/u/x"
    assert one(spark, paths.shortened(F.lit("/home/u/x"), "/home/u")) == "~/x"
    names = {"/home/u/.quarry": "global", "/p/proj/.mem": "proj/.mem", "/p/notes/": "notes"}
    assert {p: one(spark, paths.directory_name(F.lit(p), "/home/u")) for p in names} == names
    folder = one(spark, paths.quarantine_folder(F.lit("2024-05-06T07:08:09.123Z")))
    assert folder == "2024-05-06T07-08-09-123Z" and one(spark, paths.quarantine_time(F.lit(folder))) == "2024-05-06T07:08:09.123Z"
    assert one(spark, paths.quarantined_file(paths.quarantine_name(F.lit("memory/a.md"), F.lit("local")))) == "memory/a.md"
    assert one(spark, paths.machine_id(F.lit("My Host.local"), F.lit("ab12"))) == "my-host-local-ab12"


def test_config():
    layers = config.merged(config.DEFAULTS, {"hybrid": {"textWeight": 0.5}, "sync": {"include": ["x"]}}, {"embedding": {"openai": {"model": "m"}}}, {"embedding": {"openai": {"baseUrl": "u"}}})
    assert layers["hybrid"]["vectorWeight"] == 0.7 and layers["hybrid"]["textWeight"] == 0.5 and layers["sync"]["include"] == ["x"]
    assert layers["embedding"] == {"provider": "auto", "openai": {"model": "m", "baseUrl": "u"}}
    assert config.with_value({"a": 1}, "a.b", 2) == {"a": {"b": 2}} and config.without_value({"a": {"b": 1, "c": 2}}, "a.b") == {"a": {"c": 2}}
    assert config.from_assignment("a.b=x=y") == ("a.b", "x=y") and config.from_assignment("a=true") == ("a", True)
    assert config.resolved_directories(["x", "x"], True, "/h") == ["x", "/h/.quarry"] and config.resolved_directories([], False, "/h", None, "/cwd") == ["/cwd"]


GLOBS = [
    ("**/*.{md,txt}", "a/b.txt", True), ("**/*.{md,txt}", "b.html", False), ("{a,b{c,d}}/x", "bd/x", True), ("{a,b{c,d}}/x", "b/x", False), ("n{1..3}.md", "n2.md", True), ("n{1..3}.md", "n4.md", False),
    ("[ab]c", "bc", True), ("[!ab]c", "bc", False), ("[^ab]c", "dc", True), ("[a-c]x", "bx", True), ("[]x", "[]x", True), ("a[", "a[", True), ("[a]]", "a]", True), ("!*.md", "a.txt", True), ("!*.md", "a.md", False), ("!!*.md", "a.md", True),
    ("*", ".hidden", False), (".*", ".hidden", True), ("**/*.md", ".h/a.md", False), ("**", "a/.b/c", False), ("a/**", "a", False), ("a/**", "a/b/c", True), ("a**b", "axxb", True), ("a**b", "ax/xb", False),
    ("+(ab|c).md", "abcab.md", True), ("+(ab|c).md", ".md", False), ("?(a)b", "b", True), ("@(a|b)", "ab", False), ("*(a|b)", "abba", True), ("!(a|b).md", "c.md", True), ("!(a|b).md", "a.md", False), ("!(a).md", "ab.md", True),
    (r"\*.md", "*.md", True), (r"\*.md", "a.md", False), ("{x}", "{x}", True), ("a{,b}c", "ac", True), ("*.md", "", False), ("?", "é", True), ("a.b", "axb", False),
]


def test_globs_with_choices(spark):
    table = spark.createDataFrame([(p,) for p in sorted({p for _, p, _ in GLOBS})], "p string")
    found = {}
    for glob in dict.fromkeys(g for g, _, _ in GLOBS):
        found |= {(glob, r.p): r.hit for r in table.select("p", paths.matches_glob(F.col("p"), glob).alias("hit")).collect()}
    assert [(g, p, found[g, p]) for g, p, _ in GLOBS] == GLOBS


def plain_match(glob, path):
    """Backtracking over folders and characters: `*`, `?`, `**`, classes and choices of one level."""
    if brace := re.search(r"\{([^{}]*)\}", glob):
        return any(plain_match(glob[: brace.start()] + c + glob[brace.end() :], path) for c in brace[1].split(","))

    def name(g, s):
        if not g:
            return not s
        if g[0] == "*":
            return name(g[1:], s) or bool(s) and name(g, s[1:])
        if g[0] == "[":
            end = g.index("]")
            return bool(s) and ((s[0] in g[1:end]) if g[1] != "!" else (s[0] not in g[2:end])) and name(g[end + 1 :], s[1:])
        return bool(s) and g[0] in ("?", s[0]) and name(g[1:], s[1:])

    def parts(gs, ps):
        if not gs:
            return not ps
        if gs[0] == "**":
            if len(gs) == 1:
                return bool(ps) and not any(p.startswith(".") for p in ps)
            return parts(gs[1:], ps) or bool(ps) and not ps[0].startswith(".") and parts(gs, ps[1:])
        return bool(ps) and not (ps[0].startswith(".") and gs[0][:1] in "*?[") and (gs[0] != "*" or ps[0] != "") and name(gs[0], ps[0]) and parts(gs[1:], ps[1:])

    return parts(glob.split("/"), path.split("/"))


def test_random_globs(spark):
    rng = random.Random(8)
    globs = ["/".join("".join(rng.choice(["a", "b", "*", "?", "[ab]", "[!a]", "{a,bb}", "."]) for _ in range(rng.randint(1, 3))) if rng.random() < 0.8 else "**" for _ in range(rng.randint(1, 3))) for _ in range(60)]
    names = ["/".join("".join(rng.choice("ab.") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    row = spark.createDataFrame([(n,) for n in names], "p string").select("p", *[paths.matches_glob(F.col("p"), g).alias(f"g{i}") for i, g in enumerate(globs)])
    for r in row.collect():
        assert [(g, r.p, r[f"g{i}"]) for i, g in enumerate(globs)] == [(g, r.p, plain_match(g, r.p)) for g in globs]
