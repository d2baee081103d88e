from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import infilling


def plain_form(doc_id, text, seed=1, pattern=None):
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    ends = [m.end() for m in re.finditer(pattern or r"(?s).", text) if m.end() > m.start()]
    n = len(ends)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not n or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    at = lambda u: 0 if u == 0 else len(text) if u == n else ends[u - 1]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = at(a), at(b)
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", a, b - a, out


TEXTS = ["", None, "a", "é", "𝔘𝔫𝔦", "one two three\nfour", "has <P> in it", "<", "<S", "ends in <", "a" * 5000, "naïve 字 " * 3000, "x\0y", " ", "<M>", "́á"]


@pytest.mark.parametrize("pattern", [None, r"[^ \n]+", r"[^\n]*\n?"])
def test_against_a_plain_version(spark, pattern):
    rows = [(i, t, "psm", 7) for i, t in enumerate(TEXTS * 6)] + [(None, "no id", None, None), (3, "same id", "x", 1), (3, "same id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(3)
    found = infilling.infilled(docs, pattern=pattern, every=7).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    got = sorted(tuple(map(str, r)) for r in found.collect())
    want = sorted(tuple(map(str, (i, *plain_form(i, t, pattern=pattern), t or ""))) for i, t, *_ in rows)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infilling.infilled(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    assert infilling.checkpoint_table(spark.createDataFrame([], "doc_id string, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.integers(1, 9), st.sampled_from([None, r"\S+", r"[a-z0]"]))
def test_every_cut_is_found(text, every, pattern):
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    text = data.tobytes().decode()
    unit = re.compile(pattern) if pattern else None
    index = infilling.indexed(data, unit, every)
    ends = [0] + [m.end() for m in re.finditer(pattern or r"(?s).", text)]
    assert index.n == len(ends) - 1 and len(index.byte_at) == max(1, -(-index.n // every))
    if index.n:
        ends[-1] = len(text)
        assert [infilling.located(data, index, u, unit) for u in range(len(ends))] == [(len(text[:e].encode()), e) for e in ends]


def test_counting_goes_block_by_block(spark):
    text = "aé字𝔘" * 40_000
    index = infilling.indexed(np.frombuffer(text.encode(), np.uint8))
    assert index.n == len(text) and len(index.byte_at) == -(-len(text) // infilling.EVERY)
    row = infilling.checkpoint_table(spark.createDataFrame([("d", text), ("n", None)], "doc_id string, text string"), every=50_000).where("doc_id = 'd'").first()
    assert row.point_at == [0, 50_000, 100_000, 150_000] and row.byte_at == [len(text[:p].encode()) for p in row.point_at]
