"""The trees of repeated passages: deep nodes against brute force, equality by words, large groups in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import substring

texts = st.lists(st.lists(st.sampled_from("a b c".split()), max_size=14).map(" ".join), max_size=5)


def plain_maximal_repeats(rows, least):
    rows = [r.split() for r in rows]
    out = set()
    for size in range(least, max(map(len, rows), default=0) + 1):
        places = {}
        for r, words in enumerate(rows):
            for i in range(len(words) - size + 1):
                places.setdefault(tuple(words[i : i + size]), []).append((r, i))
        for words, at in places.items():
            before = {rows[r][i - 1] if i else (r, i) for r, i in at}
            after = {rows[r][i + size] if i + size < len(rows[r]) else (r, i) for r, i in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                out.add((" ".join(words), len(at)))
    return out


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 4))
def test_deep_nodes_are_the_maximal_repeats(rows, least):
    assert substring.maximal_repeats(rows, least) == plain_maximal_repeats(rows, least)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 5))
def test_nodes_tell_windows_apart_by_their_words(rows, depth):
    raw = [r.encode() for r in rows]
    numbers, index = substring.word_numbers(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    row = np.repeat(np.arange(len(raw)), np.diff(index))
    starts = np.array([i for i in range(len(numbers)) if i + depth <= index[row[i] + 1]], np.int64)
    if len(starts):
        node = substring.nodes_at(numbers, index[row + 1], starts, row[starts] % 2, depth)
        words = [w for r in rows for w in r.split()]
        names = [(row[i] % 2, *words[i : i + depth]) for i in starts]
        assert all((node[i] == node[j]) == (names[i] == names[j]) for i in range(len(starts)) for j in range(i))
        assert np.argsort(node, kind="stable").tolist() == sorted(range(len(starts)), key=lambda i: (names[i][0], [numbers[starts[i] + k] for k in range(depth)], i))


def rows_of(table):
    return pa.RecordBatch.from_pylist(table, schema=pa.schema(substring._GROUP_FIELDS))


@pytest.mark.parametrize("kind", [substring._ASK, substring._COUNT])
def test_a_large_group_is_merged_on_the_way(kind):
    """One window from 30,000 batches: every row is answered, and few are held."""
    words = b"a b c d e"
    row = lambda i, k: {"route": 7, "kind": k, "key": i, "check": 0, "start": 3, "n": 1 + (k == substring._COUNT), "mask": 0, "words": words}
    batches = [rows_of([row(i, kind if i == at else substring._ASK) for i in range(at, at + 3000)]) for at in range(0, 30_000, 3000)]
    batches.append(rows_of([row(-1, substring._ASK) | {"route": 8, "words": b"a b c d f"}]))
    found = [r for b in substring._trees(iter(batches), 5) if b is not None for r in b.to_pylist()]
    asked = [i for i in range(30_000) if kind == substring._ASK or i % 3000]
    assert sorted(r["key"] for r in found) == asked and all(r["mask"] == 1 and r["start"] == 3 for r in found)


def test_windows_whose_fingerprints_collide_are_no_repeats(monkeypatch):
    """Groups by a fingerprint that is the same for all windows still compare words."""
    batch = rows_of([{"route": 1, "kind": 0, "key": i, "check": 0, "start": 0, "n": 1, "mask": 0, "words": w.encode()} for i, w in enumerate(["a b c", "a b d", "a  b\tc", "b c d"])])
    found = [r for b in substring._trees(iter([batch]), 3) if b is not None for r in b.to_pylist()]
    assert sorted(r["key"] for r in found) == [0, 2]
    label, second = np.array([5, 5, 5], np.uint64), np.array([1, 2, 1], np.uint64)
    text = {(i, 0): (i, w, np.array([0, 2]), np.array([1, 3]), None) for i, w in enumerate([b"a b", b"c d", b"a b"])}
    out = list(substring._deep_rows(label, second, np.zeros(3, int), np.arange(3), list(text), dict.fromkeys(text, 1), text, 2))
    assert sorted((r[1], r[2], r[7]) for r in out) == [(0, 1, b"c d"), (1, 0, b"a b"), (2, 0, b""), (2, 2, b"")]
