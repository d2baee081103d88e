"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents into segments, as search engines shard theirs: a
segment holds some documents' token postings, that is the sorted terms, and for
each term all its positions. It is a written table. A query block, a bounded
part of the benchmark, goes to all segments; in each, the rarest term of a
window gives the candidate positions, and the offset-adjusted lists of the
other terms, from rare to frequent, are intersected with them. `phrases` returns
exact matches. `matches` also returns proximity matches: places of a window's
first word with all of its other words, in any order, at most `slop` words away
in the same document. Terms are 64-bit fingerprints of words.

Defined cases: null and empty texts have no words, so such documents get a row
without hits and such items match nothing; items of equal id are one item with
the windows of all its rows, a null item id counts as the empty string; repeated
rows keep their rows; a document longer than a segment is a segment of its own;
an empty benchmark or table gives rows without hits or no rows; further columns
are carried if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import per_batch, written
from quarry.llm.textvec import ALNUM, LOWER, slices, string_buffer, word_spans, word_symbols

#: Words a segment takes in before it is closed.
SEGMENT_WORDS = 1 << 20
#: Words of a query block, 8 bytes each: what is sent to every task. The index is read once for each block.
BLOCK_WORDS = 2_000_000
#: How far the words of a proximity match may be from the place of the window's first one.
SLOP = 20
#: Windows, and candidate positions, that are looked at together.
_WINDOWS, _CANDIDATES = 50_000, 1_000_000


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of some rows, and for each row the index of its first word (n + 1 values)."""
    parts, counts = [], [np.zeros(1, np.int64)]
    for first, last in slices(offsets):
        low = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, at = word_spans(low, offsets[first : last + 1] - offsets[first], ALNUM)
        parts.append(word_symbols(low, starts, ends))
        counts.append(np.diff(at))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(np.concatenate(counts))


def _planes(values: np.ndarray) -> bytes:
    """uint32 values byte by byte of the same weight, which packs well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _segment(symbols: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """terms, postings of each term, positions as steps within a term, and words of each document."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]]))
    steps = np.diff(order, prepend=0)
    steps[first] = order[first]
    return ranked[first].tobytes(), _planes(np.diff(np.append(first, len(ranked)))), _planes(steps), counts.astype("<u4").tobytes()


def build_index(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The written index: one row per segment with the carried columns of its documents as lists."""
    slim = docs.select(*carry, F.col(text).alias("_text"))
    fields = [T.StructField("segment", T.LongType())] + [T.StructField(f"c{i}", T.ArrayType(slim.schema[i].dataType)) for i in range(len(carry))]
    schema = T.StructType(fields + [T.StructField(n, T.BinaryType()) for n in ("terms", "postings", "positions", "words")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal made, n
            counts = np.concatenate([c for _, _, c in held])
            blobs = _segment(np.concatenate([s for _, s, _ in held]), counts)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.concat_arrays([x[i] for x, _, _ in held])) for i in range(len(carry))]
            out = pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), *lists, *(pa.array([b], pa.binary()) for b in blobs)], names=schema.names)
            made, n = made + 1, 0
            held.clear()
            return out

        for batch in batches:
            data, offsets = string_buffer(batch.column(len(carry)))
            for first, last in slices(offsets):
                symbols, at = symbols_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                held.append(([batch.column(i).slice(first, last - first) for i in range(len(carry))], symbols, np.diff(at)))
                n += len(symbols)
                if n >= segment_words:
                    yield close()
        if held:
            yield close()

    return written(slim.mapInArrow(run, schema), "index")


@dataclass
class Block:
    """Words of some items one after another, where each text begins (and the last ends), its item, and the items' names."""

    symbols: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    items: list[str]


def query_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of at most `block_words` words and one item."""
    ids: dict[str, int] = {}
    held: list[tuple[int, np.ndarray]] = []
    n = 0

    def block() -> Block:
        return Block(np.concatenate([s for _, s in held]), np.cumsum([0, *(len(s) for _, s in held)]), np.array([i for i, _ in held]), list(ids))

    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).toLocalIterator():
        raw = np.frombuffer((row["t"] or "").encode("utf-8", "surrogatepass"), np.uint8)
        symbols, _ = symbols_of(raw, np.array([0, len(raw)]))
        if not len(symbols):
            continue
        if held and n + len(symbols) > block_words:
            yield block()
            ids, held, n = {}, [], 0
        held.append((ids.setdefault(row["i"], len(ids)), symbols))
        n += len(symbols)
    if held:
        yield block()


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin[i], begin[i] + 1, ... of each i, `count[i]` of them, and the i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return begin[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner], owner


class Segment:
    """A row of the index, opened for search."""

    def __init__(self, terms: bytes, postings: bytes, positions: bytes, words: bytes):
        self.terms = np.frombuffer(terms, np.uint64)
        self.sizes = _values(postings).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.frombuffer(words, "<u4").astype(np.int64)
        self.doc_begin = np.concatenate([[0], np.cumsum(self.words)])
        steps = _values(positions).astype(np.int64)
        upto = np.cumsum(steps)
        first = self.begin[:-1]
        self.positions = upto - np.repeat(upto[first] - steps[first], self.sizes)
        # all postings as one sorted list: term * width + position
        self.width = int(self.doc_begin[-1]) + 1
        self.postings = np.repeat(np.arange(len(self.terms)), self.sizes) * self.width + self.positions

    def find(self, symbols: np.ndarray) -> np.ndarray:
        """The index of each term, -1 where the segment hasn't got it."""
        if not len(self.terms):
            return np.full(symbols.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, symbols), len(self.terms) - 1)
        return np.where(self.terms[at] == symbols, at, -1)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_begin, position, "right") - 1

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term stands somewhere from `low` to `high`, places of one document each."""
        at = np.searchsorted(self.postings, term * self.width + low)
        return self.postings[np.minimum(at, len(self.postings) - 1)] <= np.where(at < len(self.postings), term * self.width + high, -1)

    def around(self, position: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """The places at most `slop` away in the same document: first and last."""
        doc = self.document(position)
        return np.maximum(position - slop, self.doc_begin[doc]), np.minimum(position + slop, self.doc_begin[doc + 1] - 1)

    def candidates(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Window and position of the rarest terms of windows (rows of term indexes), and each window's places from rare to frequent terms."""
        order = np.argsort(self.sizes[windows], axis=1, kind="stable")
        rarest = np.take_along_axis(windows, order[:, :1], 1)[:, 0]
        upto = np.cumsum(self.sizes[rarest])
        first = 0
        while first < len(windows):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _CANDIDATES, "right")))
            at, window = _spread(self.begin[rarest[first:last]], self.sizes[rarest[first:last]])
            yield window + first, self.positions[at], order
            first = last

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and first position of where all terms stand one after another in one document."""
        found = [(np.zeros(0, np.int64),) * 2]
        for window, at, order in self.candidates(windows):
            start = at - order[window, 0]
            good = start >= 0
            for k in range(windows.shape[1]):
                window, start = window[good], start[good]
                if k == 0:
                    good = start + windows.shape[1] <= self.doc_begin[self.document(start) + 1]
                else:
                    place = start + order[window, k]
                    good = self.has(windows[window, order[window, k]], place, place)
            found.append((window[good], start[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def near(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Window and position of a window's first term with all others at most `slop` words away in the same document."""
        found = [(np.zeros(0, np.int64),) * 2]
        size = windows.shape[1]
        for window, at, order in self.candidates(windows):
            for k in range(1, size):  # two words of a match are at most twice the slop apart
                good = self.has(windows[window, order[window, k]], *self.around(at, 2 * slop))
                window, at = window[good], at[good]
            low, high = self.around(at, slop)
            first = windows[window, 0] * self.width
            begin = np.searchsorted(self.postings, first + low)
            place, of = _spread(begin, np.searchsorted(self.postings, first + high, "right") - begin)
            both = np.unique(window[of] * self.width + self.positions[place])
            window, at = both // self.width, both % self.width
            for k in range(size):
                good = self.has(windows[window, order[window, k]], *self.around(at, slop))
                window, at = window[good], at[good]
            found.append((window, at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _search(index: DataFrame, block: Block, window: int, carry: tuple[str, ...], slop: int | None) -> DataFrame:
    """One row per document of the index: its place, the carried columns, n_words, and for phrases (hit) and proximity (near) the count, a bit per word and the items."""
    fields = [T.StructField("segment", T.LongType()), T.StructField("ordinal", T.LongType())]
    fields += [T.StructField(name, index.schema[f"c{i}"].dataType.elementType) for i, name in enumerate(carry)]
    fields += [T.StructField("n_words", T.LongType())]
    kinds = _kinds(slop)
    for kind in kinds:
        fields += [T.StructField(f"n_{kind}", T.LongType()), T.StructField(f"{kind}_bits", T.BinaryType()), T.StructField(f"{kind}_items", T.ArrayType(T.StringType()))]
    schema = T.StructType(fields)
    n_items = max(len(block.items), 1)

    def windows_of(segment: Segment) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows as rows of term indexes that the segment has, and the item of each; long and short items apart."""
        found = segment.find(block.symbols)
        sizes = np.diff(block.begin)
        for length in np.unique(np.minimum(sizes, window)).tolist():
            long = sizes >= window if length == window else sizes == length
            starts, of = _spread(block.begin[:-1][long], sizes[long] - length + 1)
            for at in range(0, len(starts), _WINDOWS):
                rows = found[starts[at : at + _WINDOWS, None] + np.arange(length)]
                known = (rows >= 0).all(axis=1)
                yield rows[known], block.owner[long][of[at : at + _WINDOWS][known]]

    def one(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        segment = Segment(*(batch.column(n)[row].as_py() for n in ("terms", "postings", "positions", "words")))
        n_docs, n_words = len(segment.words), int(segment.doc_begin[-1])
        edges = {kind: np.zeros(n_words + 1, np.int64) for kind in kinds}
        pairs = {kind: [np.zeros(0, np.int64)] for kind in kinds}
        for rows, owner in windows_of(segment) if len(segment.terms) else ():
            for kind in kinds:
                which, start = segment.phrases(rows) if kind == "hit" else segment.near(rows, slop)
                edges[kind] += np.bincount(start, minlength=n_words + 1) - np.bincount(start + (rows.shape[1] if kind == "hit" else 1), minlength=n_words + 1)
                pairs[kind].append(np.unique(segment.document(start) * n_items + owner[which]))
        made = [pa.array(np.full(n_docs, batch.column("segment")[row].as_py())), pa.array(np.arange(n_docs)), *(batch.column(f"c{i}")[row].values for i in range(len(carry))), pa.array(segment.words)]
        for kind in kinds:
            hit = np.cumsum(edges[kind][:-1]) > 0
            both = np.unique(np.concatenate(pairs[kind]))
            doc, item = both // n_items, both % n_items
            upto = np.concatenate([[0], np.cumsum(hit)])
            bits = [None] * n_docs
            for d in np.unique(doc):
                bits[d] = np.packbits(hit[segment.doc_begin[d] : segment.doc_begin[d + 1]]).tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), pa.array([block.items[i] for i in item], pa.string()))
            made += [pa.array(np.diff(upto[segment.doc_begin]), pa.int64()), pa.array(bits, pa.binary()), lists]
        return pa.RecordBatch.from_arrays(made, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(batch, row)

    return index.mapInArrow(run, schema)


def _kinds(slop: int | None) -> tuple[str, ...]:
    return ("hit",) if slop is None else ("hit", "near")


def _counted(found: DataFrame, carry: tuple[str, ...], blocks: int, kinds: tuple[str, ...]) -> DataFrame:
    """The carried columns, n_words, and of each kind the count and the items (sorted): the union of what the blocks found."""
    columns = [*carry, "n_words", *(c for kind in kinds for c in (F.col(f"n_{kind}"), F.array_sort(f"{kind}_items").alias(f"{kind}_items")))]
    if blocks < 2:
        return found.select(columns)
    # at most as many rows for a document as there are blocks
    merged = [x for kind in kinds for x in (F.collect_list(f"{kind}_bits").alias(f"{kind}_bits"), F.array_distinct(F.flatten(F.collect_list(f"{kind}_items"))).alias(f"{kind}_items"))]
    grouped = found.groupBy("segment", "ordinal").agg(*(F.first(c).alias(c) for c in carry), F.max("n_words").alias("n_words"), *merged).drop("segment", "ordinal")
    schema = T.StructType([T.StructField(f"n_{f.name[:-5]}", T.LongType()) if f.name.endswith("_bits") and f.name[:-5] in kinds else f for f in grouped.schema.fields])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if name.endswith("_bits") and name[:-5] in kinds:
                column = pa.array([int(np.bitwise_count(np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in x])).sum()) if x else 0 for x in column.to_pylist()], pa.int64())
            made.append(column)
        return pa.RecordBatch.from_arrays(made, names=schema.names)

    return grouped.mapInArrow(per_batch(run), schema).select(columns)


def matches(index: DataFrame, items: DataFrame, window: int = 10, carry: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", text: str = "text", slop: int | None = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The carried columns, n_words, n_hit and hit_items, n_near and near_items of every indexed document.

    Windows are of `window` words, or whole shorter items. n_hit counts words in
    exact matches, n_near places of proximity matches; without `slop` only the
    former are looked for.
    """
    found, blocks = None, 0
    for block in query_blocks(items, item_id, text, block_words):
        part = _search(index, block, window, carry, slop)
        part = part if not blocks else written(part.where(" or ".join(f"size({kind}_items) > 0" for kind in _kinds(slop))), "hits")
        found = part if found is None else found.unionByName(part)
        blocks += 1
    if found is None:
        found = _search(index, Block(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), []), window, carry, slop)
    return _counted(found, carry, blocks, _kinds(slop))


def phrases(index: DataFrame, items: DataFrame, window: int = 10, carry: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The carried columns, n_words, n_hit and items of every indexed document: exact matches only."""
    return matches(index, items, window, carry, item_id, text, None).withColumnRenamed("hit_items", "items")


def contaminated_keys(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """_key, the MD5 of each text (null as empty) that has a match."""
    keyed = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_key"), text)
    found = phrases(build_index(keyed, text, ("_key",)), items, window, ("_key",))
    return written(found.where("n_hit > 0").select("_key").distinct(), "leaks")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", broadcast_keys: int = 100_000) -> DataFrame:
    """`docs` without the contaminated ones; a short list of their keys is broadcast, a longer one joined by shuffle."""
    keys = contaminated_keys(docs, items, window, text)
    keys = F.broadcast(keys) if keys.count() <= broadcast_keys else keys
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_key"))
    return rows.join(keys, "_key", "left_anti").select("_row.*")
