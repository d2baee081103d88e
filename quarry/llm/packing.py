"""Packing token sequences by the sum-of-squares rule, online.

Windows have a capacity; N[h] is the number of partially filled windows at fill
level h, kept in an array over the levels. A document goes where the sum of
N[h] ** 2 is least afterwards, a new window included. Documents as long as a
window or longer first give off full windows.

Token ids are made in all tasks and written. Lengths alone are then packed, by
tasks of about `task_docs` documents each, so that a task has enough of them for
the rule to fill windows: the more it sees, the more windows end exactly full.
After its documents a task drains the windows left open: the emptiest are cut up
to fill the fullest, and what the last one holds is cut at powers of two, which
need no padding. A task of more than twice `task_docs` documents drains in
between, which bounds the open windows. Only pieces that were cut go back to
their ids. Every task packs by itself and its sequence ids start with its
number. `closed_by` says what filled a sequence: `whole` (one long document),
`rule`, or `drain`.

Defined cases: null and empty texts are one end token; null ids and repeated
rows are packed like any other; a document of any length is cut into windows as
its ids come; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import written
from quarry.llm.textvec import WHITE, word_spans, word_symbols

CAPACITY = 2048
END = 1
#: Texts of these characters only are split by FAST; others go to the tokenizer whole.
_PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-įı-ſ]*")
#: What the vocabulary's pre-tokenizer does to such texts after lower-casing.
_FAST = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")
#: Runs without white space of which the ids are kept.
_KEPT_RUNS = 2_000_000
#: Documents that one task packs, about.
TASK_DOCS = 25_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts.

    The vocabulary's pre-tokenizer cuts at white space and then splits each run
    into parts that are encoded one by one. So the runs of a group of texts are
    told apart by fingerprint, those not known are encoded once, all in one
    text, and the ids are laid out by index. What is kept is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # fingerprints of runs, sorted
        self.base, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _learn(self, prints: np.ndarray, runs: list[str]) -> None:
        """Take in new runs; `prints` are sorted."""
        found, sizes = [self.ids], []
        for at in range(0, len(runs), 2000):
            some = runs[at : at + 2000]
            ids = self._whole(" ".join(some))
            ends = np.flatnonzero(self.ends[ids]) + 1  # each part ends with a token that says so
            last = np.cumsum([len(_FAST.findall(run)) for run in some]) - 1
            if len(ends) == last[-1] + 1:
                sizes.append(np.diff(ends[last], prepend=0))
                found.append(ids)
            else:
                each = [self._whole(run) for run in some]
                sizes.append(np.array([len(x) for x in each]))
                found.extend(each)
        size = np.concatenate(sizes)
        base = len(self.ids) + np.cumsum(size) - size
        at = np.searchsorted(self.known, prints)
        self.known, self.base, self.size = (np.insert(old, at, new) for old, new in ((self.known, prints), (self.base, base), (self.size, size)))
        self.ids = np.concatenate(found)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        raw = [t.lower().encode() for t, ok in zip(texts, plain, strict=True) if ok]
        quick = iter(self._by_runs(raw))
        return [next(quick) if ok else self._whole(t) for t, ok in zip(texts, plain, strict=True)]

    def _by_runs(self, raw: list[bytes]) -> list[np.ndarray]:
        data = b"".join(raw)
        starts, ends, index = word_spans(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, raw)]), WHITE)
        if not len(starts):
            return [np.zeros(0, "<u4")] * len(raw)
        prints, first, inverse = np.unique(word_symbols(np.frombuffer(data, np.uint8), starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(prints) > _KEPT_RUNS:
            self._forget()
        new = np.ones(len(prints), bool)
        if len(self.known):
            new = self.known[np.minimum(np.searchsorted(self.known, prints), len(self.known) - 1)] != prints
        if new.any():
            self._learn(prints[new], [data[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        at = np.searchsorted(self.known, prints)
        sizes, base = self.size[at], self.base[at]
        n = sizes[inverse]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(base[inverse] - upto[:-1], n) + np.arange(upto[-1])]
        return np.split(flat, upto[index[1:-1]])


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process: its tasks share what has been looked up."""
    return Encoder(path)


class SumOfSquares:
    """Open windows by level. Pieces are (payload, length); full windows are handed to `close` with what filled them."""

    def __init__(self, capacity: int, close: Callable[[list, str], None]):
        self.capacity, self.close = capacity, close
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new window, that leaves the least sum of squares; the fullest of equals."""
        below = np.arange(self.capacity - size + 1)
        usable = (self.count[: len(below)] > 0) | (below == 0)
        gain = 2 * self.count[size:] + 1
        gain[-1] = 0  # a full window is no longer counted
        loss = 1 - 2 * self.count[: len(below)]
        loss[0] = 0
        change = np.where(usable, gain + loss, np.iinfo(np.int64).max)
        return int(len(below) - 1 - np.argmin(change[::-1]))

    def place(self, piece, size: int) -> None:
        level = self.level_for(size)
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window = []
        window.append((piece, size))
        if level + size == self.capacity:
            self.close(window, "rule")
        else:
            self.open[level + size].append(window)
            self.count[level + size] += 1

    def drain(self, cut: Callable) -> None:
        """Close all windows; cut(piece, n) gives the first n tokens of a piece and the rest."""
        rest = [w for level in range(self.capacity, 0, -1) for w in self.open[level]]
        loose: list = []
        while rest or loose:
            window = rest.pop(0) if rest else []
            room = self.capacity - sum(n for _, n in window)
            while room and (loose or rest):
                if not loose:
                    loose = rest.pop()
                piece, n = loose.pop()
                if n > room:
                    piece, left = cut(piece, room)
                    loose.append((left, n - room))
                    n = room
                window.append((piece, n))
                room -= n
            if not room:
                self.close(window, "drain")
                continue
            size = 1 << (self.capacity.bit_length() - 1)
            while window:  # the only one that is left: by powers of two
                total = sum(n for _, n in window)
                while size > total:
                    size >>= 1
                part, have = [], 0
                while have < size:
                    piece, n = window.pop(0)
                    if have + n > size:
                        piece, left = cut(piece, size - have)
                        window.insert(0, (left, n - size + have))
                        n = size - have
                    part.append((piece, n))
                    have += n
                self.close(part, "drain")
        self.open = [[] for _ in range(self.capacity + 1)]
        self.count[:] = 0


def encoded(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The written table of the carried columns (c0, ...), row (a number of its own), tokens, the CRC-32 of each window's ids, and ids of every document."""
    vocabulary = vocabulary or default_vocabulary()
    n = len(carry)
    slim = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("_text"))
    fields = [*slim.schema.fields[:n], T.StructField("row", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType())]
    schema = T.StructType(fields)
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(vocabulary)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x.tobytes() + last for x in coder.encode([t or "" for t in part.column(n).to_pylist()])]
                crcs = [[zlib.crc32(x[i : i + 4 * capacity]) for i in range(0, len(x), 4 * capacity)] for x in ids]
                made = [pa.array(np.arange(number, number + len(ids))), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.binary())]
                number += len(ids)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *made], names=schema.names)

    return written(slim.mapInArrow(run, schema), "tokens")


def placed(tokens: DataFrame, capacity: int = CAPACITY, task_docs: int = TASK_DOCS) -> DataFrame:
    """One row per piece of the documents of `encoded`: c0, ..., row, start, length, ids_crc32 (null where a document was cut), doc_tokens, sequence_id, offset, closed_by."""
    carried = [f for f in tokens.schema.fields if f.name not in ("row", "tokens", "crcs", "ids")]
    numbers = ("row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([*carried, *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("closed_by", T.StringType())])
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, seen = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        kinds: list[pa.DataType] = []

        def close(window: list, by: str) -> None:
            nonlocal made
            offset = 0
            for (who, row, start, total, crc), size in window:
                rows.append((*who, row, start, size, crc, total, (task << 32) + made, offset, by))
                offset += size
            made += 1

        def cut(piece: tuple, size: int) -> tuple[tuple, tuple]:
            who, row, start, total, _ = piece
            return (who, row, start, total, None), (who, row, start + size, total, None)

        def flushed() -> pa.RecordBatch:
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        packer = SumOfSquares(capacity, close)
        for batch in batches:
            kinds = [*(batch.column(i).type for i in range(n)), *[pa.int64()] * len(numbers), pa.string()]
            for *who, row, total, crcs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = total // capacity
                for i in range(full):
                    close([((who, row, i * capacity, total, crcs[i]), capacity)], "whole")
                if total > full * capacity:
                    packer.place((who, row, full * capacity, total, crcs[full]), total - full * capacity)
                seen += 1
                if seen >= 2 * task_docs:
                    packer.drain(cut)
                    seen = 0
                if len(rows) >= 5000:
                    yield flushed()
        packer.drain(cut)
        if rows:
            yield flushed()

    narrow = tokens.select(*[f.name for f in carried], "row", "tokens", "crcs")
    return narrow.coalesce(max(1, round(tokens.count() / task_docs))).mapInArrow(run, schema)


def packed(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, task_docs: int = TASK_DOCS, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per piece: the carried columns, start, length, ids_crc32, doc_tokens, sequence_id, offset, closed_by, and ids if wanted."""
    tokens = encoded(docs, text, carry, vocabulary, capacity, end)
    pieces = written(placed(tokens, capacity, task_docs), "pieces")
    out = [*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed_by"]
    part = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    texts = tokens.select(F.col("row").alias("_of"), "ids")
    if with_ids:
        return pieces.join(texts, pieces["row"] == texts["_of"]).withColumn("ids", part).select(*out[:-5], F.crc32("ids").alias("ids_crc32"), *out[-4:], "ids")
    whole, cuts = pieces.where("ids_crc32 is not null"), pieces.where("ids_crc32 is null")
    cuts = F.broadcast(cuts) if cuts.count() <= broadcast_rows else cuts
    cut = texts.join(cuts, texts["_of"] == cuts["row"]).withColumn("ids_crc32", F.crc32(part))
    return whole.select(*out).unionByName(cut.select(*out))
