"""Fill-in-the-middle forms of documents, cut by a sparse index of checkpoints.

A document is counted once, in units: code points, or matches of a pattern. While
it is counted, the byte and code-point offset of every `every`-th unit goes into
a small index. A cut is then found by binary search in that index and a rescan
of fewer than `every` units, and the pieces are cut out as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import per_batch
from quarry.llm.textvec import string_buffer

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = "<[PSM]>"
#: Units from one checkpoint to the next.
EVERY = 1024
#: Bytes that are looked at together while code points are counted.
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Checkpoints:
    """How many units a text has, and where every `every`-th one begins, the first included."""

    n: int
    unit_at: np.ndarray
    byte_at: np.ndarray
    point_at: np.ndarray

    def before(self, unit: int) -> tuple[int, int, int]:
        """Units, bytes and code points before the last checkpoint at or before a unit."""
        at = int(np.searchsorted(self.unit_at, unit, "right")) - 1
        return int(self.unit_at[at]), int(self.byte_at[at]), int(self.point_at[at])

    def after(self, unit: int) -> int | None:
        """The byte of the first checkpoint after a unit."""
        at = int(np.searchsorted(self.unit_at, unit, "right"))
        return int(self.byte_at[at]) if at < len(self.byte_at) else None


def _starts(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a code point."""
    return (data & 0xC0) != 0x80


def indexed(data: np.ndarray, pattern: re.Pattern | None = None, every: int = EVERY) -> Checkpoints:
    """The checkpoints of a text's UTF-8 bytes; memory is one block and the checkpoints."""
    bytes_at, points_at, n = [0], [0], 0
    if pattern is None:
        for first in range(0, len(data), _BLOCK):
            at = np.flatnonzero(_starts(data[first : first + _BLOCK]))
            marks = np.arange(-n % every, len(at), every)
            bytes_at += (first + at[marks[(marks + n) > 0]]).tolist()
            n += len(at)
        units_at = np.arange(len(bytes_at)) * every
        return Checkpoints(n, units_at, np.array(bytes_at), units_at)
    text, point, byte = data.tobytes().decode(), 0, 0
    for match in pattern.finditer(text):
        if match.end() == match.start():
            continue
        if n and n % every == 0:
            # the unit before ended at `point`, so this one begins there
            bytes_at.append(byte)
            points_at.append(point)
        byte += len(text[point : match.end()].encode())
        point = match.end()
        n += 1
    return Checkpoints(n, np.arange(len(bytes_at)) * every, np.array(bytes_at), np.array(points_at))


def located(data: np.ndarray, index: Checkpoints, unit: int, pattern: re.Pattern | None = None) -> tuple[int, int]:
    """The byte and code point where the first `unit` units end: a checkpoint, then a short rescan."""
    have, byte, point = index.before(unit)
    if have == unit:
        return byte, point
    if unit >= index.n:
        # what follows the last unit belongs to it
        return len(data), point + int(_starts(data[byte:]).sum())
    if pattern is None:
        # a code point has at most four bytes
        at = np.flatnonzero(_starts(data[byte : byte + 4 * (unit - have) + 4]))
        return byte + int(at[unit - have]), point + unit - have
    text = data[byte : index.after(unit)].tobytes().decode()
    end = 0
    for match in pattern.finditer(text):
        if match.end() == match.start():
            continue
        end, have = match.end(), have + 1
        if have == unit:
            break
    return byte + len(text[:end].encode()), point + end


def _hash(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits of a hash of the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def infilled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str | None = None, seed: int = 1, plain: int = 10, spm: int = 20, every: int = EVERY) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output: each document in its form for training on middles.

    n counts units; without a pattern they are code points, else the pattern's
    matches from left to right (it must not look around itself; empty matches don't
    count; text before a match goes with it, text after the last one with that). The id's hash says where
    the two cuts lie, which documents stay plain (`plain` of a hundred) and which of
    the others begin with the suffix (`spm` of a hundred). Plain are also empty
    texts, texts without a unit and texts that hold a marker.

    A null text is empty; a null id hashes as an empty one; repeated rows give
    repeated rows; an empty table gives an empty result. Other columns stay
    behind, so their names don't matter. A long text takes memory in proportion
    to itself; counting looks at blocks of it.
    """
    unit = re.compile(pattern) if pattern is not None else None
    body = F.coalesce(F.col(text), F.lit(""))
    h = _hash(F.col(doc_id), seed)
    stays = (body == "") | body.rlike(MARKERS) | (h[2] % 100 >= 100 - plain)
    wanted = F.when(stays, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), h[0].alias("h1"), h[1].alias("h2"), wanted.alias("form"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def one(data: np.ndarray, form: str, h1: int, h2: int) -> tuple[int, str, int | None, int | None, bytes]:
        index = indexed(data, unit, every)
        if form == "plain" or not index.n:
            return index.n, "plain", None, None, data.tobytes()
        first, last = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        (a, points_a), (b, points_b) = located(data, index, first, unit), located(data, index, last, unit)
        prefix, middle, suffix = (data[x:y].tobytes() for x, y in ((0, a), (a, b), (b, len(data))))
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        out = [p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle]
        return index.n, form, points_a, points_b - points_a, b"".join(out)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = string_buffer(batch.column("text"))
        forms, h1, h2 = (batch.column(c).to_pylist() for c in ("form", "h1", "h2"))
        found = [one(data[offsets[i] : offsets[i + 1]], forms[i], h1[i], h2[i]) for i in range(batch.num_rows)]
        n, form, prefix, middle, out = zip(*found, strict=True)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(per_batch(cut, 256), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; its markers stand in it once each, as others stayed plain."""
    part = F.split(output, MARKERS, -1)
    piece = lambda *order: F.concat(*[F.get(part, F.lit(i)) for i in order])
    return F.when(form == "psm", piece(1, 3, 2)).when(form == "spm", piece(2, 3, 1)).otherwise(output)


def checkpoint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str | None = None, every: int = EVERY) -> DataFrame:
    """doc_id, n, byte_at and point_at: the index itself, for jobs that cut the same documents again and again. Nulls as in `infilled`."""
    unit = re.compile(pattern) if pattern is not None else None
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffer(batch.column("text"))
            found = [indexed(data[offsets[i] : offsets[i + 1]], unit, every) for i in range(batch.num_rows)]
            lists = pa.list_(pa.int64())
            columns = [batch.column("doc_id"), pa.array([x.n for x in found], pa.int64()), pa.array([x.byte_at for x in found], lists), pa.array([x.point_at for x in found], lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "byte_at", "point_at"])

    return rows.mapInArrow(index, f"doc_id {kind}, n long, byte_at array<long>, point_at array<long>")
