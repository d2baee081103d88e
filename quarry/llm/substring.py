"""Repeated passages across and inside documents, by prefix-partitioned suffix trees.

The suffixes of all documents that have at least `window` words are split into
groups by prefixes of variable length, each group small enough for memory; a
group's suffixes are sorted by their words, and its suffix tree is looked at
from depth `window` on: an internal node there is a passage that starts in two
or more places. Groups hold the words themselves, so that equality is equality
of words; 64-bit fingerprints only say which group a suffix goes to.

* Sparse prefixes. Of each window the least fingerprint of its GRAM-word grams
  stands for it; equal windows have equal ones. Grams that occur once in the
  corpus end the trees of their windows: no repeat is below them.
* Groups. The windows of a gram make one group; neighbouring ones are one row
  with the words they cover. A gram with more than `group_rows` occurrences is
  split by the longest prefix, the whole window. Copies that a task has read are
  merged before, so a passage in a third of all documents is at most one row of
  each batch.
* Trees. A group's suffixes are sorted by prefix doubling over word numbers.
  Neighbours in that order which agree in `window` words are leaves below one
  internal node; a node with two leaves marks its windows as repeated, and
  neighbouring windows of a document join to its repeated passages.
  `maximal_repeats` reads all deep nodes of one such tree.

Documents are joined with their grams and with their marks by a 64-bit hash of
the text and its CRC-32, together 96 bits; both joins use the same exchange.

Defined cases: null text has no words; texts of fewer words than a window have
no repeats; copies and repeated rows are repeats of each other, first one
included; ids are carried, not used; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import per_batch
from quarry.llm.textvec import WHITE, gram_prints, mix, sliding_min, slices, string_buffer, word_spans, word_symbols

GRAM = 10
#: Windows in a row of a group: bits of its mask.
RUN = 32


def _texts(column: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, text bytes, word starts and ends in them, and word symbols."""
    data, offsets = string_buffer(column)
    for first, last in slices(offsets):
        part = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        starts, ends, index = word_spans(part, at, WHITE)
        symbols = word_symbols(part, starts, ends)
        for r in range(last - first):
            w = slice(index[r], index[r + 1])
            yield first + r, part[at[r] : at[r + 1]], starts[w] - at[r], ends[w] - at[r], symbols[w]


def _sorted_in(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _census(batch: pa.RecordBatch, window: int, gram: int) -> pa.RecordBatch:
    """gram, key, n: how often the grams that stand for a document's windows occur in it."""
    grams, keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    key = batch.column(0).to_numpy()
    for row, _, _, _, symbols in _texts(batch.column(1)):
        if len(symbols) < window:
            continue
        prints = gram_prints(symbols, gram)
        least = np.unique(sliding_min(prints, window - gram + 1))
        found, n = np.unique(prints[_sorted_in(prints, least)], return_counts=True)
        grams.append(found)
        counts.append(n)
        keys.append(np.full(len(found), key[row]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], names=["gram", "key", "n"])


_GROUP_FIELDS = [("route", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("check", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("mask", pa.int64()), ("words", pa.binary())]
_GROUP_NAMES = [name for name, _ in _GROUP_FIELDS]
_GROUP_SCHEMA = "route long, kind int, key long, check long, start int, n int, mask long, words binary"
#: Rows that want an answer, rows that only count, and marks known already.
_ASK, _COUNT, _KNOWN = 0, 1, 2


def _all_windows(n: int) -> int:
    """The mask of n windows, as a signed long."""
    return (1 << n) - 1


def _suffixes(batch: pa.RecordBatch, window: int, gram: int) -> pa.RecordBatch | None:
    """The windows of a batch whose grams are repeated, as rows for their groups.

    Equal runs of windows in the batch answer each other; their group gets one
    row of them, which only counts.
    """
    key = batch.column(0).to_numpy()
    lists = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3))]
    times: dict[tuple[int, int], int] = {}
    texts = {}
    for row, text, starts, ends, symbols in _texts(batch.column(1)):
        if len(symbols) >= window:
            raw = text.tobytes()
            who = (int(key[row]), zlib.crc32(raw))
            times[who] = times.get(who, 0) + 1
            if times[who] == 1:
                texts[who] = (row, raw, starts, ends, symbols)
    runs: dict[tuple[int, bytes], list] = {}  # of light groups: gram and words to who has them, where, and how many windows
    deep: list[tuple] = []  # two fingerprints, start, document of windows in heavy groups
    people = list(texts)
    for d, who in enumerate(people):
        row, raw, starts, ends, symbols = texts[who]
        light, heavy = (np.sort(values[offsets[row] : offsets[row + 1]]) for offsets, values in lists)
        least = sliding_min(gram_prints(symbols, gram), window - gram + 1)
        at = np.flatnonzero(_sorted_in(least, heavy))
        if len(at):
            deep.append((gram_prints(symbols, window)[at], gram_prints(symbols, window, second=True)[at], at, np.full(len(at), d)))
        at = np.flatnonzero(_sorted_in(least, light))
        if not len(at):
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(at)))
        cuts = np.concatenate([b + np.arange(0, n, RUN) for b, n in zip(begin, sizes, strict=True)])
        last = np.append(cuts[1:], len(at)) - 1
        for g, a, z, s, e in zip(least[at[cuts]].view(np.int64).tolist(), at[cuts].tolist(), at[last].tolist(), starts[at[cuts]].tolist(), ends[at[last] + window - 1].tolist(), strict=True):
            runs.setdefault((g, raw[s:e]), []).append((who, a, z - a + 1))
    rows: list[tuple] = []
    for (g, words), found in runs.items():
        (key0, check0), start0, _ = found[0]
        if len(found) == 1 and times[found[0][0]] == 1:
            rows.append((g, _ASK, key0, check0, start0, 1, 0, words))
            continue
        rows.append((g, _COUNT, key0, check0, start0, 2, 0, words))
        rows.extend((k, _KNOWN, k, c, start, 0, _all_windows(n), b"") for (k, c), start, n in found)
    if deep:
        rows.extend(_deep_rows(*(np.concatenate(x) for x in zip(*deep, strict=True)), people, times, texts, window))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _GROUP_FIELDS, strict=True)], names=_GROUP_NAMES)


def _deep_rows(label: np.ndarray, second: np.ndarray, start: np.ndarray, doc: np.ndarray, people: list, times: dict, texts: dict, window: int) -> Iterator[tuple]:
    """The rows of windows in heavy groups; windows of the batch are equal if both fingerprints are."""
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    same = second == second[first[inverse]]
    copies = np.array([times[who] for who in people])[doc]
    total = np.bincount(inverse, np.where(same, copies, 0))
    known = np.where(same, total[inverse] >= 2, copies >= 2)
    count = np.zeros(len(label), bool)
    count[first] = total >= 2
    count |= ~same & (copies >= 2)
    route = mix(label).view(np.int64)
    for i in np.flatnonzero(known).tolist():
        k, c = people[doc[i]]
        yield k, _KNOWN, k, c, int(start[i]), 0, 1, b""
    for i in np.flatnonzero(count | ~known).tolist():
        who = people[doc[i]]
        _, raw, starts, ends, _ = texts[who]
        words = b" ".join(raw[starts[start[i]] : ends[start[i] + window - 1]].split())
        yield int(route[i]), _COUNT if known[i] else _ASK, *who, int(start[i]), 2 if known[i] else 1, 0, words


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number of each word, the same for equal words only, and for each row the index of its first word (n + 1 values)."""
    starts, ends, index = word_spans(data, offsets, WHITE)
    upto = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = data[np.repeat(starts - upto[:-1], ends - starts) + np.arange(upto[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), index


def doubled_ranks(numbers: np.ndarray, end: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, up to `depth`; a suffix stops at its row's `end`."""
    at = np.arange(len(numbers))
    out = [numbers + 1]
    while 2 << (len(out) - 1) <= depth:
        step = 1 << (len(out) - 1)
        after = np.where(at + step < end, out[-1][np.minimum(at + step, len(at) - 1)], 0)
        out.append(np.unique(out[-1] * (len(at) + 2) + after, return_inverse=True)[1] + 1)
    return out


def nodes_at(numbers: np.ndarray, end: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """For each of the suffixes (all of `depth` words or more) the node at that depth of its group's tree.

    Suffixes are sorted by group and words; neighbours that agree in `depth`
    words are below the same node.
    """
    ranks = doubled_ranks(numbers, end, depth)[-1]
    rest = depth - (1 << (depth.bit_length() - 1))
    keys = (ranks[starts + rest], ranks[starts], group)
    order = np.lexsort(keys)
    step = np.zeros(len(starts), np.int64)
    for k in keys:
        step[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(step)
    return out


def maximal_repeats(texts: list[str], least: int) -> set[tuple[str, int]]:
    """The words (joined by spaces) and number of places of the maximal repeats of at least `least` words.

    They are the deep internal nodes of the suffix tree of the texts: sorted
    suffixes, longest common prefixes of neighbours, and a node for each interval
    of neighbours that share a prefix. A node counts if what stands before its
    places differs.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    numbers, index = word_numbers(data, np.cumsum([0, *map(len, raw)]))
    if not len(numbers):
        return set()
    row = np.repeat(np.arange(len(raw)), np.diff(index))
    end = index[row + 1]
    ranks = doubled_ranks(numbers, end, 2 * int(np.diff(index).max()))
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for level in reversed(range(len(ranks))):
        step = 1 << level
        room = (a + common + step <= end[a]) & (b + common + step <= end[b])
        at = np.minimum(np.stack([a, b]) + common, len(numbers) - 1)
        common += np.where(room & (ranks[level][at[0]] == ranks[level][at[1]]), step, 0)
    words = [w for t in raw for w in t.split()]
    before = np.where(np.arange(len(numbers)) > index[row], np.concatenate([[0], numbers[:-1]]), -1 - row)
    found = set()
    open_nodes: list[tuple[int, int]] = []  # depth and first place of the nodes that the next suffix may be below
    for i, depth in enumerate([*common.tolist(), 0]):
        first = i
        while open_nodes and open_nodes[-1][0] > depth:
            deep, first = open_nodes.pop()
            places = order[first : i + 1]
            if deep >= least and (len(set(before[places].tolist())) > 1 or (before[places] < 0).any()):
                found.add((b" ".join(words[places[0] : places[0] + deep]).decode("utf-8", "replace"), len(places)))
        if depth and (not open_nodes or open_nodes[-1][0] < depth):
            open_nodes.append((depth, first))
    return found


def _trees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """key, check, start, mask of the repeated windows; the input has the rows of a group one after another."""
    names = ["key", "check", "start", "mask"]

    def masks(rows: pa.Table) -> np.ndarray:
        """For each row which of its windows are repeated in its group."""
        data, offsets = string_buffer(rows["words"])
        numbers, index = word_numbers(data, offsets)
        sizes = np.diff(index)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(numbers)) - index[:-1][owner]
        starts = np.flatnonzero(place + window <= sizes[owner])
        owner, bit = owner[starts], place[starts]
        node = nodes_at(numbers, np.repeat(index[1:], sizes), starts, rows["route"].to_numpy()[owner], window)
        leaves = np.bincount(node, rows["n"].to_numpy()[owner])
        marked = np.where(leaves[node] >= 2, np.int64(1) << bit, 0)
        return np.bitwise_or.reduceat(marked, np.searchsorted(owner, np.arange(len(sizes))))

    def found(rows: pa.Table) -> pa.RecordBatch | None:
        out = rows.select(names).combine_chunks()
        return out.to_batches()[0] if out.num_rows else None

    def answers(rows: pa.Table, mask: np.ndarray) -> pa.RecordBatch | None:
        good = (mask != 0) & (rows["kind"].to_numpy() == _ASK)
        return found(rows.set_column(rows.schema.get_field_index("mask"), "mask", pa.array(mask)).filter(pa.array(good)))

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        known = table["kind"].to_numpy() == _KNOWN
        if known.any():
            yield found(table.filter(pa.array(known)))
            table = table.filter(pa.array(~known))
        if not table.num_rows:
            continue
        held = table if held is None else pa.concat_tables([held, table])
        route = held["route"].to_numpy()
        other = np.flatnonzero(route != route[-1])
        if len(other):
            whole = held.slice(0, int(other[-1]) + 1)
            if (out := answers(whole, masks(whole))) is not None:
                yield out
            held = held.slice(int(other[-1]) + 1).combine_chunks()
        if held.num_rows > 4096:
            held, out = _merged(held, masks(held), window)
            if out.num_rows:
                yield found(out)
    if held is not None and (out := answers(held, masks(held))) is not None:
        yield out


def _merged(rows: pa.Table, mask: np.ndarray, window: int) -> tuple[pa.Table, pa.Table]:
    """A large group seen in part: rows with the same words as one that counts, if all their windows are repeated, and the answers."""
    words = rows["words"].to_pylist()
    # a run has as many windows as words beyond the first window - 1
    done = np.array([int(m) == _all_windows(len(w.split()) - window + 1) for m, w in zip(mask, words, strict=True)])
    answered = rows.set_column(rows.schema.get_field_index("mask"), "mask", pa.array(mask)).filter(pa.array(done & (rows["kind"].to_numpy() == _ASK)))
    first: dict[bytes, int] = {}
    for i in np.flatnonzero(done).tolist():
        first.setdefault(words[i], i)
    kept = np.sort(np.concatenate([np.flatnonzero(~done), np.array(list(first.values()), np.int64)]))
    out = rows.take(pa.array(kept))
    counts = done[kept]
    for name, value in (("kind", _COUNT), ("n", 2)):
        at = rows.schema.get_field_index(name)
        out = out.set_column(at, name, pa.array(np.where(counts, value, out[name].to_numpy()).astype(np.int32)))
    return out.combine_chunks(), answered


def repeats(docs: DataFrame, window: int = 35, gram: int = GRAM, text: str = "text", carry: tuple[str, ...] = ("doc_id",), group_rows: int = 2_000) -> DataFrame:
    """The carried columns, _text and the marks of repeated windows of every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.xxhash64(body).alias("_key"), body.alias("_text"))
    census = keyed.select("_key", "_text").mapInArrow(per_batch(lambda b: _census(b, window, gram)), "gram long, key long, n long")
    total = census.groupBy("gram").agg(F.sum("n").alias("total")).where("total >= 2")
    repeated = census.select("gram", "key").join(total, "gram")
    heavy = F.col("total") > group_rows
    # grouped by another key than the join's, so that the documents' side of a hot text can be split in the join
    other, back = F.col("key").cast("string").alias("_of"), F.col("_of").cast("long").alias("key")
    of_text = repeated.groupBy(other).agg(F.collect_set(F.when(~heavy, F.col("gram"))).alias("light"), F.collect_set(F.when(heavy, F.col("gram"))).alias("heavy")).select(back, "light", "heavy")
    # every column is named on both sides, so that both joins read one exchange of the documents
    asked = keyed.join(of_text, keyed["_key"] == of_text["key"])
    n = len(carry)
    suffixes = asked.select("_key", "_text", "light", "heavy", *[f"_c{i}" for i in range(n)]).mapInArrow(per_batch(lambda b: _suffixes(b, window, gram)), _GROUP_SCHEMA)
    marked = suffixes.repartition("route").sortWithinPartitions("route").mapInArrow(lambda batches: _trees(batches, window), "key long, check long, start int, mask long")
    marks = marked.groupBy(other).agg(F.collect_set(F.struct("check", "start", "mask")).alias("_marks")).select(back, "_marks")
    out = keyed.join(marks, keyed["_key"] == marks["key"], "left")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "_text", "_marks")


def _covered(n_words: int, marks: list[dict] | None, check: int, window: int) -> np.ndarray:
    """For each word whether a repeated window covers it."""
    edges = np.zeros(n_words + 1, np.int32)
    for m in marks or ():
        if m["check"] == check:
            mask, start = m["mask"] & 0xFFFFFFFFFFFFFFFF, m["start"]
            while mask:
                low = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                edges[start + low] += 1
                edges[start + low + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def without_repeats(docs: DataFrame, window: int = 35, gram: int = GRAM, text: str = "text", carry: tuple[str, ...] = ("doc_id",), group_rows: int = 2_000, with_text: bool = True) -> DataFrame:
    """The carried columns, n_words, n_removed, kept_sha256, removed (word spans [start, end)) and, if wanted, kept_text."""
    found = repeats(docs, window, gram, text, carry, group_rows)
    n = len(carry)
    fields = [*found.schema.fields[:n], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))]
    fields += [T.StructField("kept_text", T.StringType())] * with_text
    schema = T.StructType(fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        marks = batch.column(n + 1)
        for row, data, starts, ends, symbols in _texts(batch.column(n)):
            raw = data.tobytes()
            gone = _covered(len(symbols), marks[row].as_py(), zlib.crc32(raw), window) if marks[row].is_valid else np.zeros(len(symbols), bool)
            kept = b" ".join([raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
            steps = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            spans = np.column_stack([np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)]).tolist()
            rows.append((len(symbols), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, *([kept.decode("utf-8", "replace")] * with_text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))] + [pa.string()] * with_text
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *made], names=schema.names)

    return found.mapInArrow(per_batch(run, 1000), schema)
