"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are folded first: lower case, homoglyphs and full-width letters as Latin
ones, digits and signs inside words as the letters they stand for. The lexicon
has whole words and beginnings of words with the log-odds that labelled toxic
documents hold them rather than others; a beginning is an entry only where several
different words with it are in toxic documents and no longer one does as well. Of
the entries that match a word the longest counts. Exception phrases are entries of weight zero, one word or more,
that cover what stands in them: words that only begin like toxic ones, and pairs
of neighbouring words in which a toxic one is not meant so. Both are learned from
where the labelled documents have them. The weights found are summed and set
against the length of the text; a logistic function of both, fitted on the same
labelled documents, gives the score.

Training sees about `max_train` labelled documents of either label, chosen by a
hash of their ids; that bounds the lexicon too. All that they say is used.

Defined cases: null and empty texts score as texts without a match; rows with a
null label are no training rows; labels repeated for a document count once, and
of documents that share an id one text trains (the least);
without labels of both kinds the lexicon is empty and all scores are the share
of toxic labels, 0 without labels; of entries that start together the longest
counts, of equal scores none is preferred; a long text with many matches and
exceptions takes time in proportion; repeated rows keep their rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import written
from quarry.llm.letters import look_folded

MAX_TRAIN = 6000
#: Lengths of word beginnings that may become entries.
STEMS = range(3, 9)
#: Documents an entry must be seen in, its least log-odds, and clean documents an exception must be seen in.
MIN_SUPPORT = 5
MIN_WEIGHT = 2.0
MIN_EXCEPTION = 3
#: Different words of toxic documents that a beginning must begin, and the share of its documents above which a longer one takes its place.
MIN_KINDS = 4
MOST_OF = 0.8


def entries_of(folded: str) -> set[str]:
    """Candidates of a folded text: " stem" for beginnings, " word " for whole words."""
    words = set(folded.split())
    return {f" {w[:k]}" for w in words for k in STEMS if k <= len(w)} | {f" {w} " for w in words if len(w) >= 3}


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the logistic function of what is found."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def matcher(self):
        """The automaton: entry to (length, weight); exceptions last, so that they win over equal entries."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight, False))
        for phrase in self.exceptions:
            key = f" {look_folded(phrase).strip()} "
            if key.strip():
                out.add_word(key, (len(key), 0.0, True))
        out.make_automaton()
        return out

    def features(self, automaton, text: str | None) -> np.ndarray:
        """1, the summed weights against the words (as logarithms and as a share), the largest weight, and how many entries differ."""
        return self.measured(automaton, look_folded(text or ""))

    def matches(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """start, end and weight of the entries that count: the longest at each place, outside of exceptions."""
        best: dict[int, tuple[int, float]] = {}
        covered: list[tuple[int, int]] = []
        if len(automaton):
            for end, (size, weight, exception) in automaton.iter(folded):
                start = end - size + 1
                if exception:
                    covered.append((start, end))
                elif best.get(start, (0, 0.0))[0] < size:
                    best[start] = (size, weight)
        covered.sort()
        begins = [s for s, _ in covered]
        furthest = list(accumulate((e for _, e in covered), max))  # of the exceptions up to each one
        out = []
        for start, (size, weight) in best.items():
            at = bisect_right(begins, start)
            if not at or furthest[at - 1] < start + size - 1:
                out.append((start, start + size, weight))
        return out

    def measured(self, automaton, folded: str) -> np.ndarray:
        words = folded.count(" ") - 1 if len(folded) > 1 else 0
        found = self.matches(automaton, folded)
        total, top = sum(w for *_, w in found), max((w for *_, w in found), default=0.0)
        kinds = {folded[s:e] for s, e, _ in found}
        return np.array([1.0, np.log1p(total) - np.log1p(words), total / (words + 20.0), top, np.log1p(len(kinds))])

    def contexts(self, automaton, folded: str) -> set[tuple[str, str]]:
        """The words that entries match in a text, and each with its neighbour before and after."""
        out = set()
        for start, end, _ in self.matches(automaton, folded):
            last = folded.index(" ", end - 1)  # the end of the word that the entry stands for or begins
            word = folded[start : last + 1]
            out.add((word, word))
            before, after = folded.rfind(" ", 0, start), folded.find(" ", last + 1)
            if before >= 0:
                out.add((word, folded[before : last + 1]))
            if after >= 0:
                out.add((word, folded[start : after + 1]))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))


def chosen(toxic: Counter, clean: Counter, kinds: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """The entries that tell toxic documents from others, without those that another one makes needless.

    Entries and counts are of documents; `kinds` has how many different words of
    toxic documents begin with an entry. A beginning of one or few words is no
    entry: what else begins like them may be harmless. Of beginnings of the same words
    the longest stays. A longer entry within a kept one stays if it is clearly surer.
    """
    weight = {}
    for entry, a in toxic.items():
        b = clean.get(entry, 0)
        w = float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1)))
        if a >= MIN_SUPPORT and w >= MIN_WEIGHT and a > 2 * b and (entry.endswith(" ") or kinds.get(entry, 0) >= MIN_KINDS):
            weight[entry] = w
    stems = {e for e in weight if not e.endswith(" ")}
    vague = {e[:-1] for e in stems if e[:-1] in stems and toxic[e] >= MOST_OF * toxic[e[:-1]]}
    kept: dict[str, float] = {}
    for entry in sorted(weight.keys() - vague, key=lambda e: (len(e), e)):
        above = [kept[entry[:k]] for k in range(4, len(entry)) if entry[:k] in kept]
        if not above or weight[entry] > max(above) + 0.7:
            kept[entry] = weight[entry]
    return kept


def exception_phrases(weights: dict[str, float], seen: list[tuple[str, str, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """The phrases (word matched, phrase, toxic and clean documents) that are no likelier in toxic documents.

    A word that is an entry itself is no exception, but a phrase with it may be;
    phrases of a word that is an exception are needless.
    """
    good = [(word, phrase) for word, phrase, a, b in seen if b >= MIN_EXCEPTION and (a + 0.5) / (n_toxic + 1) <= (b + 0.5) / (n_clean + 1)]
    words = {word for word, phrase in good if word == phrase and word not in weights}
    return sorted({phrase.strip() for word, phrase in good if phrase in words or (word != phrase and word not in words)})


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_train: int = MAX_TRAIN, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon of the labelled documents in `docs`; `docs` has training rows only."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).distinct()
    present = docs.select(F.col(doc_id).alias("_id")).join(known, "_id").distinct()
    found = {r["y"]: r["n"] for r in present.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found.get(0) or not found.get(1):
        share = float(1 in found)
        return Lexicon({}, [], np.array([30.0 if share else -30.0, 0, 0, 0, 0]))
    order = F.xxhash64(F.lit("train"), F.col("_id"))
    odds = F.when(F.col("y") == 1, min(1.0, max_train / found[1])).otherwise(min(1.0, max_train / found[0]))
    picked = present.where((order.bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < odds)
    # about max_train ids of either label; sent to every task only if they are no more than that
    n_picked = sum(min(max_train, n) for n in found.values())
    picked = F.broadcast(picked) if n_picked <= 4 * MAX_TRAIN else picked
    sample = written(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).join(picked, "_id").groupBy("_id", "y").agg(F.min("t").alias("t")).select("y", "t"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[y].update(entries_of(look_folded(t or "")))
        both = sorted(sums[0].keys() | sums[1].keys())
        for at in range(0, len(both), 50_000):
            some = both[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([sums[1][e] for e in some], pa.int64()), pa.array([sums[0][e] for e in some], pa.int64())], names=["entry", "a", "b"])

    # both what may be an entry and what beginnings begin are such; counted once
    counted = sample.mapInArrow(count, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    entries = written(counted.where(F.col("a") > 2 * F.col("b")), "entries")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    odds_ratio = (F.col("a") + 0.5) / (n_toxic + 1) / ((F.col("b") + 0.5) / (n_clean + 1))
    # what can become an entry: as many as words of the labelled sample at most
    rows = entries.where((F.col("a") >= MIN_SUPPORT) & (odds_ratio >= float(np.exp(MIN_WEIGHT)))).collect()
    words = entries.where(F.col("entry").endswith(" ")).select("entry", F.length("entry").alias("n"))
    begun = words.select(F.explode(F.array(*[F.when(F.col("n") >= k + 2, F.substring("entry", 1, k + 1)) for k in STEMS])).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    # beginnings are at most as many as candidates, which need the support of MIN_SUPPORT documents of the sample
    kinds = Counter({r["entry"]: r["n"] for r in begun.where(F.col("entry").isNotNull() & (F.col("n") >= MIN_KINDS)).collect()})
    weights = chosen(Counter({r["entry"]: r["a"] for r in rows}), Counter({r["entry"]: r["b"] for r in rows}), kinds, n_toxic, n_clean)
    lexicon = Lexicon(weights, list(exceptions))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        sums: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pair in lexicon.contexts(automaton, look_folded(t or "")):
                    sums.setdefault(pair, [0, 0])[1 - y] += 1
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in sums]), pa.array([p[1] for p in sums]), *(pa.array([n[i] for n in sums.values()], pa.int64()) for i in (0, 1))], names=["word", "phrase", "a", "b"])

    if weights:
        seen = sample.mapInArrow(around, "word string, phrase string, a long, b long").groupBy("word", "phrase").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        lexicon.exceptions += exception_phrases(weights, [tuple(r) for r in seen.where((F.col("b") >= MIN_EXCEPTION) & (odds_ratio <= 1)).collect()], n_toxic, n_clean)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            if batch.num_rows:
                x = np.stack([lexicon.features(automaton, t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], names=["y", *(f"x{i}" for i in range(5))])

    table = np.array([tuple(r) for r in sample.mapInArrow(measure, "y int, x0 double, x1 double, x2 double, x3 double, x4 double").collect()])
    if len(table):
        lexicon.coefficients = fitted(table[:, 1:], table[:, 0])
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, score and predicted of every document."""
    slim = docs.select(*carry, F.col(text).alias("_text"))
    n = len(carry)
    schema = T.StructType([*slim.schema.fields[:n], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                score = lexicon.score(np.stack([lexicon.features(automaton, t) for t in part.column(n).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return slim.mapInArrow(run, schema)
