"""Language identification with error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over letter
n-grams tells the languages that have the bit set from those that have not. A
text's margins are compared with all codewords by a loss whose bits are weighted
by how well their classifier does on each language; the nearest codeword wins.
A text whose two nearest codewords are almost as near is flagged.

Training sees about `max_train` documents, as many of each language, chosen by
a hash of their ids, but of every language LEAST_EACH if it has them and never
none; counts of languages are over all training rows. The model is a few arrays,
sent to the tasks. A text is judged as a whole, whatever its length.

Defined cases: null texts and texts without a letter are `und` with score 0 and
not ambiguous; rows with a null language or id or without a letter are no
training rows; without any training row all is `und`; one language only is
predicted with score 1; of equally near codewords the first language by name is
taken and the text is ambiguous; repeated rows keep their rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.letters import SPACE, blocks, code_points, letter_table, spaced

UNDETERMINED = "und"
#: Documents that training sees, about; those of each language at least; n-gram features after hashing; longest n-gram.
MAX_TRAIN = 4000
LEAST_EACH = 20
FEATURES = 4096
LONGEST = 3
#: Codewords nearer to each other than this share of the loss make a text ambiguous.
AMBIGUITY = 0.05
#: More languages than this are taken for a mistake in the column.
MAX_LANGUAGES = 5000


def counts(text: str) -> np.ndarray | None:
    """Hashed counts of the letter 1- to 3-grams, words apart by spaces; None without a letter."""
    total = np.zeros(FEATURES, np.int64)
    seen = False
    for part in blocks(text, LONGEST - 1):
        c = spaced(letter_table()[code_points(part)]).astype(np.uint64)
        if len(c) < 2 or not (c != SPACE).any():
            continue
        seen = True
        with np.errstate(over="ignore"):
            gram = np.zeros(len(c), np.uint64)
            for k in range(LONGEST):
                gram = gram[: len(c) - k] * np.uint64(0x100000001B3) + c[k:]
                total += np.bincount(((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=FEATURES)
    return total if seen else None


def scaled(rows: np.ndarray) -> np.ndarray:
    x = np.log1p(rows.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1: all splits for few languages, else the random code of the largest least distance."""
    if k <= 5:
        masks = np.arange(1, 1 << (k - 1)) << 1 if k > 1 else np.array([0])
        return np.where((masks[None, :] >> np.arange(k)[:, None]) & 1, 1, -1)
    rng = np.random.default_rng(seed)
    bits = max(15, int(np.ceil(10 * np.log2(k))))
    best, most = None, -1
    for _ in range(60):
        code = rng.choice([-1, 1], (k, bits))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        gram = code @ code.T
        np.fill_diagonal(gram, -bits)
        least = (bits - gram.max()) // 2
        if least > most:
            best, most = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features + 1 x bits
    trust: np.ndarray  # languages x bits, rows sum to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights[:-1] + self.weights[-1]
        return np.stack([(np.logaddexp(0, -margin * self.code[c]) * self.trust[c]).sum(axis=1) for c in range(len(self.languages))], axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The index of the language, a score and whether it is ambiguous, for each row."""
        loss = self.losses(x)
        best = loss.argmin(axis=1)
        if loss.shape[1] == 1:
            return best, np.ones(len(x)), np.zeros(len(x), bool)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4)
        p /= p.sum(axis=1, keepdims=True)
        near = np.sort(loss, axis=1)
        return best, p.max(axis=1), (near[:, 1] - near[:, 0]) < AMBIGUITY * near.sum(axis=1) / loss.shape[1]


def fitted(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 120) -> Model:
    """Logistic bit classifiers by gradient steps with momentum, and how far each bit is to be trusted for each language."""
    code = codewords(len(languages))
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    target = code[y].astype(np.float32)
    share = 1.0 / np.bincount(y, minlength=len(languages))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w = np.zeros((x1.shape[1], code.shape[1]), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        slope = -(x1.T @ (share * target / (1 + np.exp(np.clip(target * (x1 @ w), -30, 30))))) + 1e-5 * w
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        w -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    right = (x1 @ w) * target > 0
    trust = np.stack([right[y == c].mean(axis=0) if (y == c).any() else np.ones(code.shape[1]) for c in range(len(languages))]) + 1e-3
    return Model(languages, code, w, trust / trust.sum(axis=1, keepdims=True))


def trained(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_train: int = MAX_TRAIN) -> Model | None:
    """A model of the rows with a language, an id and a letter in the text; None if there are none."""
    order = F.xxhash64(F.lit("train"), F.col(doc_id))
    rows = rows.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("t"), order.alias("o"))
    found = {r[0]: r[1:] for r in rows.groupBy("l").agg(F.count(F.lit(1)), F.min("o")).limit(MAX_LANGUAGES + 1).collect()}
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang}")
    if not found:
        return None
    languages = sorted(found)
    each = max(LEAST_EACH, max_train // len(languages))
    of_lang = lambda values, kind: F.element_at(F.map_from_arrays(F.lit(languages), F.lit(values).cast(f"array<{kind}>")), F.col("l"))
    chance = (F.col("o").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < of_lang([min(1.0, each / found[name][0]) for name in languages], "double")
    sure = F.col("o") == of_lang([found[name][1] for name in languages], "bigint")  # so that no language is left out
    picked = rows.where(chance | sure).withColumn("s", sure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, value, o, sure_one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = counts(value or "")
                if c is not None:
                    at = np.flatnonzero(c)
                    out.append((name, o, sure_one, at.astype("<u2").tobytes(), np.minimum(c[at], 65535).astype("<u2").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["l", "o", "s", "i", "c"])

    # twice what is expected: only rows that repeat an id can be more
    sample = picked.mapInArrow(run, "l string, o long, s boolean, i binary, c binary").orderBy(F.desc("s"), "o", "l").limit(2 * each * len(languages) + len(languages)).collect()
    if not sample:
        return None
    x = np.zeros((len(sample), FEATURES), np.float32)
    for n, row in enumerate(sample):
        x[n, np.frombuffer(row["i"], "<u2")] = np.frombuffer(row["c"], "<u2")
    names = sorted({row["l"] for row in sample})
    return fitted(scaled(x), np.array([names.index(row["l"]) for row in sample]), names)


def identified(docs: DataFrame, model: Model | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score and ambiguous of every document."""
    slim = docs.select(*carry, F.col(text).alias("_text"))
    n = len(carry)
    schema = T.StructType([*slim.schema.fields[:n], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(n).to_pylist()]
                each = [counts(t) if model else None for t in texts]
                known = [i for i, c in enumerate(each) if c is not None]
                names, score, unsure = [UNDETERMINED] * len(each), np.zeros(len(each)), np.zeros(len(each), bool)
                if known:
                    best, p, close = model.predict(scaled(np.stack([each[i] for i in known])))
                    score[known], unsure[known] = p, close
                    for i, b in zip(known, best, strict=True):
                        names[i] = model.languages[b]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(names), pa.array(score), pa.array(unsure)], names=schema.names)

    return slim.mapInArrow(run, schema)


def training_rows(docs: DataFrame, fold: Column) -> DataFrame:
    """The rows outside the held-out fold 0; a null fold is held out."""
    return docs.where(fold != 0)
