"""Top-k keyword search over posting blocks, with bounds that leave blocks unread.

The postings of a term are cut into blocks: those of its rows that lie in one
window of row numbers. A block says what its best rows could score at most, so
windows whose bound is below the k-th score so far are not read. The result has the
rows and ranks of `search.bm25`, whatever is left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import query_phrases
from quarry.operators.inverted import FRONT, PART, bucket_of, earlier, listed, posting_parts
from quarry.operators.search import K1, B, CorpusStats

#: Row numbers of a window, as bits.
WINDOW_BITS = 10
#: Windows that are scored first, to learn a k-th score.
FIRST_WINDOWS = 8
#: Bounds are sums in another order than scores; this is far more than what that changes.
_SLACK = 1 + 1e-9
BLOCKS = PART.format(kind="bigint").removeprefix("bucket int, ")


def in_order(rows: DataFrame, number: str = "docno") -> DataFrame:
    """Rows in the order of their numbers, so that a task has whole windows; texts move, once, and not their postings."""
    return rows.repartitionByRange(number).sortWithinPartitions(number)


def posting_blocks(rows: DataFrame, buckets: int = 1) -> DataFrame:
    """bucket and BLOCKS of rows (docno, tokens).

    Each task makes the blocks of its rows. A window whose rows lie in several tasks
    or batches has several blocks of a term, each with its bound; see `in_order`.
    """
    return posting_parts(rows.select("docno", "tokens"), buckets, WINDOW_BITS)


def _weight(f: Column, d: Column, mean_length: float) -> Column:
    f = f.cast("double")
    return f * (K1 + 1) / (f + K1 * (1 - B + B * d / F.lit(mean_length)))


@dataclass
class PrunedIndex:
    """Blocks of one or more segments (with a column `seg`), and what has been taken out of them since.

    `dead` has seg and docno of rows that are gone; `withdrawn` has term and n, the
    number of such rows by term. rows and total_length are sums over the rows that are
    there. `buckets` has the number of a segment's buckets, where blocks lie by bucket.
    """

    blocks: DataFrame
    rows: int
    total_length: int
    dead: DataFrame | None = None
    withdrawn: DataFrame | None = None
    buckets: dict[str, int] = field(default_factory=dict)
    read: dict[str, int] = field(default_factory=dict)

    def _of(self, words: list[str]) -> DataFrame:
        """The blocks of some terms; the folders of other buckets are not opened."""
        mine = self.blocks.where(F.col("term").isin(words))
        if not self.buckets:
            return mine
        at = F.lit(False)
        for n in sorted(set(self.buckets.values())):
            at = at | (F.col("seg").isin([s for s, b in self.buckets.items() if b == n]) & F.col("bucket").isin(sorted({bucket_of(w, n) for w in words})))
        return mine.where(at)

    def _stats(self, phrases: list[list[str]], words: list[str]) -> CorpusStats:
        counted = self.blocks.where(F.col("term").isin(words)).select("term", "n")
        if self.withdrawn is not None:
            counted = counted.unionByName(self.withdrawn.where(F.col("term").isin(words)).select("term", (-F.col("n")).alias("n")))
        n = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        with_phrase = []
        for phrase in phrases:
            if len(phrase) == 1:
                with_phrase.append(n.get(phrase[0], 0))
            else:
                with_phrase.append(self._docs(self.blocks.where(F.col("term").isin(phrase)), [phrase]).count())
        return CorpusStats(self.rows, self.total_length / self.rows if self.rows else 0.0, tuple(with_phrase))

    def _docs(self, blocks: DataFrame, phrases: list[list[str]]) -> DataFrame:
        """seg, docno, d, f0, f1, ...: the rows that are there and have every phrase."""
        words = list(dict.fromkeys(w for p in phrases for w in p))
        # positions are read of words of longer phrases only; of others the count is enough
        longer = [w for w in words if any(w in p for p in phrases if len(p) > 1)]
        each = listed(blocks, "seg", "term", positions=F.col("term").isin(longer) if longer else False).withColumnRenamed("id", "docno")
        at = {w: f"p{i}" for i, w in enumerate(words)}
        of = lambda w, what: F.first(F.when(F.col("term") == w, F.col(what)), ignorenulls=True)
        both = each.groupBy("seg", "docno").agg(F.first("d").alias("d"), *[of(w, "f").alias(f"n{at[w]}") for w in words], *[of(w, "positions").alias(at[w]) for w in longer])
        both = both.where(reduce(lambda a, b: a & b, [F.col(f"n{at[w]}").isNotNull() for w in words]))
        count = lambda p: F.size(reduce(F.array_intersect, [earlier(at[w], k) for k, w in enumerate(p)])) if len(p) > 1 else F.col(f"n{at[p[0]]}")
        found = both.select("seg", "docno", "d", *[count(p).alias(f"f{i}") for i, p in enumerate(phrases)])
        found = found.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(phrases))]))
        return found if self.dead is None else found.join(self.dead, ["seg", "docno"], "left_anti")

    def _windows(self, phrases: list[list[str]], words: list[str], stats: CorpusStats) -> DataFrame:
        """seg, window and bound of the windows that every word has a block in. Headers only: the postings are not read."""
        best = F.array_max(F.transform("front", lambda x: _weight(x["tf"], x["d"], stats.mean_length)))
        at = {w: f"w{i}" for i, w in enumerate(words)}
        heads = self.blocks.select("seg", "window", "term", best.alias("best"))
        each = heads.groupBy("seg", "window").agg(*[F.max(F.when(F.col("term") == w, F.col("best"))).alias(at[w]) for w in words])
        # a phrase comes at most as often as the rarest of its words
        bound = lambda i, p: F.lit(stats.idf(i)) * (F.least(*[F.col(at[w]) for w in dict.fromkeys(p)]) if len(set(p)) > 1 else F.col(at[p[0]]))
        each = each.where(reduce(lambda a, b: a & b, [F.col(at[w]).isNotNull() for w in words]))
        return each.select("seg", "window", (sum((bound(i, p) for i, p in enumerate(phrases)), F.lit(0.0)) * _SLACK).alias("bound"))

    def _ranked(self, blocks: DataFrame, phrases: list[list[str]], stats: CorpusStats) -> DataFrame:
        total = F.lit(0.0)
        for i in range(len(phrases)):
            f = F.col(f"f{i}").cast("double")
            total = total + F.lit(stats.idf(i)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.lit(stats.mean_length)))
        return self._docs(blocks, phrases).select("seg", "docno", (-total).alias("rank"))

    def topk(self, query: str, k: int) -> DataFrame:
        """seg, docno and rank of the best k rows with every phrase of the query, and of all rows that tie with the k-th.

        `read` then says how many windows the query has and how many of them were read.
        """
        phrases = query_phrases(query)
        self.read = {"windows": 0, "read": 0}
        words = list(dict.fromkeys(w for p in phrases for w in p))
        nothing = self.blocks.select("seg", F.lit(0).cast("long").alias("docno"), F.lit(0.0).alias("rank")).where(F.lit(False))
        if not phrases or not all(phrases) or k < 1 or not self.rows:
            return nothing
        mine = PrunedIndex(self._of(words), self.rows, self.total_length, self.dead, self.withdrawn)
        stats = mine._stats(phrases, words)
        if not all(stats.rows_with):
            return nothing
        windows = mine._windows(phrases, words, stats)
        first = [(r["seg"], r["window"]) for r in windows.orderBy(F.desc("bound"), "seg", "window").limit(FIRST_WINDOWS).collect()]
        if not first:
            return nothing
        in_first = reduce(lambda a, b: a | b, [(F.col("seg") == seg) & F.col("window").isin([w for s, w in first if s == seg]) for seg in dict.fromkeys(s for s, _ in first)])
        best = mine._ranked(mine.blocks.where(in_first), phrases, stats)
        seen = [r["rank"] for r in best.orderBy("rank").limit(k).select("rank").collect()]
        least = -seen[-1] if len(seen) == k else 0.0
        open_ = windows.where((F.col("bound") >= least) & ~in_first)
        counts = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(((F.col("bound") >= least) & ~in_first).cast("long")), F.lit(0))).first()
        self.read = {"windows": counts[0], "read": len(first) + counts[1]}
        if counts[1]:
            rest = mine.blocks.join(open_.select("seg", "window"), ["seg", "window"], "left_semi")
            best = mine._ranked(rest.unionByName(mine.blocks.where(in_first)), phrases, stats)
            seen = [r["rank"] for r in best.orderBy("rank").limit(k).select("rank").collect()]
        return best.where(F.col("rank") <= seen[-1]) if len(seen) == k else best
