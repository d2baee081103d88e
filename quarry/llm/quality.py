"""Quality rules with verdicts on whole hosts, in DataFrame functions only.

A document fails the base rules if it has too few words or if too much of it
lies in repeated word windows. Failures are then counted by host; the rate of
each host is shrunk by a beta prior that is fitted to all hosts by the method
of moments, and a host whose shrunken rate is at or above a limit loses all
its documents.

Defined cases: a null text has no words and so fails; a null host is a host of
its own; repeated rows count as often as they occur; an empty table gives an
empty result; further columns are left alone, but for carried ones that are named
like a measure (MEASURES, host_rate, kept), which give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, let, written

#: The symbols counted by n_symbols.
SYMBOLS = r"[#*$%&|<>]"


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the host verdict."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_host_rate: float = 0.5
    #: Host lists up to this many names may be broadcast; longer ones are joined by shuffle.
    broadcast_hosts: int = 10_000


def _repeated_words(hashes: Column, window: int) -> Column:
    """How many words lie in windows found twice or more; hashes: one for each word."""
    def window_prints(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n_of(h) - window),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]),
        )

    def n_of(h: Column) -> Column:
        return F.size(h)

    def covered(prints: Column) -> Column:
        pairs = F.sort_array(F.transform(prints, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            twice = F.filter(
                F.transform(p, lambda x, i: F.struct(x["i"].alias("i"), ((F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])).alias("twice"))),
                lambda x: F.coalesce(x["twice"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        # windows in order; each adds the words that the one before does not cover
        return let(
            pairs,
            lambda p: let(
                positions(p),
                lambda s: F.aggregate(
                    F.transform(s, lambda x, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(s, i - 1)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            ),
        )

    return let(
        hashes,
        lambda h: F.when(F.size(h) <= window, F.lit(0)).otherwise(
            let(window_prints(h), lambda p: F.when(F.size(F.array_distinct(p)) == F.size(p), F.lit(0)).otherwise(covered(p)))
        ),
    )


def base_columns(text: Column, rules: Rules = Rules()) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "_repeats": let(
            F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), lambda w: F.xxhash64(w)),
            lambda h: F.struct(F.size(h).cast("long").alias("n"), _repeated_words(h, rules.window).cast("long").alias("r")),
        ),
    }


def measured(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    columns = base_columns(F.col(text), rules)
    out = docs.withColumns(columns)
    out = out.withColumns({"n_words": F.col("_repeats.n"), "n_repeat_words": F.col("_repeats.r")}).drop("_repeats")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(measured_docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per host: n, failures, the shrunken rate and whether the host is kept.

    The prior Beta(a, b) has the mean and variance of the hosts' own rates. With
    one host, or if all rates agree, it is the uniform prior's strength at the
    mean rate.
    """
    hosts = measured_docs.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = (0.5, 0.0) if m is None else (m, v)
    strength = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 2.0
    a, b = m * strength, (1 - m) * strength
    shrunken = (F.col("failures") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.select("host", "n", "failures", shrunken.alias("host_rate"), (shrunken < rules.max_host_rate).alias("host_kept"))


def with_quality(docs: DataFrame, host: str = "source", rules: Rules = Rules(), text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The measures of every document with host_rate and kept; of `docs` the columns in `carry`, by default all but the text.

    The measures are written once, since the hosts' counts and the join back both need them.
    """
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    carry = [c for c in carry if c not in (*MEASURES, "host_rate", "kept")]
    slim = docs.select(F.struct(*[docs[c] for c in carry]).alias("_row") if carry else F.lit(0).alias("_row"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    table = written(measured(slim, rules, "_text").drop("_text"), "quality")
    verdicts = host_verdicts(table, "_host", rules).select(F.col("host").alias("_of"), "host_rate", "host_kept")
    joined = table.join(verdicts, F.col("_host").eqNullSafe(F.col("_of")), "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in carry], *MEASURES, "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def kept_documents(docs: DataFrame, host: str = "source", rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents that pass base rules and host verdict, with their own columns.

    Texts are measured once: those that pass the base rules are written with
    their host, the others without their columns, for the hosts' counts. No text
    is shuffled: only the names of rejected hosts are, by broadcast if they are
    few, else by a join on the host.
    """
    row = F.struct(*docs.columns)
    found = measured(docs.select(row.alias("_row"), F.col(host).alias("_host"), F.col(text).alias("_text")), rules, "_text")
    found = written(found.select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), "_host", "base_failed"), "measured")
    rejected = written(host_verdicts(found, "_host", rules).where(~F.col("host_kept")).select(F.col("host").alias("_rejected")), "hosts")
    if rejected.count() <= rules.broadcast_hosts:
        rejected = F.broadcast(rejected)
    kept = found.where(~F.col("base_failed")).join(rejected, F.col("_host").eqNullSafe(F.col("_rejected")), "left_anti")
    return kept.select("_row.*")
