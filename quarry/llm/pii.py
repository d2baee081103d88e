"""Personal data: base spans by pattern, and terms that give protected values away.

Base spans are emails, IP addresses, card and phone numbers. Each distinct
value found is a protected entity. How strongly a term reveals an entity is
estimated from whole documents, copies of a text counted once: with N texts,
n(c) texts with entity c, n(t) with term t and n(c,t) with both,

    PMI(c;t) = log(N * n(c,t) / (n(c) * n(t))),    IC(c) = log(N / n(c)),

and PMI / IC is the share of what there is to know about c that t discloses: 1
if t occurs only beside c. Two things shrink it. Of the n(t) texts with t, m(t)
also hold some protected value: m / n says how far t goes with protected values
at all, and a word that stands beside them by chance has the same small m / n in
a corpus of any size. And m^2 / (m^2 + shrinkage) says how much there is to go
by; it is the term's over all entities, so that an entity used once can have
disclosing terms. A term in one text only has a weight of a third: such a text
and its copies cannot tell a name from any other rare word.

Terms at or above `generalise_at` are replaced by the class of what they disclose
most (an email, an address, a card or a phone number of someone), those at or
above `remove_at` are taken out, anywhere in texts that hold the entity.

Only DataFrame functions are used. The patterns are written with possessive
groups and look-behinds that find the same matches as the plain patterns
without going over long runs of word characters or digits again and again.
Places are running sums in logarithmic steps, and texts are put together from
pieces, so that time follows a text's length and matches, but for a logarithm.

Defined cases: null text is empty and has no spans; null ids and repeated rows
keep their rows and are treated by their text alone; an entity that every text
holds has nothing to disclose; an empty table gives an empty result; extra
columns are kept by `sanitised`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, written

#: The kinds of base spans, in the order of results, then the added kind.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A string that every match of the kind holds.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A letter of no script's words, which stands for the letters of an email.
_BLOT = "\u01c0"
#: Replacements that are put into one piece of text.
_PIECE = 256
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Disclosure:
    """Thresholds of the corpus statistics."""

    shrinkage: float = 2.0
    generalise_at: float = 0.5
    remove_at: float = 0.8


def _running(values: Column, join: Callable[[Column, Column], Column], nothing: Column) -> Column:
    """For each element of an array `join` of it and all before it, in as many steps over the array as its length has bits."""

    def sums(whole: Column) -> Column:
        n = F.size(whole)
        steps = F.slice(F.lit(list(range(31))), F.lit(1), F.ceil(F.log2(n)).cast("int"))

        def step(a: Column, k: Column) -> Column:
            by = F.call_function("shiftleft", F.lit(1), k)
            return F.zip_with(F.concat(F.array_repeat(nothing, by), F.slice(a, F.lit(1), n - by)), a, join)

        return F.when(n < 2, whole).otherwise(F.aggregate(steps, whole, step))

    return let(values, sums)


def _located(text: Column, pattern: Column | str, kind: str) -> Column:
    """All matches with their code point offsets: the texts between matches and the matches take turns."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def place(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _running(F.zip_with(between, found, lambda b, m: F.length(b) + F.length(m)), lambda a, b: a + b, F.lit(0))
        spans = F.zip_with(found, ends, lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        return F.when(F.size(found) > 0, spans).otherwise(F.expr(f"cast(array() as {_SPAN})"))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), place)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of all kinds, by kind, then start."""
    def valid(kind: str):
        return lambda s: _valid(kind, s["value"])

    parts = []
    for kind in KINDS:
        found = F.filter(_located(text, PATTERNS[kind], kind), valid(kind))
        if kind in _NEEDS:
            found = F.when(text.contains(_NEEDS[kind]), found).otherwise(F.expr(f"cast(array() as {_SPAN})"))
        parts.append(found)
    return F.concat(*parts)


def _entity(kind: Column, value: Column) -> Column:
    """What makes two spans the same protected value."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value)))


def _terms(text: Column) -> Column:
    """The distinct words of three letters or more of a text, those of its emails left out."""
    plain = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}{3,}+"), F.lit(0)))


def found_spans(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A written table of the columns `carry`, _key (the text's MD5), spans and entities of every document, terms of those with entities, without texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    # the generator of one row keeps the spans from being computed for each use
    out = docs.select(*carry, body.alias("_text"), F.md5(body).alias("_key"))
    terms = lambda t, s: F.when(F.size(s) > 0, _terms(t)).otherwise(F.expr("cast(array() as array<string>)"))
    out = out.select(*carry, "_key", let(out["_text"], lambda t: let(base_spans(t), lambda s: F.struct(s.alias("s"), F.array_distinct(F.transform(s, lambda x: _entity(x["kind"], x["value"]))).alias("e"), terms(t, s).alias("t")))).alias("_f"))
    return written(out.select(*carry, "_key", F.col("_f.s").alias("spans"), F.col("_f.e").alias("entities"), F.col("_f.t").alias("terms")), "spans")


def disclosing_terms(docs: DataFrame, found: DataFrame, d: Disclosure = Disclosure(), text: str = "text", broadcast_keys: int = 200_000) -> DataFrame:
    """entity, term, n_texts, share: the terms at or above `generalise_at`.

    Counts are sums that every task makes of its own rows first, so an entity
    or a term in a third of all documents does not gather in one task. Terms
    whose weight alone is too small are left out before entities are paired.
    """
    held = written(found.where(F.size("entities") > 0).groupBy("_key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms")), "held")
    of_entity = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    of_held = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("m_t"))
    # as n(t) >= m(t), the others cannot have the weight
    of_held = written(of_held.where(F.col("m_t") * F.col("m_t") / (F.col("m_t") * F.col("m_t") + F.lit(d.shrinkage)) >= d.generalise_at), "held_terms")
    few = of_held.count() <= broadcast_keys
    # a row of k copies counts 1/k, so that no text is moved; sums are whole numbers but for rounding
    copies = written(found.groupBy("_key").agg(F.count(F.lit(1)).alias("k")), "copies")
    n = copies.count()
    copied = copies.where("k > 1").withColumnRenamed("_key", "_copied")
    copied = F.broadcast(copied) if copied.count() <= broadcast_keys else copied
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(body.alias("_text"), F.md5(body).alias("_key")).join(copied, F.col("_key") == F.col("_copied"), "left")
    terms = texts.select(F.explode(_terms(F.col("_text"))).alias("term"), (F.lit(1.0) / F.coalesce("k", F.lit(1))).alias("part"))
    terms = terms.join(F.broadcast(of_held.select("term")), "term", "left_semi") if few else terms
    of_term = terms.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_t"))
    weight = F.col("m_t") / F.col("n_t") * (F.col("m_t") * F.col("m_t") / (F.col("m_t") * F.col("m_t") + F.lit(d.shrinkage)))
    weighed = of_held.join(of_term, "term").select("term", "n_t", "m_t", weight.alias("weight"))
    most = of_entity.agg(F.max("n_c")).first()[0] or 1

    def reachable(n_c: Column) -> Column:
        """As n(c,t) <= n(c) and n(c,t) <= m(t), other pairs have a smaller share; easiest to reach is n(c) = m(t)."""
        return F.col("weight") * F.log(F.lit(float(n)) * F.least(n_c, F.col("m_t")) / (n_c * F.col("n_t"))) >= (d.generalise_at - 1e-9) * F.log(F.lit(float(n)) / n_c)

    weighed = written(weighed.where((F.col("weight") >= d.generalise_at) & reachable(F.least(F.lit(most), F.col("m_t")))), "weights")
    weighed = F.broadcast(weighed) if weighed.count() <= broadcast_keys else weighed
    values = held.select(F.col("_key").alias("_of"), F.explode("entities").alias("entity")).join(of_entity, "entity")
    pairs = held.select("_key", F.explode("terms").alias("term")).join(weighed, "term")
    pairs = pairs.join(values, (F.col("_key") == F.col("_of")) & reachable(F.col("n_c")))
    pairs = pairs.groupBy("entity", "term", "n_t", "n_c", "weight").agg(F.count(F.lit(1)).alias("n_ct"))
    pmi = F.log(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    content = F.log(F.lit(float(n)) / F.col("n_c"))
    out = pairs.withColumn("share", F.when(content > 0, F.col("weight") * pmi / content)).where(F.col("share") >= d.generalise_at)
    return written(out.select("entity", "term", F.col("n_ct").alias("n_texts"), "share"), "terms")


def _terms_of_texts(found: DataFrame, terms: DataFrame) -> DataFrame:
    """_key, _pattern, _share (term to share and the kind of entity it is of): for each text that holds an entity with disclosing terms."""
    held = found.select("_key", F.explode("entities").alias("entity")).distinct()
    hit = held.join(terms, "entity").groupBy("_key", "term").agg(F.max(F.struct("share", F.substring_index("entity", ":", 1).alias("of"))).alias("share"))
    each = hit.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias("t"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("t", lambda x: x["term"]), "|"), F.lit(r")(?!\p{L})"))
    return each.select("_key", pattern.alias("_pattern"), F.map_from_entries("t").alias("_share"))


def _term_spans(text: Column, pattern: Column) -> Column:
    """The places of terms outside of emails, the only base spans with letters: those count as a letter that no term has."""
    email = F.lit(PATTERNS["email"])

    def blotted(found: Column) -> Column:
        blots = F.concat(F.transform(found, lambda m: F.regexp_replace(m, r"\p{L}", _BLOT)), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(text, email, -1), blots, lambda b, m: F.concat(b, m)), "")

    plain = F.when(text.contains("@"), let(F.regexp_extract_all(text, email, F.lit(0)), blotted)).otherwise(text)
    return let(plain, lambda t: _located(t, pattern, TERM))


def all_spans(docs: DataFrame, d: Disclosure = Disclosure(), text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry`, spans (base ones) and term_spans of every document."""
    found = found_spans(docs, text, carry)
    terms = disclosing_terms(docs, found, d, text)
    body = F.coalesce(F.col(text), F.lit(""))
    # copies of one text have one answer; only texts with disclosing terms are looked at again
    wanted = written(_terms_of_texts(found, terms), "patterns")
    texts = docs.select(F.md5(body).alias("_key"), body.alias("_text")).join(wanted, "_key")
    # the grouping key is not the join's, so that a hot text is split in the join and merged in each task
    texts = texts.groupBy(F.concat("_key", F.lit("")).alias("_of")).agg(F.first(_term_spans(F.col("_text"), F.col("_pattern"))).alias("term_spans"))
    texts = written(texts, "term_spans")
    out = found.join(texts, found["_key"] == texts["_of"], "left")
    return out.select(*carry, "spans", F.coalesce("term_spans", F.expr(f"cast(array() as {_SPAN})")).alias("term_spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column) -> Column:
    """The text with spans (start, minus the end, label), sorted and at least one, replaced by their labels."""

    def regions(upto: Column) -> Column:
        """start, end, label of what overlapping spans cover; `upto` is the furthest end of a span and all before it."""
        before = F.concat(F.array(F.lit(0)), F.slice(upto, F.lit(1), F.size(upto) - 1))
        told = F.filter(F.zip_with(spans, before, lambda s, b: F.struct(s["start"].alias("start"), s["label"].alias("label"), b.alias("before"))), lambda x: x["start"] >= x["before"])
        heads = lambda h: F.zip_with(h, F.concat(F.slice(F.transform(h, lambda x: x["before"]), F.lit(2), F.size(h)), F.array(F.array_max(upto))), lambda x, e: F.struct(x["start"].alias("start"), e.alias("end"), x["label"].alias("label")))
        return let(told, heads)

    def pieces(r: Column) -> Column:
        """Each piece has the replacements of _PIECE regions and the text up to the next ones."""

        def piece(k: Column) -> Column:
            some = F.slice(r, k * _PIECE + 1, F.lit(_PIECE))
            end = F.coalesce(F.get(r, (k + 1) * _PIECE)["start"], F.length(text))

            def joined(x: Column) -> Column:
                own = F.struct(F.get(x, F.lit(0))["start"].alias("at"), F.substring(text, F.get(x, F.lit(0))["start"] + 1, end - F.get(x, F.lit(0))["start"]).alias("text"))

                def one(whole: Column) -> Column:
                    each = lambda s, i: F.concat(s["label"], F.substring(whole["text"], s["end"] - whole["at"] + 1, F.coalesce(F.get(x, i + 1)["start"], end) - s["end"]))
                    return F.array_join(F.transform(x, each), "")

                return let(own, one)

            return let(some, joined)

        made = F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / _PIECE).cast("int")), piece)
        return F.concat(F.substring(text, F.lit(1), F.get(r, F.lit(0))["start"]), F.array_join(made, ""))

    furthest = _running(F.transform(spans, lambda s: -s["minus"]), lambda a, b: F.greatest(a, b), F.lit(0))
    return let(let(furthest, regions), pieces)


def sanitised(docs: DataFrame, d: Disclosure = Disclosure(), text: str = "text") -> DataFrame:
    """`docs` with the text's spans replaced by [KIND], terms by [KIND-TERM] of what they disclose or by nothing; n_chars, if there, follows the text.

    Spans that overlap are replaced together by what stands for the first of
    them, of equal starts for the longest.
    """
    found = found_spans(docs, text)
    terms = disclosing_terms(docs, found, d, text)
    body = F.coalesce(F.col("_row")[text], F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_key", F.md5(body))
    rows = rows.join(written(_terms_of_texts(found, terms), "patterns"), "_key", "left")

    def rebuilt(t: Column, pattern: Column, share: Column) -> Column:
        def label(s: Column) -> Column:
            known = F.element_at(share, F.lower(s["value"]))
            of_term = F.when(known["share"] >= d.remove_at, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(F.coalesce(known["of"], F.lit("some"))), F.lit("-TERM]")))
            return F.when(s["kind"] == TERM, of_term).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

        added = F.when(pattern.isNull(), F.expr(f"cast(array() as {_SPAN})")).otherwise(_term_spans(t, pattern))
        keyed = F.transform(F.concat(base_spans(t), added), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), label(s).alias("label")))
        return let(F.sort_array(keyed), lambda spans: F.when(F.size(spans) == 0, t).otherwise(_replaced(t, spans)))

    clean = let(body, lambda t: rebuilt(t, F.col("_pattern"), F.col("_share")))
    rows = rows.withColumn("_clean", F.when(F.col("_row")[text].isNull(), F.lit(None).cast("string")).otherwise(clean))
    out = []
    for field in docs.schema:
        if field.name == text:
            out.append(F.col("_clean").alias(text))
        elif field.name == "n_chars":
            out.append(F.when(F.col("_clean").isNull(), F.col("_row.n_chars")).otherwise(F.length("_clean")).cast(field.dataType).alias("n_chars"))
        else:
            out.append(F.col("_row")[field.name].alias(field.name))
    return rows.select(*out)
