"""Text functions: hashes, snippets, line ranges, tokens and full-text queries."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_CHARS = 700
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
QUERY_TOKEN = "[A-Za-z0-9_]+"


def _accents() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their base letters, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, BASE = _accents()


def text_hash(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 text."""
    return F.sha2(text, 256)


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(text, 1, chars)


def read_lines(text: Column, first: int = 1, count: int | None = None) -> Column:
    """content, start_line and end_line of `count` lines (all by default) from the 1-based line `first`."""
    first = max(1, first)
    lines = F.split(text, "\n", -1)
    part = F.slice(lines, first, count) if count is not None else F.slice(lines, F.lit(first), F.greatest(F.size(lines) - first + 1, F.lit(0)))
    return F.struct(F.array_join(part, "\n").alias("content"), F.lit(first).alias("start_line"), (F.lit(first - 1) + F.size(part)).alias("end_line"))


def appended(old: Column, new: Column) -> Column:
    """`new` after `old`: on a line of its own, and without a line end that wasn't there. A missing text is `new` alone."""
    gap = F.when((F.length(old) > 0) & ~old.endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    return F.when(old.isNull(), new).otherwise(F.concat(old, gap, new))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case and without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, BASE), F.lit(TOKEN), F.lit(0))


def full_text_query(raw: Column) -> Column:
    """The query expression: each ASCII token quoted, joined by AND; null without a token."""
    found = F.regexp_extract_all(raw, F.lit(QUERY_TOKEN), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND "))


def query_phrases(raw: str) -> list[list[str]]:
    """The phrases a query asks for; tokens joined by underscores are adjacent words. Repeated ones stay."""
    return [[t.lower() for t in word.split("_") if t] for word in re.findall(QUERY_TOKEN, raw)]


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase stand one after another in an array of tokens."""
    if not phrase:
        return F.lit(0)
    first = phrase[0]
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == first))

    def here(w: Column, i: Column) -> Column:
        out = w == first
        for k, word in enumerate(phrase[1:], 1):
            out = out & F.coalesce(F.get(words, i + k) == word, F.lit(False))
        return out

    return F.size(F.filter(words, here))


def session_marker(text: Column, when: Column, session: Column, source: Column | None = None) -> Column:
    """A text with the comment line that names the session it comes from."""
    origin = F.lit("") if source is None else F.when(F.length(source) > 0, F.concat(F.lit(" source="), source)).otherwise(F.lit(""))
    return F.concat(F.lit("<!-- "), when, F.lit(" session="), session, origin, F.lit(" -->\n"), text)
