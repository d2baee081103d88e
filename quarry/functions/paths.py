"""Paths: normal forms, memory files, globs, registry paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative(path: Column) -> Column:
    """Trimmed, without leading dots and slashes, with forward slashes."""
    return F.replace(F.regexp_replace(F.trim(path), r"\A[./]+", ""), F.lit("\\"), F.lit("/"))


def is_memory_path(path: Column) -> Column:
    p = relative(path)
    return F.when(p == "", F.lit(False)).otherwise(p.isin("MEMORY.md", "memory.md") | p.startswith("memory/"))


def may_be_written(path: Column) -> Column:
    """Whether a path may be written: a root memory file or a Markdown file below memory/, and no `..` in it."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A\./", "")
    return ~path.contains("..") & (p.isin("MEMORY.md", "memory.md") | (p.startswith("memory/") & p.endswith(".md")))


def _closed(glob: str, at: int, open_: str, close: str) -> int:
    """Where what opens at `at` is closed; -1 if nowhere."""
    depth = 0
    while at < len(glob):
        if glob[at] == "\\":
            at += 1
        elif glob[at] == open_:
            depth += 1
        elif glob[at] == close:
            depth -= 1
            if not depth:
                return at
        at += 1
    return -1


def _parted(text: str, by: str) -> list[str]:
    """The parts of a text at a sign that stands in no brackets."""
    parts, depth, at = [""], 0, 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            c = text[at : at + 2]
        elif c in "{(":
            depth += 1
        elif c in "})":
            depth -= 1
        if c == by and not depth:
            parts.append("")
        else:
            parts[-1] += c
        at += len(c)
    return parts


def _expanded(glob: str) -> list[str]:
    """A glob for each choice of its braces: {a,b} and {1..3}."""
    at = glob.find("{")
    while at >= 0:
        end = _closed(glob, at, "{", "}")
        if end < 0:
            break
        inner = glob[at + 1 : end]
        choices = _parted(inner, ",")
        if span := re.fullmatch(r"(-?\d+)\.\.(-?\d+)", inner):
            lo, hi = int(span[1]), int(span[2])
            choices = [str(i) for i in (range(lo, hi + 1) if lo <= hi else range(lo, hi - 1, -1))]
        if len(choices) > 1 or span:
            return [glob[:at] + x for c in choices for x in _expanded(c + glob[end + 1 :])]
        at = glob.find("{", at + 1)
    return [glob]


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """The regular expression of a class that opens at `at`, and where it ends."""
    end = at + 2 if glob[at + 1 : at + 2] in ("!", "^") else at + 1
    first = end
    while end < len(glob) and (glob[end] != "]" or end == first):
        end += 1
    if end >= len(glob):
        return None
    inner = "".join(c if c == "-" else re.escape(c) for c in glob[first:end])
    return (f"[^/{inner}]" if first == at + 2 else f"(?!/)[{inner}]"), end + 1


def _segment(glob: str, start: bool = True) -> str:
    """A regular expression for a glob without slashes. Wildcards at the start take no dot."""
    out, at = "", 0
    if start and (glob[:1] in ("*", "?", "[") or re.match(r"[?*+@!]\(", glob)):
        out = r"(?!\.)"
    while at < len(glob):
        c = glob[at]
        if c in "?*+@!" and glob[at + 1 : at + 2] == "(" and (end := _closed(glob, at + 1, "(", ")")) > 0:
            choice = "|".join(_segment(p, False) for p in _parted(glob[at + 2 : end], "|"))
            if c == "!":
                # none of the choices, with what follows up to the end
                rest = _segment(glob[end + 1 :], False)
                return f"{out}(?!(?:{choice}){rest}(?:/|\\z))[^/]*{rest}"
            out, at = out + f"(?:{choice})" + ("" if c == "@" else c), end + 1
        elif c == "*":
            out, at = out + "[^/]*", at + 1
        elif c == "?":
            out, at = out + "[^/]", at + 1
        elif c == "[" and (found := _class(glob, at)):
            out, at = out + found[0], found[1]
        elif c == "\\" and at + 1 < len(glob):
            out, at = out + re.escape(glob[at + 1]), at + 2
        else:
            out, at = out + re.escape(c), at + 1
    return out


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob.

    `*` and `?` stay inside a folder; `**` as a whole part is any number of
    folders, at the end everything below. [abc], [a-z], [!a] are one character,
    {a,b} and {1..3} choices; ?(a|b), *(a|b), +(a|b), @(a|b) and !(a|b) are
    none or one, any number, one or more, one, and none of the choices. A
    wildcard takes no dot at the start of a name. A backslash takes the next
    character as it is.
    """
    wholes = []
    for one in _expanded(glob):
        parts, out = one.split("/"), ""
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                out += r"(?!\.)[^/]+(?:/(?!\.)[^/]+)*" if last else r"(?:(?!\.)[^/]+/)*"
            else:
                out += (r"(?!\.)[^/]+" if part == "*" else _segment(part)) + ("" if last else "/")
        wholes.append(out)
    return rf"\A(?:{'|'.join(wholes)})\z"


def matches_glob(path: Column, glob: str) -> Column:
    """Whether a path matches a glob; one that begins with `!` is matched by what the rest doesn't match."""
    turned = len(glob) - len(glob.lstrip("!")) if not glob.startswith("!(") else 0
    hit = path.rlike(glob_pattern(glob[turned:]))
    return ~hit if turned % 2 else hit


def matches_globs(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Any of `include` and none of `exclude`."""
    hit = F.lit(False)
    for glob in include:
        hit = hit | matches_glob(path, glob)
    for glob in exclude:
        hit = hit & ~matches_glob(path, glob)
    return hit


def repository_path(path: Column) -> Column:
    """Without trailing slashes but one; `/` for nothing."""
    return F.concat(F.regexp_replace(path, r"/+\z", ""), F.lit("/"))


def expanded(path: Column, home: str) -> Column:
    return F.when(path == "~", F.lit(home)).when(path.startswith("~/"), F.concat(F.lit(home), F.substring(path, F.lit(2), F.length(path)))).otherwise(path)


def shortened(path: Column, home: str) -> Column:
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def directory_name(path: Column, home: str, hidden: str = ".quarry") -> Column:
    """A short name: `global` for the hidden folder at home, parent/name for another hidden one, else the last part."""
    parts = F.split(F.regexp_replace(path, r"/+\z", ""), "/")
    last = F.element_at(parts, -1)
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    return F.when(path == f"{home}/{hidden}", "global").when(last.startswith("."), F.concat(parent, F.lit("/"), last)).otherwise(last)


def quarantine_folder(when: Column) -> Column:
    """An ISO time as a folder name."""
    return F.translate(when, ":.", "--")


def quarantine_time(folder: Column) -> Column:
    """The ISO time of a folder name."""
    return F.regexp_replace(folder, r"-(\d{2})-(\d{2})-(\d{3})Z\z", ":$1:$2.$3Z")


def quarantine_name(file: Column, side: Column) -> Column:
    return F.concat(F.translate(file, "/", "_"), F.lit("."), side)


def quarantined_file(name: Column) -> Column:
    """The file that a quarantined copy is of; underscores of its own name are lost."""
    return F.translate(F.regexp_replace(name, r"\.(?:local|remote|base)\z", ""), "_", "/")


def provider_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def machine_id(host: Column, suffix: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(host), "[^a-z0-9-]", "-"), F.lit("-"), suffix)
