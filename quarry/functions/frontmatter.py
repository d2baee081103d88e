"""Front matter: a small two-level YAML head of a document, parsed, merged and written with column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.columns import let

FENCED = r"(?s)\A---\n(.*?)\n---\n"
SESSION_KEYS = ("id", "source", "project", "transcript")
_TOP = r"\A(\w+):\s*(.*)\z"
_NESTED = r"\A\s+(\w+):\s*(.*)\z"
#: What a script engine's number conversion takes for a number.
NUMBER = r"\A(?:[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|Infinity)|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)\z"
_ENTRIES = "array<struct<k:string,v:string>>"


def has_frontmatter(text: Column) -> Column:
    return F.coalesce(text.rlike(FENCED), F.lit(False))


def body(text: Column) -> Column:
    """The text after the head; the whole text if there is none."""
    return F.when(has_frontmatter(text), F.regexp_replace(text, FENCED, "")).otherwise(text)


def unquoted(value: Column) -> Column:
    quoted = (F.length(value) > 1) & ((value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'")))
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def value_kind(value: Column) -> Column:
    """string, boolean, number or array, in the order in which a value is tried."""
    quoted = (F.length(value) > 1) & ((value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'")))
    return F.when(quoted, "string").when(value.isin("true", "false"), "boolean").when(value.rlike(NUMBER), "number").when(value.startswith("[") & value.endswith("]"), "array").otherwise("string")


def array_items(value: Column) -> Column:
    """The items of an inline array as texts; null for other values."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(value_kind(value) == "array", F.transform(F.split(inner, ",", -1), lambda s: unquoted(F.trim(s))))


def fields(text: Column) -> Column:
    """A map of the head's keys to raw values, nested ones as outer.inner, an object's own key to null; null without a head."""
    head = F.regexp_extract(text, FENCED, 1)
    start = F.struct(F.lit(None).cast("string").alias("key"), F.expr(f"cast(array() as {_ENTRIES})").alias("e"))

    def put(entries: Column, key: Column, value: Column) -> Column:
        rest = F.filter(entries, lambda x: (x["k"] != key) & ~x["k"].startswith(F.concat(key, F.lit("."))))
        return F.concat(rest, F.array(F.struct(key.alias("k"), value.alias("v"))))

    def step(a: Column, line: Column) -> Column:
        top, key, value = line.rlike(_TOP), F.regexp_extract(line, _TOP, 1), F.trim(F.regexp_extract(line, _TOP, 2))
        nested = line.rlike(_NESTED) & line.rlike(r"\A\s\s") & a["key"].isNotNull()
        inner = F.concat(a["key"], F.lit("."), F.regexp_extract(line, _NESTED, 1))
        null = F.lit(None).cast("string")
        return (
            F.when(F.trim(line) == "", a)
            .when(top & (value != ""), F.struct(null.alias("key"), put(a["e"], key, value).alias("e")))
            .when(top, F.struct(key.alias("key"), put(a["e"], key, null).alias("e")))
            .when(nested, F.struct(a["key"].alias("key"), put(a["e"], inner, F.trim(F.regexp_extract(line, _NESTED, 2))).alias("e")))
            .otherwise(a)
        )

    return F.when(has_frontmatter(text), F.aggregate(F.split(head, "\n", -1), start, step, lambda a: F.map_from_entries(a["e"])))


def parsed(text: Column) -> Column:
    """struct<session, created, updated, tags, has_session> of a text's head; null without one."""

    def of(m: Column) -> Column:
        get = lambda key: unquoted(F.element_at(m, key))
        session = F.struct(*[get(f"session.{k}").alias(k) for k in SESSION_KEYS])
        return F.struct(session.alias("session"), get("created").alias("created"), get("updated").alias("updated"), array_items(F.element_at(m, "tags")).alias("tags"), F.map_contains_key(m, "session").alias("has_session"))

    return F.when(has_frontmatter(text), let(fields(text), of))


def home_shortened(path: Column, home: str) -> Column:
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def serialised(session: Column, created: Column, updated: Column, tags: Column, home: str = "/root", with_session: bool = True) -> Column:
    """The head as text: session, created, updated, tags; empty values are left out."""
    filled = lambda c: F.length(c) > 0
    lines: list[Column] = [F.lit("---")]
    if with_session:
        lines.append(F.lit("session:"))
        for key in SESSION_KEYS:
            value = session[key]
            shown = home_shortened(value, home) if key in ("project", "transcript") else value
            lines.append(F.when(filled(value), F.concat(F.lit(f"  {key}: "), shown)))
    lines.append(F.when(filled(created), F.concat(F.lit("created: "), created)))
    lines.append(F.when(filled(updated), F.concat(F.lit("updated: "), updated)))
    lines.append(F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]"))))
    lines.append(F.lit("---"))
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))


def merged(text: Column, session: Column, tags: Column, now: Column, home: str = "/root") -> Column:
    """`text` with new values over its old head: session keys one by one, tags as a whole, `created` kept, `updated` now."""

    def of(old: Column) -> Column:
        both = F.struct(*[F.coalesce(session[k], old["session"][k]).alias(k) for k in SESSION_KEYS])
        created = F.when(F.length(old["created"]) > 0, old["created"]).otherwise(now)
        return serialised(both, created, now, F.coalesce(tags, old["tags"]), home)

    return F.concat(let(parsed(text), of), body(text))
