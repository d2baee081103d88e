"""Settings: layers of nested dictionaries."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.sources.files import HIDDEN

#: The defaults of every setting.
DEFAULTS: dict[str, Any] = {
    "embedding": {"provider": "auto"},
    "hybrid": {"enabled": True, "vectorWeight": 0.7, "textWeight": 0.3, "candidateMultiplier": 2.0},
    "query": {"maxResults": 10, "minScore": 0.3},
    "chunking": {"tokens": 256, "overlap": 32},
    "cache": {"enabled": True, "maxEntries": 10000},
    "watch": {"enabled": True, "debounceMs": 1000},
    "sync": {"enabled": False, "include": ["MEMORY.md", "memory/**/*.md"], "exclude": []},
}


def merged(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones, section by section; lists are replaced whole."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            if isinstance(value, dict) and isinstance(out.get(key), dict):
                out[key] = merged(out[key], value)
            elif value is not None:
                out[key] = copy.deepcopy(value)
    return out


def layer(text: str | None) -> dict[str, Any]:
    """The settings of a JSON text; none for a missing or damaged one, or one that is no object."""
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def global_layers(home: Path, xdg: str | None, hidden: Path) -> list[dict[str, Any]]:
    """The settings below a folder's own, weakest first: of the user's configuration folder, then of the hidden folder at home, unless that is the folder's own."""
    places = [Path(xdg or home / ".config", "quarry", "config.json")]
    if (home / HIDDEN).resolve() != hidden.resolve():
        places.append(home / HIDDEN / "config.json")
    return [layer(p.read_text()) if p.is_file() else {} for p in places]


def merged_json(*layers: Column) -> Column:
    """Columns of JSON settings merged over the defaults, later ones over earlier ones, as JSON. A null or damaged layer says nothing."""
    @F.pandas_udf("string")
    def merge(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: json.dumps(merged(DEFAULTS, *map(layer, row))))

    return merge(F.array(*layers))


def parsed_value(text: str) -> Any:
    """JSON if it is, else the text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def with_value(config: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy with the value at a dotted path; what stands in the way and is no section gives way."""
    out = copy.deepcopy(config)
    *sections, last = path.split(".")
    at = out
    for name in sections:
        if not isinstance(at.get(name), dict):
            at[name] = {}
        at = at[name]
    at[last] = value
    return out


def without_value(config: dict[str, Any], path: str) -> dict[str, Any]:
    """A copy without the value at a dotted path; unchanged if there is none."""
    out = copy.deepcopy(config)
    *sections, last = path.split(".")
    at = out
    for name in sections:
        if not isinstance(at.get(name), dict):
            return out
        at = at[name]
    at.pop(last, None)
    return out


def from_assignment(text: str) -> tuple[str, Any]:
    """The path and value of `path=value`; the value may hold equal signs."""
    path, sign, value = text.partition("=")
    if not sign or not path:
        raise ValueError(f"not path=value: {text}")
    return path, parsed_value(value)


def resolved_directories(directories: list[str], use_global: bool, home: str, environment: str | None = None, current: str = ".", hidden: str = ".quarry") -> list[str]:
    """What to search: the folders named (else the environment's), the global one if asked for, else the current folder; each once."""
    found = list(directories) or ([environment] if environment else [])
    if use_global:
        found.append(f"{home}/{hidden}")
    return list(dict.fromkeys(found)) or [current]
