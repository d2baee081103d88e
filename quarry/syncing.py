"""Push, pull and both at once between a memory folder and its place in a central one, with what is noted of them.

The folders are local ones; plans and states come from `operators.sync`, and
files are copied one by one, each in one step. A file that can't be copied is an
error of its own: the others go on.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import config as settings
from quarry import folders
from quarry.operators import sync
from quarry.sources.files import HIDDEN, read_json, syncable_files

STATE, LOG = "sync-state.json", "sync.log"
OPERATIONS = ("push", "pull", "sync")


class NotMapped(ValueError):
    """A folder without a central one."""


def central_place(spark: SparkSession, folder: str, central: str | None = None) -> tuple[str, str]:
    """The central folder and the path in it: as given, else as the folder's settings say (sync.central, sync.path)."""
    own = read_json(spark, str(Path(folder, HIDDEN, "config.json")), {}).get("sync") or {}
    root = central or own.get("central")
    if not root:
        raise NotMapped(f"{folder} has no central folder: set sync.central")
    return str(Path(root).expanduser()), "" if central else (own.get("path") or "").strip("/")


def _copied(source: Path, target: Path) -> None:
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(target.name + ".tmp")
    draft.write_bytes(source.read_bytes())
    draft.replace(target)


def run(spark: SparkSession, folder: str, operation: str, central: str | None = None, force: bool = False, dry_run: bool = False, machine: str | None = None, now: dt.datetime | None = None) -> dict[str, Any]:
    """pushed, pulled, skipped and errors of one run; files, what it did or would do to each.

    A file that a forced pull overwrites is put aside first, in both versions.
    After the run the state of both sides is written, the mapping's time of the
    last sync is set, and the log has one line more; a dry run does none of it.
    """
    if operation not in OPERATIONS:
        raise ValueError(operation)
    root, inside = central_place(spark, folder, central)
    there = str(Path(root, inside))
    if not Path(there).is_dir() and operation != "pull" and not dry_run:
        Path(there).mkdir(parents=True)
    own = settings.merged(settings.DEFAULTS, read_json(spark, str(Path(folder, HIDDEN, "config.json")), {}))["sync"]
    sides = lambda: [syncable_files(spark, d, own["include"], own["exclude"]) for d in (folder, there)]
    changed = sync.changes(*sides())
    plan = {"push": sync.push_plan, "sync": sync.bidirectional_plan}.get(operation, lambda c: sync.pull_plan(c, force))(changed)
    files = [r.asDict() for r in plan.where(F.col("action") != "none").orderBy("file").collect()]
    out: dict[str, Any] = {"pushed": 0, "pulled": 0, "skipped": [r["file"] for r in files if r["action"] == "skip"], "errors": [], "files": files}
    if dry_run:
        return out
    for r in files:
        here, far = Path(folder, r["file"]), Path(there, r["file"])
        try:
            if r["action"] == "push":
                _copied(here, far)
                out["pushed"] += 1
            elif r["action"] == "pull":
                if here.exists():
                    folders.quarantine(folder, r["file"], here.read_bytes(), far.read_bytes(), now)
                _copied(far, here)
                out["pulled"] += 1
        except OSError as e:
            out["errors"].append(f"{r['file']}: {e}")
    when = (now or dt.datetime.now(dt.UTC)).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    noted(spark, folder, there, sides(), when)
    name = machine or os.uname().nodename
    mine = lambda m: (m.get("path") or "").strip("/") == inside and m.get("machineId") == name
    if any(map(mine, folders.read_registry(root)["mappings"])):
        folders.change_registry(root, lambda r: r | {"mappings": [m | {"lastSync": when} if mine(m) else m for m in r["mappings"]]})
    entry = {"timestamp": when, "operation": operation, "result": "error" if out["errors"] else "ok", "pushed": out["pushed"], "pulled": out["pulled"], "errors": out["errors"]}
    log = Path(folder, HIDDEN, LOG)
    lines = (log.read_text().splitlines() if log.exists() else []) + [json.dumps(entry)]
    folders.replace_file(log, "\n".join(lines[-sync.LOG_ENTRIES :]) + "\n")
    return out


def noted(spark: SparkSession, folder: str, there: str, sides: list, when: str) -> None:
    """Write the state of both sides' files."""
    rows = sync.built_state(*(s.withColumn("mtime", F.col("mtime").cast("string")) if "mtime" in s.columns else s.withColumn("mtime", F.lit(None).cast("string")) for s in sides), when).collect()
    state = {"version": 2, "lastSync": when, "centralPath": there, "files": {r["file"]: {"localHash": r["local_hash"], "remoteHash": r["remote_hash"], "lastModified": r["last_modified"]} for r in sorted(rows)}}
    folders.replace_file(Path(folder, HIDDEN, STATE), json.dumps(state, indent=1))
