"""A local memory folder as a stream of file changes."""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

Listing = dict[str, list[int]]


def listed(folder: str) -> Listing:
    """Time (ns) and size of MEMORY.md and memory/**/*.md, by relative path; no file is opened."""
    out: Listing = {}
    open_ = [Path(folder, "memory")]
    for name in ("MEMORY.md", "memory.md"):
        if (found := Path(folder, name)).is_file():
            out[name] = [found.stat().st_mtime_ns, found.stat().st_size]
    while open_:
        try:
            entries = list(os.scandir(open_.pop()))
        except OSError:
            continue  # not there, or gone meanwhile
        for e in entries:
            if e.name.startswith((".", "_")):
                continue
            try:
                if e.is_dir(follow_symlinks=False):
                    open_.append(Path(e.path))
                elif e.name.endswith(".md") and e.is_file():
                    out[os.path.relpath(e.path, folder)] = [e.stat().st_mtime_ns, e.stat().st_size]
            except OSError:
                continue
    return out


def settled(now: Listing, before: Listing, at_ns: int, settle_ns: int) -> Listing:
    """The listing with files that were written just now as they were before."""
    fresh = {p for p, (mtime, _) in now.items() if at_ns - settle_ns < mtime <= at_ns}
    return {p: v for p, v in now.items() if p not in fresh} | {p: before[p] for p in fresh if p in before}


def differences(before: Listing, now: Listing) -> list[tuple[str, str]]:
    """(file, event) from one listing to the next, in order of their paths."""
    kind = lambda p: "unlink" if p not in now else "add" if p not in before else "change"
    return [(p, kind(p)) for p in sorted(before.keys() | now.keys()) if before.get(p) != now.get(p)]


class FolderChanges(DataSource):
    """`folder_changes` with options folder, state (a folder for what listings saw) and settle (seconds).

    An offset is the number of a listing, which is written before it is handed
    out, so a batch that runs again has the same rows. The first listing is where
    a new query begins: files that are there then are no changes.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "directory string, file string, event string, ts timestamp, event_id long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["folder"], self.options["state"], float(self.options.get("settle", "0.2")))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, state: str, settle: float):
        self.folder, self.state, self.settle_ns = folder, Path(state), round(settle * 1e9)

    def _file(self, number: int) -> Path:
        return self.state / f"listing-{number}.json"

    def _load(self, number: int) -> tuple[Listing, int]:
        found = json.loads(self._file(number).read_text())
        return found["files"], found["at"]

    def _store(self, number: int, files: Listing, at: int) -> None:
        self.state.mkdir(parents=True, exist_ok=True)
        draft = self._file(number).with_suffix(".tmp")
        draft.write_text(json.dumps({"files": files, "at": at}))
        draft.replace(self._file(number))

    def initialOffset(self) -> dict:
        if not self._file(0).exists():
            self._store(0, listed(self.folder), time.time_ns())
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n, at = start["n"], time.time_ns()
        before, _ = self._load(n)
        # a listing that a stopped query wrote and did not use is made anew
        files = settled(listed(self.folder), before, at, self.settle_ns)
        if files == before:
            return iter(()), start
        self._store(n + 1, files, at)
        return self.readBetweenOffsets(start, {"n": n + 1}), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = []
        for n in range(start["n"], end["n"]):
            (before, _), (now, at) = self._load(n), self._load(n + 1)
            when = dt.datetime.fromtimestamp(at / 1e9, dt.UTC)
            rows += [(self.folder, file, event, when, n) for file, event in differences(before, now)]
        return iter(rows)

    def commit(self, end: dict) -> None:
        for n in range(end["n"] - 1, 0, -1):
            if not self._file(n).exists():
                break
            self._file(n).unlink()
