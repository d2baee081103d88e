"""Local folders: what kind they are, central repositories, quarantine, and the watch loop. Driver code on few files."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import random
import shutil
import subprocess
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from quarry.sources.files import HIDDEN

REGISTRY = ".registry.json"
IGNORED = "*.db\n*.db-*\n*.tmp\n"


def git_root(folder: str) -> str | None:
    """The folder, or the one above it, that holds a .git entry."""
    for place in (Path(folder).resolve(), *Path(folder).resolve().parents):
        if (place / ".git").exists():
            return str(place)
    return None


def has_sync(folder: str) -> bool:
    """Whether its settings turn sync on or name a place for it."""
    try:
        own = json.loads(Path(folder, HIDDEN, "config.json").read_text()).get("sync") or {}
    except (OSError, ValueError, AttributeError):
        return False
    return own.get("enabled") is True or isinstance(own.get("path"), str)


def folder_kind(folder: str) -> dict[str, Any]:
    """kind, git_root and has_sync: a folder in a repository is bound to that project unless it syncs by itself."""
    root, sync = git_root(folder), has_sync(folder)
    return {"kind": "project-bound" if root and not sync else "standalone", "git_root": root, "has_sync": sync}


def read_registry(central: str) -> dict[str, Any]:
    """The registry of a central folder; an empty one for a missing or damaged file."""
    try:
        found = json.loads(Path(central, REGISTRY).read_text())
    except (OSError, ValueError):
        found = None
    return found if isinstance(found, dict) and isinstance(found.get("mappings"), list) else {"version": 1, "mappings": []}


def change_registry(central: str, change: Callable[[dict[str, Any]], dict[str, Any]], attempts: int = 50, sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """Write what `change` makes of the registry; it may be called again, with what another machine has written meanwhile.

    Only one writer may follow a given text: it says so by making a file named
    after it. One that has been there for a minute is of a writer that died.
    """
    path = Path(central, REGISTRY)
    for attempt in range(attempts):
        before = path.read_bytes() if path.exists() else b""
        claim = path.with_name(f"{path.name}.{hashlib.sha256(before).hexdigest()[:16]}.next")
        try:
            path.parent.mkdir(parents=True, exist_ok=True)
            os.close(os.open(claim, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            try:
                if time.time() - claim.stat().st_mtime > 60:
                    claim.unlink(missing_ok=True)
            except FileNotFoundError:
                pass
            sleep(0.02 * (1 + random.random()) * min(attempt + 1, 10))
            continue
        try:
            # another writer may have been done between reading and claiming
            if (path.read_bytes() if path.exists() else b"") != before:
                continue
            made = change(read_registry(central))
            replace_file(path, json.dumps(made, indent=1))
            return made
        finally:
            claim.unlink(missing_ok=True)
    raise TimeoutError(f"{path} is always being written")


def replace_file(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f"{path.name}.{os.getpid()}.{random.getrandbits(32):x}.tmp")
    draft.write_text(text)
    draft.replace(path)


def make_central(path: str) -> dict[str, Any]:
    """Make a folder a central repository, or leave one as it is: git, ignore list, registry, read-me."""
    folder = Path(path).expanduser().resolve()
    if shutil.which("git") is None:
        return {"success": False, "path": str(folder), "created": False, "message": "git is not there"}
    created = not folder.is_dir()
    folder.mkdir(parents=True, exist_ok=True)
    if not os.access(folder, os.W_OK):
        return {"success": False, "path": str(folder), "created": created, "message": "the folder can't be written"}
    if git_root(str(folder)) is None:
        subprocess.run(["git", "init", "-q", str(folder)], check=True, timeout=60)
    for name, text in ((".gitignore", IGNORED), ("README.md", "Central memory folder.\n"), (REGISTRY, json.dumps({"version": 1, "mappings": []}))):
        if not (folder / name).exists():
            (folder / name).write_text(text)
    return {"success": True, "path": str(folder), "created": created, "message": "created" if created else "taken over"}


def check_central(path: str) -> dict[str, Any]:
    """valid, warnings and errors of a central repository."""
    folder = Path(path).expanduser().resolve()
    if not folder.is_dir():
        return {"valid": False, "warnings": [], "errors": ["not a directory" if folder.exists() else "not there"]}
    warnings, errors = [], []
    if git_root(str(folder)) is None:
        warnings.append("not a git repository")
    if not (folder / REGISTRY).exists():
        warnings.append("no registry")
    ignored = (folder / ".gitignore").read_text() if (folder / ".gitignore").exists() else None
    if ignored is None or "*.db" not in ignored:
        warnings.append("no ignore list" if ignored is None else "databases are not ignored")
    if not os.access(folder, os.W_OK):
        errors.append("can't be written")
    return {"valid": not errors, "warnings": warnings, "errors": errors}


def quarantine(folder: str, file: str, local: bytes | None, remote: bytes | None, now: dt.datetime | None = None) -> str:
    """Put both versions of a file aside; the folder's name is the time."""
    when = (now or dt.datetime.now(dt.UTC)).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    place = Path(folder, HIDDEN, "conflicts", when.replace(":", "-").replace(".", "-"))
    place.mkdir(parents=True, exist_ok=True)
    for side, content in (("local", local), ("remote", remote)):
        if content is not None:
            (place / f"{file.replace('/', '_')}.{side}").write_bytes(content)
    return str(place)


class Watch:
    """A loop over memory folders with a process file and a log that is turned over.

    Every `poll` seconds `poll_once` is called for each folder, every `validate`
    seconds `validate_once`; a failure is logged and the loop goes on.
    """

    def __init__(self, home: str, folders: Callable[[], list[str]], poll_once: Callable[[str], str | None], validate_once: Callable[[], str | None], poll: float = 30.0, validate: float = 300.0, log_bytes: int = 1 << 20):
        self.home, self.folders, self.poll_once, self.validate_once = Path(home), folders, poll_once, validate_once
        self.poll, self.validate, self.log_bytes = poll, validate, log_bytes
        self.stopped = False

    @property
    def pid_file(self) -> Path:
        return self.home / "watch.pid"

    @property
    def log_file(self) -> Path:
        return self.home / "watch.log"

    def log(self, text: str, level: str = "info") -> None:
        self.home.mkdir(parents=True, exist_ok=True)
        if self.log_file.exists() and self.log_file.stat().st_size > self.log_bytes:
            self.log_file.replace(self.log_file.with_suffix(".log.1"))
        with self.log_file.open("a") as out:
            out.write(f"{dt.datetime.now(dt.UTC).isoformat(timespec='seconds')} [{level}] {text}\n")

    def running(self) -> int | None:
        """The process that runs the loop; a process file of one that is gone is taken away."""
        try:
            pid = int(self.pid_file.read_text())
            os.kill(pid, 0)
            return pid
        except (OSError, ValueError):
            self.pid_file.unlink(missing_ok=True)
            return None

    def last_lines(self, n: int = 50) -> list[str]:
        return self.log_file.read_text().splitlines()[-n:] if self.log_file.exists() else []

    def guarded(self, call: Callable[..., str | None], *args: str) -> None:
        try:
            if said := call(*args):
                self.log(said)
        except Exception as e:
            self.log(f"{' '.join(args)} {e}".strip(), "error")

    def run(self, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        checked, done = None, 0
        with self.process_file():
            while not self.stopped and (rounds is None or done < rounds):
                for folder in self.folders():
                    self.guarded(self.poll_once, folder)
                if checked is None or clock() - checked >= self.validate:
                    checked = clock()
                    self.guarded(self.validate_once)
                done += 1
                if rounds is None or done < rounds:
                    sleep(self.poll)

    @contextmanager
    def process_file(self) -> Iterator[None]:
        """The process file, while this process follows the folders; RuntimeError if another one does."""
        if self.running():
            raise RuntimeError("already running")
        self.home.mkdir(parents=True, exist_ok=True)
        self.pid_file.write_text(str(os.getpid()))
        try:
            yield
        finally:
            self.pid_file.unlink(missing_ok=True)
