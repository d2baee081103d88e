"""Command line: python -m quarry COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import signal
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config as settings
from quarry import folders as folders_
from quarry import syncing
from quarry.facade import Memory
from quarry.functions.paths import quarantine_time
from quarry.operators import sync
from quarry.operators.remote import provider_of
from quarry.session import local_session
from quarry.sources.files import HIDDEN, parsed_log, parsed_registry, read_json, syncable_files
from quarry.streaming import live
from quarry.tools import Server, ToolExecutor


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, json_out: bool = False, **more: Any) -> None:
        sub = commands.add_parser(name)
        sub.add_argument("-d", "--dir", action="append", default=[])
        sub.add_argument("-g", "--global", dest="use_global", action="store_true")
        sub.add_argument("-p", "--provider", help="auto, none, deterministic, openai or gemini; else the settings' one, else deterministic")
        if json_out:
            sub.add_argument("--json", action="store_true")
        for names, options in arguments:
            sub.add_argument(*names, **options)

    command("init", (["-f", "--force"], {"action": "store_true"}))
    command("search", (["query"], {}), (["-n", "--max"], {"type": int, "default": 10}), (["-s", "--min-score"], {"type": float, "default": 0.3}), json_out=True)
    command("sync", (["-f", "--force"], {"action": "store_true"}))
    command("status", json_out=True)
    command("append", (["text"], {}), (["-f", "--file"], {}), (["-s", "--session"], {}), (["--session-source"], {}))
    command("upsert", (["file"], {}), (["content"], {"nargs": "?"}), (["--stdin"], {"action": "store_true"}), (["-s", "--session"], {}), (["--session-source"], {}))
    command("serve")
    command("config", (["--set"], {"dest": "assign"}), (["--unset"], {}), json_out=True)
    for name in syncing.OPERATIONS:
        command(name if name != "sync" else "sync:run", (["central"], {"nargs": "?"}), (["-f", "--force"], {"action": "store_true"}), (["--dry-run"], {"action": "store_true"}))
    command("sync:status", (["central"], {}))
    command("sync:validate", (["registry"], {}), (["--days"], {"type": int, "default": 30}), json_out=True)
    command("sync:log", (["-n", "--limit"], {"type": int, "default": 20}), json_out=True)
    command("sync:conflicts", json_out=True)
    command("sync:init-central", (["central"], {}))
    command("sync:init", (["central"], {}), (["--path"], {"required": True}), (["--machine"], {"default": os.uname().nodename}))
    command("sync:list", (["central"], {}), (["--machine"], {}))
    command("sync:remove", (["central"], {}), (["--path"], {"required": True}), (["--machine"], {"default": os.uname().nodename}))
    command("watch", (["--poll"], {"type": float, "default": 30.0}), (["--rounds"], {"type": int}), (["--live"], {"action": "store_true", "help": "follow changes as they come instead of polling"}))
    command("watch:status")
    command("watch:stop")
    command("watch:logs", (["-n", "--lines"], {"type": int, "default": 50}))
    command("sync:cleanup", (["--days"], {"type": int, "default": 30}), (["--dry-run"], {"action": "store_true"}))
    return parser


def _show(rows: list[dict[str, Any]], as_json: bool = True) -> None:
    for row in rows:
        print(json.dumps(row, default=str) if as_json else "  ".join(str(v) for v in row.values()))


def _plain(args: argparse.Namespace, folder: str) -> int:
    """Commands that need no session: the watch process and the registry file."""
    watch = folders_.Watch(str(Path(folder, HIDDEN)), list, str, lambda: None)
    if args.command == "watch:status":
        print(json.dumps({"pid": watch.running()}))
    elif args.command == "watch:stop":
        if pid := watch.running():
            os.kill(pid, signal.SIGTERM)
    elif args.command == "watch:logs":
        print("\n".join(watch.last_lines(args.lines)))
    elif args.command == "sync:init-central":
        made = folders_.make_central(args.central)
        print(json.dumps(made))
        return 0 if made["success"] else 1
    else:
        registry = folders_.read_registry(args.central)
        if args.command == "sync:list":
            _show([m for m in registry["mappings"] if args.machine in (None, m.get("machineId"))])
            return 0
        path = args.path.rstrip("/") + "/"
        home, local = str(Path.home()), str(Path(folder).resolve())
        local = "~" + local[len(home) :] if local.startswith(home) else local

        def changed(registry: dict[str, Any]) -> dict[str, Any]:
            others = [m for m in registry["mappings"] if (m.get("path"), m.get("machineId")) != (path, args.machine)]
            if args.command == "sync:init":
                if taken := next((m for m in others if m.get("path") == path), None):
                    print(f"{path} is mapped by {taken.get('machineId')} already", file=sys.stderr)
                others.append({"path": path, "localPath": local, "machineId": args.machine, "lastSync": dt.datetime.now(dt.UTC).isoformat()})
            return registry | {"mappings": others}

        folders_.change_registry(args.central, changed)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    folders = settings.resolved_directories(args.dir, args.use_global, str(Path.home()), os.environ.get("MEMORY_DIR"))
    folder = folders[0]
    hidden = Path(folder, HIDDEN)
    if args.command == "init":
        hidden.mkdir(parents=True, exist_ok=args.force or not (hidden / "config.json").exists())
        Path(folder, "memory").mkdir(exist_ok=True)
        (hidden / "config.json").write_text("{}")
        return 0
    if args.command.startswith(("watch:", "sync:init", "sync:list", "sync:remove")):
        return _plain(args, folder)
    spark = local_session()
    own = read_json(spark, str(hidden / "config.json"), {})
    whole = settings.merged(*settings.global_layers(Path.home(), os.environ.get("XDG_CONFIG_HOME"), hidden), own)
    if args.command == "config":
        if args.assign:
            own = settings.with_value(own, *settings.from_assignment(args.assign))
        if args.unset:
            own = settings.without_value(own, args.unset)
        if args.assign or args.unset:
            hidden.mkdir(parents=True, exist_ok=True)
            (hidden / "config.json").write_text(json.dumps(own, indent=1))
        print(json.dumps(settings.merged(settings.DEFAULTS, *settings.global_layers(Path.home(), os.environ.get("XDG_CONFIG_HOME"), hidden), own), indent=1))
        return 0

    def memory(path: str) -> Memory:
        embedding = whole.get("embedding") or {}
        provider, instead_of = provider_of(embedding | {"provider": args.provider or embedding.get("provider") or "deterministic"})
        if instead_of:
            print(f"{provider.id} is used instead of {instead_of}", file=sys.stderr)
        if not Path(path, HIDDEN).is_dir():
            print(f"{path} is not initialised: use init", file=sys.stderr)
        return Memory(spark, path, provider, **whole)

    if args.command == "search":
        found = [r | {"directory": d} for d in folders for r in memory(d).search(args.query, args.max, args.min_score)]
        _show(sorted(found, key=lambda r: -r["score"])[: args.max], args.json)
    elif args.command == "sync":
        print(json.dumps(memory(folder).sync(args.force)))
    elif args.command == "status":
        print(json.dumps(memory(folder).status()))
    elif args.command == "append":
        text = args.text
        if args.session:
            now = dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            text = f"<!-- {now} session={args.session}{f' source={args.session_source}' if args.session_source else ''} -->\n{text}"
        m = memory(folder)
        print(m.append_today(text) if not args.file else m.append_file(args.file, text) or args.file)
    elif args.command == "upsert":
        text = sys.stdin.read() if args.stdin else args.content or ""
        memory(folder).write_file(args.file, text, {"id": args.session, "source": args.session_source, "project": os.getcwd()} if args.session else None)
    elif args.command == "watch":

        def followed(d: str) -> str | None:
            m = memory(d)
            return f"{d}: {m.sync()}" if m.is_stale() else None

        def taken(d: str) -> str | None:
            said = followed(d)
            if (read_json(spark, str(Path(d, HIDDEN, "config.json")), {}).get("sync") or {}).get("central"):
                found = syncing.run(spark, d, "sync")
                if found["pushed"] or found["pulled"] or found["errors"]:
                    said = f"{said or d} pushed {found['pushed']}, pulled {found['pulled']} {' '.join(found['errors'])}".strip()
            return said

        def checked() -> str | None:
            roots = {(read_json(spark, str(Path(d, HIDDEN, "config.json")), {}).get("sync") or {}).get("central") for d in folders} - {None}
            found = {root: folders_.check_central(root) for root in sorted(roots)}
            return "; ".join(f"{root}: {', '.join(f['errors'] + f['warnings'])}" for root, f in found.items() if f["errors"] or f["warnings"]) or None

        watch = folders_.Watch(str(hidden), lambda: folders, taken, checked, args.poll)
        if not args.live:
            watch.run(args.rounds)
            return 0

        def update(batch: DataFrame, number: int) -> None:
            # a failure is noted; the next change or poll takes it up again
            for r in batch.select("directory").distinct().collect():
                watch.guarded(taken, r["directory"])

        with watch.process_file():
            gap = settings.merged(settings.DEFAULTS, whole)["watch"]["debounceMs"] / 1000
            query = live.watched(spark, folders, update, str(hidden / "watch"), gap)
            # --rounds: so many seconds of --poll
            query.awaitTermination(args.poll * args.rounds) if args.rounds else query.awaitTermination()
            query.stop()
    elif args.command == "serve":
        Server(ToolExecutor({d: memory(d).search for d in folders})).run()
    elif args.command == "sync:status":
        sides = settings.merged(settings.DEFAULTS, whole)["sync"]
        print(json.dumps(sync.summary(sync.changes(*(syncable_files(spark, d, sides["include"], sides["exclude"]) for d in (folder, args.central)))).first().asDict()))
    elif args.command in ("push", "pull", "sync:run"):
        found = syncing.run(spark, folder, args.command.removeprefix("sync:run") or "sync", args.central, args.force, args.dry_run)
        _show(found["files"])
        for error in found["errors"]:
            print(error, file=sys.stderr)
        return 1 if found["errors"] else 0
    elif args.command == "sync:validate":
        mappings = parsed_registry(spark.createDataFrame([(Path(args.registry).read_text(),)], "content string")).withColumn("last_sync", F.try_to_timestamp("last_sync"))
        _show([r.asDict() for r in sync.validation_issues(mappings, F.current_timestamp(), days=args.days).collect()])
    elif args.command == "sync:log":
        log = hidden / "sync.log"
        if log.exists():
            entries = parsed_log(spark.read.text(str(log)).withColumnRenamed("value", "line"))
            _show([r.asDict(True) for r in sync.tail(entries, ["timestamp"], args.limit).collect()])
    elif args.command in ("sync:conflicts", "sync:cleanup"):
        copies = [(p.parent.name, p.name) for p in (hidden / "conflicts").glob("*/*")]
        table = spark.createDataFrame(copies, "timestamp string, file_name string")
        if args.command == "sync:conflicts":
            _show([r.asDict() for r in sync.quarantined(table).withColumn("time", quarantine_time(F.col("timestamp"))).collect()])
        else:
            for r in sync.expired(table, F.current_timestamp(), args.days).collect():
                print(r["timestamp"])
                if not args.dry_run:
                    for p in (hidden / "conflicts" / r["timestamp"]).iterdir():
                        p.unlink()
                    (hidden / "conflicts" / r["timestamp"]).rmdir()
    return 0


if __name__ == "__main__":
    sys.exit(main())
