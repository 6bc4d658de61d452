"""Commands over a store folder: `python -m treegauge --store DIR COMMAND …`.

Exit codes: 0 done, 2 refused, 3 a limit set by the caller was exceeded.
"""

from __future__ import annotations

import argparse
import json
import sys

from . import Refused
from .plans.workspace import Workspace
from .session import build_session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="treegauge")
    parser.add_argument("--store", required=True)
    parser.add_argument("--master")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("add").add_argument("path")
    for name in ("update", "embed", "snapshot", "retire", "restore", "stale"):
        commands.add_parser(name).add_argument("project")
    commands.add_parser("status").add_argument("project", nargs="?")
    commands.add_parser("free")
    scan = commands.add_parser("scan")
    scan.add_argument("root")
    scan.add_argument("--deny", action="append", default=[])
    cold = commands.add_parser("backfill")
    cold.add_argument("--max-files", type=int)
    cold.add_argument("--dry-run", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--project")
    for kind in ("--names", "--semantic", "--fused"):
        search.add_argument(kind, action="store_true")
    watch = commands.add_parser("watch")
    watch.add_argument("project")
    watch.add_argument("--off", action="store_true")
    view = commands.add_parser("view")
    view.add_argument("project")
    view.add_argument("--out", required=True)
    return parser


def run(ws: Workspace, args: argparse.Namespace):
    if args.command == "add":
        return ws.add(args.path)
    if args.command == "scan":
        return ws.scan(args.root, args.deny)
    if args.command == "backfill":
        return ws.backfill(args.max_files, args.dry_run)
    if args.command == "search":
        return [r.asDict() for r in ws.search(
            args.query, args.project, args.names, args.semantic, args.fused).collect()]
    if args.command == "free":
        return ws.free()
    if args.command == "status" and args.project is None:
        return [r.asDict() for r in ws.overview().toLocalIterator()]
    if args.command == "stale":
        return [r["line"] for r in ws.stale(args.project).toLocalIterator()]
    if args.command == "update":
        report = ws.update(args.project)
        return {k: report[k] for k in ("content", "links")}
    if args.command == "watch":
        return ws.watch(args.project, not args.off)
    if args.command == "view":
        return [r.asDict() for r in ws.view(args.project, args.out).collect()]
    return getattr(ws, args.command)(args.project)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    ws = Workspace(build_session(args.master), args.store)
    try:
        print(json.dumps(ws.attempt(args.command, run, ws, args), indent=1, default=str))
    except Refused as refusal:
        print("REFUSED  %s" % refusal, file=sys.stderr)
        return 3 if args.command == "backfill" and "cold files" in str(refusal) else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
