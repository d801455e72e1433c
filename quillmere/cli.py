"""Command line: build, update, search, explain, stats, verify, prepare, repl, serve and mcp. Exit codes 0, 1 (failed), 2 (usage)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quillmere.errors import QuillmereError
from quillmere.server import http_server, tools
from quillmere.session import local_session
from quillmere.sources.snapshot import Snapshot


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmere")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in (("build", ("source", "root")), ("update", ("root", "batch")), ("search", ("root", "query")), ("explain", ("root", "query")), ("stats", ("root",)), ("verify", ("root",)), ("prepare", ("root",)), ("repl", ("root",)), ("serve", ("root",)), ("mcp", ("root",))):
        sub = verbs.add_parser(verb)
        for name in names:
            sub.add_argument(name)
        if verb == "search":
            sub.add_argument("--scan", action="store_true")
            sub.add_argument("--limit", type=int, default=1000)
        if verb == "serve":
            sub.add_argument("--port", type=int, default=8080)
    args = parser.parse_args(argv)
    return _run(spark or local_session(shuffle_partitions=4), args)


def run(spark: SparkSession, argv: list[str]) -> int:
    """The command line on a session that is there."""
    return main(argv, spark)


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        if args.verb == "build":
            print(json.dumps(Snapshot.build(spark, args.source, args.root).stats()))
            return 0
        table = Snapshot.open(spark, args.root)
        match args.verb:
            case "update":
                print(json.dumps(table.update(args.batch).stats()))
            case "search":
                print(table.search(args.query, limit=args.limit, mode="scan" if args.scan else "auto").to_json())
            case "explain":
                print(table.explain(args.query), end="")
            case "stats":
                print(json.dumps(table.stats()))
            case "serve":
                http_server(table, args.port).serve_forever()
            case "mcp":
                tools(table)
            case "verify":
                table.verify()
            case "prepare":
                table.prepare()
            case "repl":
                for line in sys.stdin:
                    try:
                        print(table.search(line.strip()).to_json())
                    except QuillmereError as e:
                        print(f"{e.code}: {e}", file=sys.stderr)
        return 0
    except QuillmereError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
