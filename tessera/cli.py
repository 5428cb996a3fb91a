"""Command line: init, status, sync, search, fetch, index sync, index status, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession


def _non_negative(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--root", default=".")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("--force", action="store_true")

    def status(p: argparse.ArgumentParser) -> None:
        p.add_argument("--json", action="store_true")

    def sync(p: argparse.ArgumentParser) -> None:
        p.add_argument("--full", action="store_true")

    status(commands.add_parser("status"))
    sync(commands.add_parser("sync"))
    search = commands.add_parser("search")
    search.add_argument("q", nargs="?")
    search.add_argument("--q", dest="q_flag")
    search.add_argument("--top-k", type=_non_negative, default=20)
    fetch = commands.add_parser("fetch")
    fetch.add_argument("--ids", required=True, type=lambda s: [int(x.strip()) for x in s.split(",") if x.strip()])
    fetch.add_argument("--max-lines", type=_non_negative, default=120)
    index = commands.add_parser("index").add_subparsers(dest="index_command", required=True)
    sync(index.add_parser("sync"))
    status(index.add_parser("status"))
    commands.add_parser("serve").add_argument("--stdio", action="store_true")
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    from tessera.engine import Engine
    from tessera.sources.scan import git_top, is_repo
    from tessera.streaming.serve import serve

    root = git_top(args.root) if is_repo(args.root) else os.path.abspath(args.root)
    command = args.index_command if args.command == "index" else args.command
    engine = Engine(spark, root, served=command == "serve")
    try:
        if command == "init":
            engine.init(args.force)
        elif command == "status":
            out = engine.status()
            print(json.dumps(out) if args.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
        elif command == "sync":
            print(json.dumps(engine.sync(args.full)))
        elif command == "search":
            q = args.q_flag or args.q
            if not q or not q.strip():
                print("search needs a query", file=sys.stderr)
                return 2
            print(json.dumps(engine.search(q, args.top_k)))
        elif command == "fetch":
            print(json.dumps(engine.fetch(args.ids, args.max_lines)))
        else:
            serve(engine, sys.stdin.buffer, sys.stdout.buffer)
    finally:
        engine.close()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(args, spark)
    except (FileExistsError, FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
