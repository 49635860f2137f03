"""``python -m docgraph index | ask | search | get | info``."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from docgraph.engine import Engine
from docgraph.sources.config import Config


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO)
    parser = argparse.ArgumentParser(prog="docgraph")
    parser.add_argument("--env-file", default=".env")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index")
    commands.add_parser("info")
    ask = commands.add_parser("ask")
    ask.add_argument("query")
    ask.add_argument("--max-chunks", type=int, default=50)
    ask.add_argument("--max-tokens", type=int, default=4000)
    ask.add_argument("--style", choices=["detailed", "summary", "raw"], default="detailed")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--file")
    get = commands.add_parser("get")
    get.add_argument("ids", nargs="+")
    get.add_argument("--depth", type=int, default=3)
    given = parser.parse_args(argv)
    engine = Engine(spark or SparkSession.builder.appName("docgraph").getOrCreate(), Config.from_env(env_file=given.env_file))
    try:
        if given.command == "index":
            print(json.dumps(engine.index()))
        elif given.command == "info":
            print(json.dumps(engine.open().store.info()))
        elif given.command == "ask":
            print(engine.open().ask(given.query, given.max_chunks, given.max_tokens, style=given.style))
        elif given.command == "search":
            print(json.dumps(engine.open().search(given.query, file_filter=given.file), default=str))
        else:
            found = engine.open().fetch(given.ids, given.depth)
            print(json.dumps({k: [h.__dict__ for h in v] if isinstance(v, list) else v for k, v in found.items()}, default=str))
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
