"""Command line: ``python -m lacuna redact [FILE] [--text TEXT] [--dry-run] [--fast] [--disable A,B] [--model DIR]``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lacuna.operators.entities import guard_model
from lacuna.plans.pipeline import Config, Pipeline
from lacuna.sources.readers import resolve
from lacuna.sources.writers import print_redacted


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lacuna")
    sub = parser.add_subparsers(dest="command", required=True)
    redact = sub.add_parser("redact", help="redact a text, a file, or standard input")
    redact.add_argument("file", nargs="?")
    redact.add_argument("--text")
    redact.add_argument("--dry-run", action="store_true", help="print the spans found and leave the text as it is")
    redact.add_argument("--fast", action="store_true", help="patterns and secrets only")
    redact.add_argument("--disable", default="", help="types to leave alone, separated by commas")
    redact.add_argument("--model", help="folder of an entity model; only its type is checked, as the command runs no model (see Pipeline's backend)")
    args = parser.parse_args(argv)
    if not args.fast and args.model:
        guard_model(args.model)
    spark = SparkSession.builder.appName("lacuna").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    config = Config(disabled=tuple(t for t in args.disable.split(",") if t), dry_run=args.dry_run, thorough=not args.fast)
    try:
        out = Pipeline(config).run(resolve(spark, args.text, args.file))
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    if args.dry_run:
        for row in out.select("spans").toLocalIterator():
            for m in row["spans"]:
                print(json.dumps({"type": m["type"], "start": m["start"], "end": m["end"]}))
    else:
        print_redacted(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
