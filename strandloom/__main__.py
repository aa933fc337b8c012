"""Command line: process or validate a pipeline, list steps, show the version.

    python -m strandloom process pipeline.toml [--allow-overwrite]
    python -m strandloom validate pipeline.toml
    python -m strandloom list-steps
    python -m strandloom version
"""

from __future__ import annotations

import argparse
import os
import sys

from strandloom.plans import engine
from strandloom.plans.steps import STEPS


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="strandloom")
    commands = parser.add_subparsers(dest="command", required=True)
    process = commands.add_parser("process")
    process.add_argument("config")
    process.add_argument("--allow-overwrite", action="store_true")
    commands.add_parser("validate").add_argument("config")
    commands.add_parser("list-steps")
    commands.add_parser("version")
    given = parser.parse_args(arguments)
    if given.command == "list-steps":
        print("\n".join(STEPS))
        return 0
    if given.command == "version":
        print(engine.VERSION)
        return 0
    with open(given.config, encoding="utf-8") as f:
        text = f.read()
    try:
        if given.command == "validate":
            engine.validate(text)
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("strandloom").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        engine.run(spark, text, os.path.dirname(given.config) or ".", given.allow_overwrite)
    except (ValueError, OSError) as e:
        print(f"strandloom: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
