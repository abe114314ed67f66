"""Command line: ``python -m loomtable.plans.cli run pipeline.toml -i tables.jsonl -o out``."""

from __future__ import annotations

import argparse
import sys

from loomtable.plans import config
from loomtable.plans.tableset import STEPS, TableSet, run


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomtable")
    parser.add_argument("-v", action="store_true", help="show Spark's messages")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", *sorted(STEPS - {"link", "integrate", "dump"})):
        p = sub.add_parser(name)
        if name == "run":
            p.add_argument("pipeline")
        else:
            p.add_argument("-X", "--argument", action="append", default=[], help="key=value, the value in JSON")
        p.add_argument("-i", "--input", nargs="+", required=True)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-C", "--config", help="a file with assets")
        p.add_argument("-w", "--workdir")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.v else "ERROR")
    start = TableSet.load(spark, *args.input)
    assets = config.assets_of(config.load(args.config)) if args.config else {}
    if args.command == "run":
        steps = args.pipeline
    else:
        import json

        steps = {"step": [{"step": args.command} | {k: json.loads(v) for k, v in (a.split("=", 1) for a in args.argument)}]}
    for path, ts in run(start, steps, args.workdir, assets=assets).items():
        ts.dump(args.output if path == "r" else f"{args.output}-{path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
