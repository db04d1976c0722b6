"""python -m paperloom list | run QUERY --data FOLDER --out FOLDER (OP11, OP12)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 for success, 1 for an unknown query, 2 for wrong arguments."""
    p = argparse.ArgumentParser(prog="paperloom")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    from paperloom.plans import catalog
    from paperloom.runtime import ship

    if args.verb == "list":
        for name, f in catalog.QUERIES.items():
            print(name, (f.__doc__ or "").strip().split("\n")[0], sep="\t")
        return 0
    if args.query not in catalog.QUERIES:
        print(f"no query {args.query}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    catalog.QUERIES[args.query](spark, args.data).write.format(args.format).mode("overwrite").save(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
