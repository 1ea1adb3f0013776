"""``python -m tidemark.evaluation --folder DIR``: prints the report of all datasets found there."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.evaluation import build_registry, render_report, run_registry


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark.evaluation")
    parser.add_argument("--folder", required=True)
    parser.add_argument("--include-local", action="store_true", help="also run datasets marked as local")
    parser.add_argument("--rows", type=int, default=1000)
    parser.add_argument("--trials", type=int, default=30)
    parser.add_argument("--seed", type=int, default=0)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark-evaluation").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    report = run_registry(spark, build_registry(args.folder), n=args.rows, trials=args.trials, seed=args.seed, include_local=args.include_local)
    print(render_report(report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
