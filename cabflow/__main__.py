"""Command line: rebuild every layer from raw trip files and write the reports.

    spark-submit -m cabflow refresh --raw s3://…/raw_trips [--root s3://…/warehouse]

``--root`` defaults to a folder under the cluster's ``spark.checkpoint.dir``.
Reports are small (one row per firm / year / hour …) and are written as
Parquet under ``<root>/reports/<name>``.
"""

from __future__ import annotations

import argparse
import json
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from cabflow.plans.refresh import layer_reports, refresh_from_files, set_aside_trips
from cabflow.session import shared_dir, tune_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cabflow")
    sub = parser.add_subparsers(dest="command", required=True)
    refresh = sub.add_parser("refresh", help="rebuild base, silver, marts; write audits and reports")
    refresh.add_argument("--raw", required=True, help="folder of raw trip Parquet files")
    refresh.add_argument("--root", help="output root (default: under spark.checkpoint.dir)")
    refresh.add_argument(
        "--months", nargs=2, metavar=("FIRST", "LAST"),
        help="rebuild only these months (YYYY-MM-01, inclusive); other months stay as written",
    )
    refresh.add_argument("--break-lock", action="store_true", help="take over from a refresh whose driver died")
    args = parser.parse_args(argv)

    spark = tune_session(SparkSession.builder.appName("cabflow-refresh").getOrCreate())
    root = args.root or f"{shared_dir(spark).rstrip('/')}/cabflow-{int(time.time())}"
    paths = refresh_from_files(spark, args.raw, root, months=tuple(args.months) if args.months else None, break_lock=args.break_lock)
    reports = layer_reports(spark, paths)

    def write(name: str) -> None:
        reports[name].write.mode("overwrite").parquet(f"{root}/reports/{name}")

    # Independent small outputs: submit their jobs together.
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(write, reports))
    print(json.dumps({"root": root, "layers": paths, "set_aside": set_aside_trips(spark, paths)}))


if __name__ == "__main__":
    main()
