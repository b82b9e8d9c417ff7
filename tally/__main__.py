"""Run reports over a data folder or an order-line CSV and write each result.

    python -m tally --data /path/to/tables --out /path/to/results [--format csv] [name ...]
    python -m tally --store-csv orders.csv --out /path/to/results
    python -m tally --restaurant-csv orders.csv [--sizes S,M,L] [--multiline] --out /path/to/results

A CSV is converted once to Parquet (``<out>/order_lines``), which the reports then read.

With no names every registered report runs.  ``--list`` prints the names;
``--cube`` stores one roll-up of the lines (``<out>/cube``) and runs the additive reports from it, with one line scan;
``--layout`` first lays lines and orders out by order (``<out>/tables.layout``) and reads those.
``--explain`` prints each report's physical plan instead of running it
(``--no-broadcast`` plans as if no dimension fit a broadcast, as at scale).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tally.plans.cube import build_cube, cube_reports
from tally.plans.reports import REPORTS
from tally.session import build_session
from tally.sources.layout import write_layout
from tally.sources.writer import write_result


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m tally", description=__doc__.splitlines()[0])
    ap.add_argument("names", nargs="*", help="reports to run (default: all)")
    ap.add_argument("--data", help="folder holding <table>.parquet")
    ap.add_argument("--store-csv", help="retail order-line CSV (Latin-1, month-first dates)")
    ap.add_argument("--restaurant-csv", help="restaurant order-line CSV (day-first dates)")
    ap.add_argument("--sizes", help="restaurant: the pivot's columns, comma-separated; a line of another size fails")
    ap.add_argument("--multiline", action="store_true",
                    help="the CSV has newlines inside quotes (each file is then one task)")
    ap.add_argument("--rejects", action="store_true",
                    help="leave out the CSV's lines that cannot be read and list them in <out>/rejected, with counts in <out>/reject_counts")
    ap.add_argument("--out", help="folder to write one result per report into")
    ap.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    ap.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    ap.add_argument("--list", action="store_true", help="print the report names and exit")
    ap.add_argument("--explain", action="store_true", help="print physical plans instead of running")
    ap.add_argument("--cube", action="store_true", help="run the additive reports from one stored roll-up")
    ap.add_argument("--layout", action="store_true", help="bucket lines and orders by order first")
    ap.add_argument("--no-broadcast", action="store_true",
                    help="with --explain: plan as if no dimension fit a broadcast")
    args = ap.parse_args(argv)
    if args.list:
        print("\n".join(REPORTS))
        return 0
    if args.store_csv or args.restaurant_csv:
        if not args.out:
            ap.error("--out is required")
        return _run_csv(args)
    if not args.data or not (args.out or args.explain):
        ap.error("--data and --out (or --explain) are required")
    unknown = [n for n in args.names if n not in REPORTS]
    if unknown:
        ap.error(f"unknown reports: {unknown}")
    existing = SparkSession.getActiveSession()
    spark = build_session(args.master)
    if args.explain:
        if args.no_broadcast:
            spark.conf.set("tally.broadcast.maxBytes", "0")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in args.names or list(REPORTS):
            print(f"### {name}\n\n```")
            REPORTS[name](spark, args.data).explain()
            print("```\n", flush=True)
        return 0
    out = args.out.rstrip("/")
    data = write_layout(spark, args.data, f"{out}/tables.layout") if args.layout else args.data
    rolled = {}
    if args.cube:
        rolled = cube_reports(spark, data, build_cube(spark, data, f"{out}/cube"))
        refused = [n for n in args.names if n not in rolled]
        if refused:
            ap.error(f"not additive, run without --cube: {refused}")
    for name in args.names or list(rolled or REPORTS):
        write_result(rolled[name] if args.cube else REPORTS[name](spark, data), f"{out}/{name}", fmt=args.format)
        print(f"wrote {name}", flush=True)
    if existing is None:  # only stop a session started here
        spark.stop()
    return 0


def _run_csv(args) -> int:
    from tally.plans.notebook import restaurant_reports, store_reports
    from tally.sources.records import read_restaurant_checked, read_store_checked, reject_counts
    from tally.sources.csv import (
        read_restaurant_raw, read_store_raw, restaurant_lines, store_lines, to_parquet,
    )
    existing = SparkSession.getActiveSession()
    spark = build_session(args.master)
    out = args.out.rstrip("/")
    parsed = f"{out}/order_lines"
    if args.rejects:
        read = read_store_checked if args.store_csv else read_restaurant_checked
        good, rejected = read(spark, args.store_csv or args.restaurant_csv, quoted_newlines=args.multiline)
        lines = to_parquet(good, parsed)
        write_result(rejected, f"{out}/rejected", fmt="json")
        write_result(reject_counts(rejected), f"{out}/reject_counts", fmt="json")
        sizes = args.sizes.split(",") if args.sizes else None
        frames = store_reports(lines) if args.store_csv else restaurant_reports(lines, sizes=sizes)
    elif args.store_csv:
        raw = to_parquet(read_store_raw(spark, args.store_csv, args.multiline), parsed)
        frames = store_reports(store_lines(raw), raw=raw)
    else:
        raw = to_parquet(read_restaurant_raw(spark, args.restaurant_csv, args.multiline), parsed)
        sizes = args.sizes.split(",") if args.sizes else None
        frames = restaurant_reports(restaurant_lines(raw), sizes=sizes, raw=raw)
    unknown = [n for n in args.names if n not in frames]
    if unknown:
        raise SystemExit(f"unknown reports for this input: {unknown}; known: {sorted(frames)}")
    for name in args.names or list(frames):
        write_result(frames[name], f"{args.out.rstrip('/')}/{name}", fmt=args.format)
        print(f"wrote {name}", flush=True)
    if existing is None:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
