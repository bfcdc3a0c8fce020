"""python -m tracewright list | run QUERY --data DIR [--out PATH] [--format json|csv|parquet] [--rows N]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import catalog
from .sources.io import write_jsonl, write_report


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tracewright")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="one query over a folder of tables")
    run.add_argument("query", choices=sorted(catalog.queries()), metavar="QUERY")
    run.add_argument("--data", required=True, help="folder with a Parquet file for each table")
    run.add_argument("--out", help="where to write; without it, rows are shown")
    run.add_argument("--format", choices=("json", "csv", "parquet"), default="json")
    run.add_argument("--rows", type=int, default=20, help="rows shown")
    chosen = parser.parse_args(args)
    if chosen.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    df = catalog.queries()[chosen.query](SparkSession.builder.appName(f"tracewright {chosen.query}").getOrCreate(), chosen.data)
    if not chosen.out:
        df.show(chosen.rows, truncate=False)
    elif chosen.format == "parquet":
        df.write.mode("overwrite").parquet(chosen.out)
    else:
        (write_jsonl if chosen.format == "json" else write_report)(df, chosen.out)


if __name__ == "__main__":
    main()
