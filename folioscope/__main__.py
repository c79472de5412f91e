"""Commands: evaluate rates result files against a reference and prints the ranking; chart writes the heat map's cells of reports."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import runs


def commands() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    parts = parser.add_subparsers(dest="command", required=True)
    rate = parts.add_parser("evaluate", help="rate result files against a reference")
    rate.add_argument("reference", help="JSON file with the true pages, as a list or an object with pages")
    rate.add_argument("outputs", nargs="*", help="result files; without any those that are found under --root")
    rate.add_argument("-o", "--output", help="folder for the report as JSON")
    rate.add_argument("--root", default=".", help="where results are looked for")
    rate.add_argument("--show-pages", action="store_true", help="list each model's pages too")
    chart = parts.add_parser("chart", help="write the cells of a chart of reports")
    chart.add_argument("reports", nargs="+", help="reports that evaluate wrote")
    chart.add_argument("-o", "--output", required=True, help="folder for the cells as Parquet")
    return parser


def run(spark: SparkSession, arguments: list[str] | None = None) -> DataFrame:
    """What a command shows, as rows: lines of the console report, or the cells that were written."""
    args = commands().parse_args(arguments)
    if args.command == "chart":
        runs.chart_frames(spark, args.reports).write.mode("overwrite").parquet(args.output)
        return spark.read.parquet(args.output)
    return runs.evaluation_report(spark, args.reference, args.outputs or None, args.root, args.output, args.show_pages)


def main() -> None:
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    shown = run(spark)
    if "line" in shown.columns:
        for row in shown.orderBy("n").toLocalIterator():
            print(row.line)
    else:
        print(f"{shown.count()} cells")


if __name__ == "__main__":
    main()
