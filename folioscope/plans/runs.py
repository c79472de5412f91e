"""Whole runs: evaluation of result files against a reference, charts of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import evaluate, standardize
from folioscope.plans import charts
from folioscope.sources import documents, sinks


def standard_pages(files: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(documents, standard pages) of files (path, json), all under one doc; a file is known by its path in output_file."""
    docs, raw = documents.load_documents(files)
    pages = standardize.standardize_pages(raw.withColumns({"doc": F.lit(doc), "output_file": F.col("path")}).drop("path"))
    return docs, pages


def rated_files(spark: SparkSession, reference: str, outputs: list[str] | None = None, root: str = ".") -> tuple[DataFrame, DataFrame]:
    """(reference pages, candidate pages), standard, of one reference file and the result files; without outputs those that discover finds under root.

    As no file says which document it belongs to, all belong to the one reference. Two files of one model are two candidates: the later ones' models are named with their paths.
    """
    ref = standard_pages(documents.read_files(spark, [reference]), "reference")[1]
    found = documents.read_files(spark, outputs) if outputs else documents.discover(spark, root)
    made = standard_pages(found, "reference")[1]
    named = made.groupBy("model").agg(F.min("output_file").alias("first_file"))
    made = made.join(named, "model").withColumn("model", F.when(F.col("output_file") == F.col("first_file"), F.col("model")).otherwise(F.concat_ws(" ", "model", "output_file"))).drop("first_file", "output_file")
    return ref.drop("output_file"), made


def evaluate_files(spark: SparkSession, reference: str, outputs: list[str] | None = None, root: str = ".", report_path: str | None = None) -> DataFrame:
    """The ranking of result files against one reference file (rated_files); with report_path the whole report is written there as JSON."""
    ref, made = rated_files(spark, reference, outputs, root)
    if report_path:
        sinks.write_report(evaluate.report(ref, made), report_path)
    return evaluate.leaderboard(ref, made)


def evaluation_report(spark: SparkSession, reference: str, outputs: list[str] | None = None, root: str = ".", report_path: str | None = None, show_pages: bool = False) -> DataFrame:
    """n, line: the console report of evaluate_files, with each model's pages if asked for."""
    ref, made = rated_files(spark, reference, outputs, root)
    if report_path:
        sinks.write_report(evaluate.report(ref, made), report_path)
    name = reference.rstrip("/").rsplit("/", 1)[-1]
    about = standardize.build_documents(ref, ("doc",)).select("doc", F.lit(name).alias("file_name"), "page_count", F.length("text_for_cer_wer").alias("total_char_count"), "total_word_count")
    return evaluate.console_report(about, evaluate.leaderboard(ref, made), evaluate.page_metrics(ref, made) if show_pages else None).select("n", "line")


def chart_frames(spark: SparkSession, report_paths: list[str], labels: dict[str, str] | None = None, families: dict[str, str] | None = None) -> DataFrame:
    """The heat map's cells of written reports: what heat_cells makes of a report's ranked models and their pages; doc is the report's path."""
    rows = documents.load_report(documents.read_files(spark, report_paths)).withColumnRenamed("path", "doc")
    return charts.heat_cells(rows.select("doc", "model", "rank").distinct(), rows, labels, families)
