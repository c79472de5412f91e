"""Frames for the chart panel; drawing them is up to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.distance import fixed
from folioscope.functions.names import color, label


def percent_label(cer):
    return F.when(cer > 1, F.lit(">100%")).otherwise(F.concat(fixed(cer * 100, 0), F.lit("%")))


def heat_cells(board: DataFrame, pages: DataFrame, labels: dict[str, str] | None = None, families: dict[str, str] | None = None) -> DataFrame:
    """doc, rank, model, label, color, position, cell (cer up to 1), percent of each page of each ranked model.

    Position counts a model's pages from 1; there are as many columns as the first-ranked model has pages.
    """
    place = F.row_number().over(Window.partitionBy("doc", "model").orderBy("page"))
    rows = pages.select("doc", "model", "page", "cer").withColumn("position", place)
    # joined by doc alone, by which the windows are dealt too: rows are shuffled and sorted once
    ranks = board.groupBy("doc").agg(F.collect_list(F.struct(F.col("model").alias("of"), "rank")).alias("ranks"))
    rows = rows.join(ranks, "doc").select(*rows.columns, F.explode(F.filter("ranks", lambda r: r["of"] == F.col("model"))).alias("r")).select(*rows.columns, F.col("r.rank").alias("rank"))
    width = F.max(F.when(F.col("rank") == 1, F.col("position"))).over(Window.partitionBy("doc"))
    rows = rows.withColumn("columns", width).where("position <= columns")
    return rows.select("doc", "rank", "model", label(F.col("model"), labels, families).alias("label"), color(F.col("rank") - 1).alias("color"), "position", F.least("cer", F.lit(1.0)).alias("cell"), percent_label(F.col("cer")).alias("percent"))


def heat_matrix(cells: DataFrame, columns: int) -> DataFrame:
    """doc, rank, label, p1 ... pN."""
    wide = cells.groupBy("doc", "rank", "label").pivot("position", list(range(1, columns + 1))).agg(F.first("cell"))
    return wide.withColumnsRenamed({str(n): f"p{n}" for n in range(1, columns + 1)})


def axis_limits(board: DataFrame) -> DataFrame:
    """Upper ends of the bar axes."""
    return board.groupBy("doc").agg((F.max("total_processing_seconds") * 1.18).alias("time_axis"), (F.max("cer") * 1.2).alias("cer_axis"), (F.max("wer") * 1.2).alias("wer_axis"))
