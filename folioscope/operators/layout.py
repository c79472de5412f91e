"""Reading order: boxes or keyed words to lines to text, in time linear in a page's boxes but for their sorting.

Where a line of boxes ends depends on the running means of the line so far. These are the one thing that Python works out: it
passes once over rows that Spark has sorted, holds four numbers, and gives each box the number of its line. Lines of keyed words are islands
between changes of key, found by windows. Everything else is grouping and windows over lines, in the JVM; no array grows in a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import dedupe_lines, strip

#: Least tolerance and its share of a height for boxes of one line; least gap of paragraphs and its shares.
TOLERANCE, TOLERANCE_SHARE, GAP, GAP_BEFORE, GAP_AFTER = 12.0, 0.65, 18.0, 1.4, 1.2


def box_of_polygon(points: Column) -> Column:
    """struct(left, top, right, bottom) of array<array<double>>; null without points."""
    x = F.transform(points, lambda p: p[0])
    y = F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("top"), F.array_max(x).alias("right"), F.array_max(y).alias("bottom")))


def box_of_scalars(v: Column) -> Column:
    """The same of [x1, y1, x2, y2]."""
    return F.when(F.size(v) == 4, F.struct(F.least(v[0], v[2]).alias("left"), F.least(v[1], v[3]).alias("top"), F.greatest(v[0], v[2]).alias("right"), F.greatest(v[1], v[3]).alias("bottom")))


def synthetic_box(index: Column, text: Column) -> Column:
    """The box of a text that came without one: below the earlier ones, eight units a character."""
    top = (index * 20).cast("double")
    return F.struct(F.lit(0.0).alias("left"), top.alias("top"), F.greatest(F.lit(1.0), F.length(text) * F.lit(8.0)).alias("right"), (top + 10.0).alias("bottom"))


def _numbered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of page and place, with the number of each row's line. A line's middle and height are means of its boxes so far."""
    page, line, count, middles, heights = _numbered_lines, 0, 0, 0.0, 0.0  # no page yet: a key may be null
    for batch in batches:
        names = batch.column("page_key")
        lines = []
        differ = pc.or_(pc.not_equal(names[1:], names[:-1]).fill_null(False), pc.xor(names[1:].is_null(), names[:-1].is_null()))
        changes = [True, *differ.to_pylist()] if batch.num_rows else []
        if changes:
            changes[0] = names[0].as_py() != page
            page = names[-1].as_py()
        for new, middle, height in zip(changes, batch.column("middle").to_pylist(), batch.column("height").to_pylist()):
            if new:
                line, count = 0, 0
            if count and abs(middle - middles / count) <= max(TOLERANCE, min(heights / count, height) * TOLERANCE_SHARE):
                count, middles, heights = count + 1, middles + middle, heights + height
            else:
                line, count, middles, heights = line + 1, 1, middle, height
            lines.append(line)
        yield batch.append_column("line", pa.array(lines, pa.int64()))


def boxes_to_text(boxes: DataFrame, keys=("page",), tasks: int | None = None) -> DataFrame:
    """keys and text from boxes (keys, idx, text, left, top, bottom).

    Boxes go by top, left, idx. One joins the current line if its middle is within the tolerance of the line's, whose
    figures are means of its boxes. Words of a line go by left, top, idx; a wide gap makes a blank line; repeated lines go.
    tasks: how many to deal pages to, if not the session's number.
    """
    top, bottom = F.col("top").cast("double"), F.col("bottom").cast("double")
    rows = boxes.select(
        (F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))).alias("page_key"), *keys, "idx", "text", top.alias("top"), F.col("left").cast("double").alias("left"), bottom.alias("bottom"),
        ((top + bottom) / 2.0).alias("middle"), F.greatest(F.lit(1.0), bottom - top).alias("height"),
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    parts = [tasks] if tasks else []
    numbered = rows.repartition(*parts, "page_key").sortWithinPartitions("page_key", "top", "left", "idx").mapInArrow(_numbered_lines, f"{kept}, line long").drop("page_key")
    # dealt by page once more, as Python hides that it is, and then no more
    numbered = numbered.repartition(*parts, *keys)
    words = F.array_sort(F.collect_list(F.struct("left", "top", "idx", "text")))
    lines = numbered.groupBy(*keys, "line").agg(
        strip(F.array_join(F.transform(words, lambda w: w["text"]), " ")).alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.avg("height").alias("height")
    )
    return _pages(lines.withColumn("section", F.lit(0)), keys)


def _pages(lines: DataFrame, keys) -> DataFrame:
    """keys and text of lines (keys, line, text, top, bottom, height, section): one under the other, a blank one where a gap is wide or the section changes. Lines without text don't count."""
    filled = F.when(F.col("text") != "", F.struct("bottom", "height", "section"))
    before = F.last(filled, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("before", before)
    wide = F.col("top") - F.col("before.bottom") > F.greatest(F.lit(GAP), F.col("before.height") * GAP_BEFORE, F.col("height") * GAP_AFTER)
    apart = F.col("before").isNotNull() & (wide | (F.col("section") != F.col("before.section")))
    shown = F.when(F.col("text") != "", F.struct("line", F.when(apart, F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("shown")))
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(shown)).alias("parts"))
    joined = parts.withColumn("joined", F.array_join(F.transform("parts", lambda p: p["shown"]), "\n"))
    return joined.select(*keys, dedupe_lines(F.col("joined")).alias("text"))


def keyed_words_to_text(words: DataFrame, keys=("page",)) -> DataFrame:
    """keys and text from words (keys, idx, text, top, height, block_num, par_num, line_num), in order of idx.

    A line ends where block, paragraph or line number changes (a null one always is another). Its height is a halving mean: each word's height is
    averaged with the mean so far. A new block or paragraph, or a wide gap, makes a blank line.
    """
    tall = F.greatest(F.lit(1), F.col("height"))
    numbers = ("block_num", "par_num", "line_num")
    rows = words.select(*keys, "idx", "text", F.col("top").cast("double").alias("top"), (F.col("top") + tall).cast("double").alias("bottom"), tall.cast("double").alias("height"), *[F.col(n).cast("long").alias(n) for n in numbers])
    # the window's order is total, so that equal idx fall alike in all three uses
    order = Window.partitionBy(*keys).orderBy("idx", "text", "top", "bottom", "height", *numbers)
    same = F.lit(True)
    for n in numbers:
        same = same & (F.lag(n).over(order) == F.col(n))
    rows = rows.withColumn("starts", F.when(same, 0).otherwise(1)).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("line", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    items = F.array_sort(F.collect_list(F.struct("place", "text", "height")))
    lines = rows.groupBy(*keys, "line").agg(items.alias("items"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.first("block_num").alias("block"), F.first("par_num").alias("par"))
    height = F.aggregate(F.transform("items", lambda i: i["height"]), F.col("items")[0]["height"], lambda mean, h: (mean + h) / 2.0)
    shaped = lines.select(*keys, "line", strip(F.array_join(F.transform("items", lambda i: i["text"]), " ")).alias("text"), "top", "bottom", height.alias("height"), F.struct("block", "par").alias("section"))
    return _pages(shaped, keys)
