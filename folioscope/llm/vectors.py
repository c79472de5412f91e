"""Rows with a vector, as integers: what hard-negative mining and whitening begin with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c counts as floor(SCALE * c), c as double.
SCALE = 256


def finite(vector: Column) -> Column:
    """Whether the vector is there and none of its entries is null, NaN or infinite."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, entry), F.lit(False))


def with_integers(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is finite, with x, the scaled integer vector (bigint; entries beyond its range take its ends)."""
    scaled = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))
    return table.where(finite(F.col(vector))).withColumn("x", scaled).drop(vector)


def common_length(rows: DataFrame) -> int:
    """The length that most vectors x have, the larger of two as common ones; 0 for an empty table."""
    best = rows.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "length")).alias("best")).first().best
    return best.length if best else 0
