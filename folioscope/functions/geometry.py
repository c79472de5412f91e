"""Integer geometry of page images: sizes to try, bands to cut, rotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed defaults of the extraction settings.
MAX_DIM, FALLBACK_DIMS, BAND_HEIGHTS = 1600, (1600, 1200), (1200, 900)


def resized(width: Column, height: Column, limit: Column) -> Column:
    """struct(width, height) after scaling the longer side down to limit."""
    longest = F.greatest(width, height)
    ratio = limit / longest
    scaled = lambda x: F.greatest(F.lit(1), F.floor(x * ratio).cast("int"))
    fits = longest <= limit
    return F.struct(F.when(fits, width).otherwise(scaled(width)).alias("width"), F.when(fits, height).otherwise(scaled(height)).alias("height"))


def candidate_sizes(width: Column, height: Column, max_dim: int = MAX_DIM, fallbacks=FALLBACK_DIMS, ascending: bool = False) -> Column:
    """Distinct sizes to try, in order: the own size if small enough, then the fallbacks; ascending sorts the limits first."""
    longest = F.greatest(width, height)
    own = F.when(longest <= max_dim, F.array(longest)).otherwise(F.array().cast("array<int>"))
    dims = F.filter(F.concat(own, F.array(*[F.lit(d) for d in fallbacks])), lambda d: d > 0)
    if ascending:
        dims = F.array_sort(F.array_distinct(dims))
    sizes = F.array_distinct(F.transform(dims, lambda d: resized(width, height, d)))
    return F.when(F.size(sizes) > 0, sizes).otherwise(F.array(F.struct(width.alias("width"), height.alias("height"))))


def band_heights(height: Column, configured=BAND_HEIGHTS) -> Column:
    """Band heights to try: half the page if that leaves bands of the least configured height, then the configured ones."""
    least = min(configured, default=0)
    half = F.ceil(height / 2).cast("int")
    heights = F.array(*[F.lit(h) for h in configured]).cast("array<int>")
    tried = F.when(F.lit(bool(least)) & (height >= least * 2), F.concat(F.array(half), heights)).otherwise(heights)
    tried = F.filter(F.array_distinct(tried), lambda h: h > 0)
    return F.when(F.size(tried) > 0, tried).otherwise(F.array(F.greatest(F.lit(1), height)))


def bands(height: Column, limit: Column) -> Column:
    """array of struct(top, bottom): overlapping bands that cover the page; one band if it fits the limit."""
    n = F.greatest(F.lit(2), F.ceil(height / limit).cast("int"))
    step = F.ceil(height / n).cast("int")
    overlap = F.least(F.lit(96), F.greatest(F.lit(24), F.floor(step / 12).cast("int")))

    def band(i: Column) -> Column:
        top = F.when(i == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), i * step - overlap))
        bottom = F.when(i == n - 1, height).otherwise(F.least(height, (i + 1) * step + overlap))
        return F.struct(top.cast("int").alias("top"), bottom.cast("int").alias("bottom"))

    whole = F.array(F.struct(F.lit(0).alias("top"), height.cast("int").alias("bottom")))
    return F.when(height <= limit, whole).otherwise(F.transform(F.sequence(F.lit(0), n - 1), band))


def max_reasonable_chars(width: Column, height: Column) -> Column:
    """Characters that a page of this size may hold."""
    return F.greatest(F.lit(2500), F.least(F.lit(14000), F.floor(F.greatest(F.lit(1), width * height) / 420).cast("int")))


def rotation(normal: Column, inverted: Column) -> Column:
    """180 if the page reads clearly better upside down."""
    better = (inverted > normal * 1.2) & (inverted - normal > 25)
    return F.when(better | ((normal < 15) & (inverted > 45)), 180).otherwise(0)
