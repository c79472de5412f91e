"""Edit distance and error rates.

The distance is unit-cost Levenshtein over code points or over words, computed bit-parallel (Myers 1999, Hyyrö 2003) on
integers of any width, after common ends are cut off. Short pairs may use Spark's own levenshtein, which agrees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import count_spaced_words


def edit_distance(a: Sequence, b: Sequence) -> int:
    if a == b:
        return 0
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[start : len(a) - tail], b[start : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0  # vertical differences of +1 and -1
    for x in b:
        here = where.get(x, 0) | down
        level = (((here & up) + up) ^ up | here) & full
        right = (down | full ^ (up | level)) << 1 | 1
        up, down = ((up & level) << 1 | ~(level | right)) & full, right & level
    return len(b) + up.bit_count() - down.bit_count()


def _pairs(a: pa.Array, b: pa.Array) -> Iterator[tuple[str, str]]:
    """Of a batch one pair of strings at a time, so that a task holds no second copy of its texts."""
    return ((x.as_py() or "", y.as_py() or "") for x, y in zip(a, b))


@F.arrow_udf(T.IntegerType())
def char_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([edit_distance(x, y) for x, y in _pairs(a, b)], pa.int32())


@F.arrow_udf(T.IntegerType())
def word_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([edit_distance(x.split(), y.split()) for x, y in _pairs(a, b)], pa.int32())


@F.pandas_udf(T.DoubleType())
def round3(x: pd.Series) -> pd.Series:
    """Three decimals, rounded from the exact binary value; Spark's round and bround start from the shortest decimal."""
    return x.map(lambda v: None if pd.isna(v) else round(max(0.0, v), 3)).astype("float64")  # infinity stays


def fixed(x: Column, digits: int) -> Column:
    """Decimals as Python and C print them, rounded from the exact binary value; Java's formats start from the shortest decimal."""

    @F.pandas_udf(T.StringType())
    def printed(c: pd.Series) -> pd.Series:
        return c.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}").astype(object)

    return printed(x.cast("double"))


def safe_rate(distance: Column, length: Column) -> Column:
    """distance / length, which may exceed 1; without a reference 0 if nothing differs, else 1."""
    return F.when(length > 0, distance / length).when(distance == 0, F.lit(0.0)).otherwise(F.lit(1.0))


METRICS = ("reference_char_count", "hypothesis_char_count", "reference_word_count", "hypothesis_word_count", "char_distance", "word_distance", "cer", "wer")


def with_counts(df, reference: str, hypothesis: str):
    """df with the first four of METRICS; the texts are scoring texts, whose words are parted by single spaces."""
    return df.withColumns(
        {
            "reference_char_count": F.length(reference),
            "hypothesis_char_count": F.length(hypothesis),
            "reference_word_count": count_spaced_words(F.col(reference)),
            "hypothesis_word_count": count_spaced_words(F.col(hypothesis)),
        }
    )


def with_rates(df):
    """df (with counts and distances) with cer and wer."""
    return df.withColumns({"cer": safe_rate(F.col("char_distance"), F.col("reference_char_count")), "wer": safe_rate(F.col("word_distance"), F.col("reference_word_count"))})


def with_metrics(df, reference: str, hypothesis: str):
    """df with METRICS of the two scoring texts."""
    # equal texts stay in the JVM: nulls stand for them, which have no distance
    differ = F.coalesce(F.col(reference), F.lit("")) != F.coalesce(F.col(hypothesis), F.lit(""))
    a, b = (F.when(differ, F.col(c)) for c in (reference, hypothesis))
    distances = {"char_distance": char_distance(a, b), "word_distance": word_distance(a, b)}
    return with_rates(with_counts(df, reference, hypothesis).withColumns(distances))
