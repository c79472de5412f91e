"""Whitening of vectors: principal components of the distinct ones by MLlib's computeSVD on centred distributed rows.

The fit list holds each distinct integer vector once: n vectors with sums S per dimension. Its rows, centred by S / n in
the plan, become a RowMatrix; singular values s of the centred rows give the eigenvalues s * s / n of their covariance
(divisor n), right singular vectors its components. With as many singular values asked as there are columns, computeSVD
solves the matrix of products (columns by columns) by LAPACK, to double precision; executors sum that matrix in a tree.

Total variance doesn't come from the singular values: it is the sum of exact integer deviations (n * x - S)^2 in decimals,
divided by n^3 once. What is collected is bounded by the number of columns, never by rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import materialize, table
from folioscope.llm.vectors import common_length, with_integers

#: Components that the query returns.
COMPONENTS = 4
#: Components whose singular value is below this share of the largest one count as without variance: rounding of the matrix
#: of products alone gives them some 1e-8 of it.
R_COND = 1e-6
EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sums per dimension, unit components as rows, eigenvalues in falling order, total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    total_variance: float

    def mean(self) -> np.ndarray:
        return np.array(self.sums, dtype=np.float64) / self.n


def _longs(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def deviation(n: int, sums: tuple[int, ...]) -> Column:
    """Sum over dimensions of (n * x - S)^2, exact, as decimal(38,0); null where that doesn't hold it (x or S too large).

    It is n^2 * sum(x^2) - 2n * sum(x * S) + sum(S^2): whole sums in longs, three products in decimals a row.
    """
    squares = F.aggregate("x", F.lit(0).cast("long"), lambda total, c: F.try_add(total, F.try_multiply(c, c)))
    crossed = F.aggregate(F.zip_with("x", _longs(sums), F.try_multiply), F.lit(0).cast("long"), F.try_add)
    decimal = lambda v: (F.lit(str(v)) if isinstance(v, int) else v).cast(EXACT)
    return F.try_add(F.try_subtract(F.try_multiply(decimal(n * n), decimal(squares)), F.try_multiply(decimal(2 * n), decimal(crossed))), decimal(sum(s * s for s in sums))).cast(EXACT)


def fit(distinct: DataFrame) -> Whitening | None:
    """The whitening of a table of distinct vectors x of one length; None if it is empty or the vectors have no entries."""
    sums = {r.at: (r.total, r.n) for r in distinct.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n")).collect()}
    if not sums:
        return None
    n, totals = sums[0][1], tuple(sums[at][0] for at in sorted(sums))
    mean = F.array(*[F.lit(s / n) for s in totals])
    centred = distinct.select(array_to_vector(F.zip_with("x", mean, lambda c, m: c.cast("double") - m)).alias("row"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, len(totals)).computeSVD(len(totals), computeU=False, rCond=R_COND)
    singular = svd.s.toArray()
    has_variance = singular > 0
    components = svd.V.toArray().T[has_variance]
    largest = np.abs(components).argmax(axis=1)
    components *= np.sign(components[np.arange(len(components)), largest])[:, None]  # either sign does: the largest entry is positive
    eigenvalues = singular[has_variance] ** 2 / n
    exact = deviation(n, totals)
    whole = distinct.agg(F.sum(exact).alias("total"), F.sum(exact.isNull().cast("int")).alias("beyond")).first()
    total = int(whole.total) / n**3 if whole.total is not None and not whole.beyond else float((singular**2).sum() / n)
    return Whitening(n, totals, components, eigenvalues, total)


def whitened(rows: DataFrame, model: Whitening, components: int) -> DataFrame:
    """rows with an array column whitened: (x - S / n) projected on the first components, over the roots of their eigenvalues."""
    mean, kept = model.mean(), min(components, len(model.eigenvalues))
    means = F.array(*[F.lit(float(m)) for m in mean])
    centred = F.zip_with("x", means, lambda c, m: c.cast("double") - m)
    axes = F.array(*[F.array(*[F.lit(float(v)) for v in axis]) for axis in model.components[:kept]])
    roots = F.array(*[F.lit(float(np.sqrt(e))) for e in model.eigenvalues[:kept]])
    project = lambda axis: F.aggregate(F.zip_with("centred", axis, lambda c, v: c * v), F.lit(0.0), lambda total, c: total + c)
    return rows.withColumn("centred", centred).withColumn("whitened", F.zip_with(F.transform(axes, project), roots, lambda p, root: p / root)).drop("centred")


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance (divisor n, centred) minus the identity."""
    kept = min(components, len(model.eigenvalues))
    axes = [F.col("whitened")[i] for i in range(kept)]
    pairs = [(i, j) for i in range(kept) for j in range(i + 1)]
    found = whitened(distinct, model, components).agg(*[F.covar_pop(axes[i], axes[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry go, and so do vectors of another length than most
    (they have no place in one covariance). Repeated rows each have their result; vectors that occur often count once in the fit. Rows
    without a vec_id stay, with a null one. Components without variance are left out, so a table of one distinct
    vector, of vectors without entries, or an empty table gives no rows. Only vec_id and embedding are read.
    """
    spark = embeddings.sparkSession
    rows = materialize(with_integers(embeddings.select("vec_id", "embedding")), "whitening-rows")
    rows = rows.where(F.size("x") == common_length(rows))
    distinct = materialize(rows.select("x").distinct(), "whitening-fit")
    model = fit(distinct)
    shape = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], shape)
    error = identity_error(distinct, model, components)
    explained = F.array(*[F.lit(float(e / model.total_variance)) for e in model.eigenvalues[:components]])
    found = whitened(rows.withColumn("deviation", deviation(model.n, model.sums)), model, components)
    found = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as a long; null where a long doesn't hold it (from some ten million distinct vectors of this size on), where whiten has it whole."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
