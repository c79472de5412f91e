"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each document with words gets a place in its source's shuffled order (by a hash of its id, source and text) and, for each pass over its source, a
virtual finish time: the words of its source served up to and including it, divided by the source's weight; a second
pass continues the count. The mix is these units, of all sources and passes, range-sorted by finish time and truncated
where their running sum reaches the total budget. A source whose passes are used up has no more units, which leaves its
share to the others. The unit at the cut counts with the words that the budget still had for it.

Running sums are taken in two levels: within slices, then over the slices' totals. Inside a source slices are ranges of
the hash; across sources they are ranges of finish time, in which all open sources serve words at a constant rate. So a
source that holds a third of all rows, or all rows, is spread over thousands of groups. The level, the virtual time at which
a fluid queue reaches the budget, follows from the sources' sizes alone; it bounds the units that can come before the cut
(those that begin later and finish after all that began by then can't), and gives each source its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import WORD, body, materialize, table

#: Fixed values of the query: weights by order of source, and the share of all words.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: Passes over a source at most.
PASSES = 2
#: Hex digits of the shuffle key that name a slice of a source; slices of the time up to the last unit that matters.
SLICE_DIGITS, TIME_SLICES = 3, 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """From (source, source_size) the same with weight, budget, level, target.

    Sources are taken by code point, null last, and weights repeat. budget is share times all words; level is the virtual
    time at which it is reached: the largest of (budget - words of the sources used up) / (weights of the others)
    over the sources in the order in which they are used up. One row a source, so a single window holds them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = (F.col("source_size") * passes).alias("cap")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", cap, weight.alias("weight"))
    everything = Window.partitionBy()
    drained = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = drained.rowsBetween(Window.unboundedPreceding, -1)
    after = drained.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("reach", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.max("reach").over(everything))
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("cap", "reach")


def row_key() -> F.Column:
    """A digest of a row's text, doc_id and source, nulls told from values: what places it in the order, and names it."""
    told = lambda c: F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c).cast("string")))
    return F.md5(F.concat_ws("|", F.md5(body().cast("binary")), told("doc_id"), told("source")).cast("binary"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), row_key, slice of each row of docs."""
    rows = docs.select("doc_id", "source", F.regexp_count(body(), F.lit(WORD)).cast("long").alias("size"), row_key().alias("row_key"))
    return rows.withColumn("slice", F.substring("row_key", 1, SLICE_DIGITS))


def _in_order() -> list[F.Column]:
    return [F.col("finish"), F.col("source").asc_nulls_last(), F.col("pass"), F.col("row_key")]


def served_units(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, units): keyed(docs), source_targets of them, and the units of the mix.

    A unit is a document with words in one pass: source, row_key, size, pass, finish, served (the words of it that come before the
    cut). Units that serve nothing are left out. Rows that agree in doc_id, source and text may change places, which leaves the
    units as a whole the same.
    """
    rows = materialize(keyed(docs), "mix-sizes")
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("offset", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    sources = materialize(source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, passes), "mix-sources")
    slices = slices.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "slice_size")
    slices = slices.withColumnsRenamed({"source": "of", "slice": "part"})
    within = Window.partitionBy("source", "slice").orderBy("row_key").rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.where("size > 0").withColumn("upto", F.sum("size").over(within)).join(slices, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("part")))
    end = F.col("offset") + F.col("upto") + F.col("source_size") * F.col("pass")
    units = queue.withColumn("pass", F.explode(F.array(*[F.lit(n) for n in range(passes)])))
    units = units.withColumns({"finish": end / F.col("weight"), "began": (end - F.col("size")) / F.col("weight")})
    units = materialize(units.select("source", "row_key", "size", "pass", "finish", "began", "budget", "level"), "mix-units")
    # whatever finishes after all units that began by the level lies behind the cut
    last = units.where("began <= level").agg(F.max("finish")).first()[0] or 0.0
    units = units.where(F.col("finish") <= last).withColumn("time_slice", F.floor(F.col("finish") / F.lit(last or 1.0) * TIME_SLICES).cast("int"))
    totals = units.groupBy("time_slice").agg(F.sum("size").alias("words"))
    earlier = Window.orderBy("time_slice").rowsBetween(Window.unboundedPreceding, -1)  # TIME_SLICES + 1 rows at most
    totals = totals.select(F.col("time_slice").alias("of_slice"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    running = Window.partitionBy("time_slice").orderBy(*_in_order()).rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("upto", F.sum("size").over(running)).join(F.broadcast(totals), F.col("time_slice") == F.col("of_slice"))
    left = F.floor("budget") - F.col("earlier") - F.col("upto") + F.col("size")
    units = units.withColumn("served", F.least(F.col("size"), left).cast("long")).where("served > 0")
    return rows, sources, units.select("source", "row_key", "size", "pass", "finish", "served")


def schedule(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, finish.

    size is the number of words, 0 for null and empty texts. taken is the words of the row that the mix takes, over all
    passes: at most passes times size. All taken words add up to the budget, rounded down, or to all that there is; a source's
    differ from its target by the documents in service at the cut. finish is the virtual finish time of the first pass that
    serves the row, null if none does. Rows that agree in doc_id, source and text are dealt the places of all of them.
    Reruns agree. A null source is a source, last in order. An empty table gives an empty result. Only doc_id, source and text
    are read.
    """
    rows, sources, units = served_units(docs, weights, share, passes)
    # of rows alike, the n-th has the n-th place in each pass
    rows = rows.repartition("row_key").withColumn("nth", F.row_number().over(Window.partitionBy("row_key").orderBy("size")))
    units = units.repartition("row_key").withColumn("nth", F.row_number().over(Window.partitionBy("row_key", "pass").orderBy("finish")))
    taken = units.groupBy("row_key", "nth").agg(F.sum("served").alias("taken"), F.min("finish").alias("finish"))
    of = sources.select(F.col("source").alias("of"), "source_size", "target")
    rows = rows.join(taken, ["row_key", "nth"], "left").join(of, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "finish")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix as a training run reads it: docs' rows, all columns, in order of finish time, once for each pass that serves them.

    The document at the cut is in the mix if at least half of it was served. Rows without words are not served. Rows that
    agree in doc_id, source and text are one document that comes as often as all of them together; its other columns, which
    must be of types that can be ordered, are those of the least row. Columns of docs may have any names. Reruns agree; an
    empty table gives an empty mix.
    """
    _, _, units = served_units(docs, weights, share, passes)
    row = docs.select(row_key().alias("row_key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row = row.groupBy("row_key").agg(F.min("row").alias("row"))
    joined = row.join(units.where("served * 2 >= size"), "row_key")
    ordered = joined.repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order())
    return ordered.select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = schedule(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "finish")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS i,
                  md5(md5(coalesce(text, '')) || '|' || CASE WHEN doc_id IS NULL THEN '0' ELSE '1' || doc_id END || '|' || CASE WHEN source IS NULL THEN '0' ELSE '1' || source END) AS k,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
             list_extract([5.0::DOUBLE, 2.0, 1.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight FROM n),
r AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM w),
t AS (SELECT *, least(cap::DOUBLE, (max(reach) OVER ()) * weight) AS target FROM r),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, i ROWS UNBOUNDED PRECEDING) AS upto FROM d WHERE size > 0),
u AS (SELECT q.i, q.k, q.source, q.size, pass, (upto + pass * source_size)::DOUBLE / weight AS finish, budget
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS p(pass)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, k, i ROWS UNBOUNDED PRECEDING) - size AS before FROM u),
s AS (SELECT i, sum(least(size, floor(budget)::BIGINT - before))::BIGINT AS taken, min(finish) AS finish FROM o WHERE before < floor(budget)::BIGINT GROUP BY i)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(s.taken, 0) AS taken, s.finish
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN s ON d.i = s.i
"""
