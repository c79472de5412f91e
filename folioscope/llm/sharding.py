"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has SLOTS places. Each shard has VNODES virtual nodes on it, at hashes of its number; a key belongs to the next
virtual node clockwise from its own hash. Loads are bounded by capacities that add up to the number of rows and differ by
one at most (the shards that would hold most have the larger ones). A shard takes its own keys first, in ring order, up to its capacity. What
is left over continues clockwise: past its virtual node to the next one of a shard that has room. So as many rows leave
their own shard as there are above the capacities, and with one shard more few rows move besides those that it takes.

How many rows go where follows from the number of rows of each virtual node alone: a table of shards * VNODES rows,
whatever the input. Rows get their number within a virtual node by counting: the rows of a node are dealt to cells by a hash of
their content, cells are counted, and only rows of one cell are numbered in a window. Cells with many rows, as of one key that fills a
third of the table, are split by a number that rows get when they are first written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import body, materialize, small_or_shuffled, table

#: Places on the ring, and virtual nodes a shard.
SLOTS = 1 << 16
VNODES = 64
SHARDS = 16
#: Rows that one window numbers, about; cells with more are split.
CELL_ROWS = 50_000


def ring_slot(key: Column) -> Column:
    """The place of a key on the ring."""
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """slot, node, shard: for each place the next virtual node clockwise, named by its own place. Of nodes that meet in one place the lowest shard's stays."""
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("copy"))
    nodes = every.select("shard", ring_slot(F.concat_ws("/", "shard", "copy")).alias("slot")).groupBy("slot").agg(F.min("shard").alias("shard"))
    places = spark.range(SLOTS).withColumnRenamed("id", "slot").join(F.broadcast(nodes), "slot", "left")
    here = F.when(F.col("shard").isNotNull(), F.struct(F.col("slot").alias("node"), "shard"))
    everywhere = Window.partitionBy(F.lit(0))
    # read backwards, the last node seen is the next one clockwise; past the last place comes the first node
    backwards = everywhere.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.coalesce(F.last(here, ignorenulls=True).over(backwards), F.min(here).over(everywhere))
    return places.select("slot", owner.alias("owner")).select("slot", "owner.node", "owner.shard")


def _clockwise(nodes: DataFrame, shards: int) -> DataFrame:
    """node, route: the shards in the order in which one meets them clockwise from a node, each once. nodes: node, shard."""
    pairs = nodes.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    of_met = Window.partitionBy("met")
    there = F.when(F.col("shard") == F.col("met"), F.col("node"))
    ahead = F.last(there, ignorenulls=True).over(of_met.orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    far = F.pmod(F.coalesce(ahead, F.min(there).over(of_met)) - F.col("node"), F.lit(SLOTS))
    return pairs.withColumn("far", far).where("far IS NOT NULL").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("far", "met"))).alias("steps")).select("node", F.col("steps.met").alias("route"))


def plan(loads: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """node, first, last, shard, slot_first: rows numbered first to last (excluded) of a node go to shard, from slot_first on.

    loads: node, n. nodes: node, shard. Both have a row a virtual node at most.
    """
    loads = nodes.join(loads, "node", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    of_shard = nodes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads.groupBy("shard").agg(F.sum("n").alias("own")), "shard", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("own").over(everything)
    rank = F.row_number().over(everything.orderBy(F.desc("own"), "shard"))
    capacity = F.floor(total / shards) + (rank <= F.pmod(total, F.lit(shards))).cast("long")
    free = F.greatest(F.lit(0).cast("long"), F.col("capacity") - F.col("own"))
    capacities = of_shard.withColumn("capacity", capacity).withColumn("free", F.sort_array(F.collect_list(F.struct("shard", free.alias("room"))).over(everything)))
    # each shard's own rows, in ring order, as far as they fit
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    own = loads.join(F.broadcast(capacities.drop("own")), "shard").withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
    own = own.withColumn("kept", F.least("n", F.greatest(F.lit(0).cast("long"), F.col("capacity") - F.col("before"))))
    # what is left goes round, node after node; the fold's state is the room of each shard
    left = own.where("kept < n").join(_clockwise(nodes, shards), "node")
    walk = left.agg(F.sort_array(F.collect_list(F.struct("node", "kept", (F.col("n") - F.col("kept")).alias("more"), "route"))).alias("walk"), F.first(F.col("free.room")).alias("room"))

    def step(state: Column, at: Column) -> Column:
        """Fills the shards that have room along the node's route; runs holds (node, first, last, shard)."""
        start = F.struct(state.room.alias("room"), state.runs.alias("runs"), at.kept.alias("done"))

        def fill(acc: Column, shard: Column) -> Column:
            free = F.element_at(acc.room, shard + 1)
            taken = F.least(free, at.kept + at.more - acc.done)
            room = F.transform(acc.room, lambda r, i: F.when(i == shard, r - taken).otherwise(r))
            run = F.struct(at.node.alias("node"), acc.done.alias("first"), (acc.done + taken).alias("last"), shard.alias("shard"))
            return F.when(taken > 0, F.struct(room.alias("room"), F.concat(acc.runs, F.array(run)).alias("runs"), (acc.done + taken).alias("done"))).otherwise(acc)

        return F.aggregate(at.route, start, fill)

    none = F.array().cast("array<struct<node:bigint,first:bigint,last:bigint,shard:int>>")
    onward = walk.select(F.explode(F.aggregate("walk", F.struct(F.col("room").alias("room"), none.alias("runs"), F.lit(0).cast("long").alias("done")), step).runs).alias("run")).select("run.*")
    runs = own.where("kept > 0").select("node", F.lit(0).cast("long").alias("first"), F.col("kept").alias("last"), "shard").unionByName(onward)
    so_far = F.sum(F.col("last") - F.col("first")).over(Window.partitionBy("shard").orderBy("node", "first").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("slot_first", F.coalesce(so_far, F.lit(0).cast("long")))


def numbered(rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows (node, mark, salt and others) with number: 0, 1, ... within each node, by cells; salt tells rows with the same mark apart."""
    total = rows.count()
    cells = max(1, total // (cell_rows * VNODES))
    rows = rows.withColumn("cell", F.pmod("mark", F.lit(cells)))
    counts = rows.groupBy("node", "cell").agg(F.count(F.lit(1)).alias("rows"))
    # at most total / cell_rows cells have so many rows; few do unless one key has them
    large = small_or_shuffled(materialize(counts.where(F.col("rows") > 2 * cell_rows).withColumn("parts", F.ceil(F.col("rows") / cell_rows)).drop("rows"), "shard-large"))
    rows = rows.join(large, ["node", "cell"], "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("salt"), F.col("parts")))).drop("parts")
    parts = rows.groupBy("node", "cell", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("node").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = small_or_shuffled(materialize(parts.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))).drop("rows"), "shard-cells"))
    place = F.row_number().over(Window.partitionBy("node", "cell", "part").orderBy("mark", "salt")) - 1
    return rows.withColumn("place", place).join(starts, ["node", "cell", "part"]).withColumn("number", F.col("start") + F.col("place")).drop("cell", "part", "place", "start")


def assign(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All rows and columns, with shard (0 to shards - 1) and slot (0, 1, ... within the shard): counts differ by one at most.

    The place on the ring is the hash of the key; rows with equal keys (or none) share a place and may still be parted by the
    bound. Rows that agree in all columns get different slots, which of them which is left open; else equal tables get equal
    results, however they are dealt. Null keys count as one key. Fewer rows than shards leave shards empty; an empty
    table gives an empty result. Columns may have any names but shard and slot, which are replaced; their types must be ones that can be hashed.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), ring_slot(F.col(f"`{key}`").cast("string")).alias("slot"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("mark"), F.monotonically_increasing_id().alias("salt"))
    marked = materialize(marked, "shard-rows")
    places = materialize(ring(spark, shards, vnodes), "shard-ring")
    nodes = places.select("node", "shard").distinct()
    on_ring = marked.join(F.broadcast(places.select("slot", "node")), "slot").drop("slot")
    loads = on_ring.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    runs = materialize(plan(loads, nodes, shards), "shard-runs").withColumnRenamed("node", "of")
    found = numbered(on_ring, cell_rows).join(F.broadcast(runs), (F.col("node") == F.col("of")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
    return found.select("row.*", "shard", (F.col("slot_first") + F.col("number") - F.col("first")).alias("slot"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """law rows: the counts of any two shards differ by one at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body()) + 1).cast("long").alias("size"), F.crc32(body().cast("binary")).alias("text_crc32"))
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
