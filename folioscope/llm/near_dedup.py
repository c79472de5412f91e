"""Near-duplicate documents by HyperMinHash sketches, confirmed on full shingle sets.

A document's set is its distinct word shingles. Each of REGISTERS buckets orders the shingles by a multiplication of its
own and keeps the least value as a compressed register: the count of leading zeros and the MANTISSA bits that follow the
first one. Rows of equal sets are one class, so copies are never paired. Classes that agree in a band of registers
share a bucket; at a similarity of 0.8 a pair misses all bands once in ten million.

Buckets are not expanded into pairs. First each bucket names a hub, the member whose buckets are the largest (in a group
of copies that is the one they were made from), and members are paired with it. Pairs whose estimated similarity (share
of equal registers, corrected for registers that agree by chance) lies far below the threshold go; the others are
confirmed on their full sets, and links become components. Then only buckets that still hold several components are
looked at again: their members meet in blocks of bounded size, where sketches of different components are compared in
numpy, each pair in its first common band alone. The full sets of those that the estimate lets through meet once more in
their block and are compared there. So no link between components is lost, and pairs never become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.shared import body, kept, materialize, small_or_shuffled, table

#: Words in a shingle and least similarity in per cent, unless a query says otherwise.
WIDTH, PERCENT = 5, 80
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Pairs estimated this many standard errors below the threshold are not confirmed.
ERRORS = 5.0
#: Members of a bucket that meet in one block; shingles sketched at once.
BLOCK, CHUNK = 512, 400_000
WORDS_KEPT = 150_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole sequence if it has fewer words; none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = kept("near_dedup").setdefault("words", {})
    try:
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > WORDS_KEPT:
            known.clear()
        known.update((x, xxhash.xxh3_64_intdigest(x)) for x in set(words).difference(known))
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        h = mixed(h * _GOLD + w[j : len(w) - size + 1 + j])
    return np.unique(h)


def multipliers() -> np.ndarray:
    return mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 [sets, REGISTERS] of non-empty sets: leading zeros, then MANTISSA bits."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for k, by in enumerate(multipliers()):
        least[:, k] = np.minimum.reduceat(flat * by, at)
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64))), 0, 63).astype(np.uint64)
    rest = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | rest).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """int64 [sets, BANDS]."""
    parts = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]) * _GOLD
    for j in range(ROWS):
        key = mixed(key + parts[:, :, j] * _GOLD)
    return key.view(np.int64)


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that the registers of different minima of sets of n and m shingles agree."""
    l = np.arange(64, dtype=np.float64)  # noqa: E741
    share = lambda size: (1 - 2.0 ** -(l + 1)) ** size[..., None] - (1 - 2.0**-l) ** size[..., None]
    return (share(np.asarray(n, np.float64)) * share(np.asarray(m, np.float64))).sum(-1) / 2**MANTISSA


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance."""
    chance = chance_agreement(n, m)
    return (agree - chance) / (1 - chance)


def floor_of(percent: int) -> float:
    j = percent / 100
    return j - ERRORS * (j * (1 - j) / REGISTERS) ** 0.5


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, set_key (128 bits), sketch (registers; null for an empty set) of each row."""

    def run(batches):
        import xxhash

        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < len(texts):
                sets, size, start = [], 0, at
                while at < len(texts) and (not sets or size < CHUNK):
                    sets.append(shingle_set(texts[at].as_py(), width))
                    size += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                found = iter(registers_of(full) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[start:at],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                        pa.array([next(found).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n", "set_key", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, set_key binary, sketch binary")


def bands_of(classes: DataFrame) -> DataFrame:
    """key, band, cid: a row for each band of each class."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS))
                bands = np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(bands), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], ["key", "band", "cid"])

    return classes.select("cid", "sketch").mapInArrow(run, "key long, band int, cid long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose estimate does not rule it out."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
                found = estimate((x == y).mean(1), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= floor_of(percent)
                yield batch.select(["a", "b"]).filter(pa.array(found))

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles (the sorted set, binary) of the rows of docs whose doc_id is in ids."""
    ids = small_or_shuffled(materialize(ids, "near-ids"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).join(ids, "doc_id", "left_semi")
    return materialize(rows.mapInArrow(run, "doc_id long, shingles binary"), "near-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids that are similar by their full sets; pairs must be materialized."""
    full = full_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), width)
    for side in "ab":
        pairs = pairs.join(full.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"of_{side}")), side)

    def compare(batches):
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                similar.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a bucket (key, band, cid, members) with the bucket's hub."""
    reach = buckets.groupBy("cid").agg(F.sum("members").alias("reach"))
    hubs = buckets.join(reach, "cid").groupBy("key").agg(F.max(F.struct("reach", (-F.col("cid")).alias("minus"))).alias("top"))
    paired = buckets.join(hubs.select("key", (-F.col("top.minus")).alias("hub")), "key").where("cid <> hub")
    return paired.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()


def block_rows(buckets: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The members of likely pairs that share a bucket but no component: part, block, cid, component, partners (array of cids).

    A block is two slices of a bucket, or one with itself, of some BLOCK members each; a pair is found in its first common band alone.
    The blocks of a bucket are dealt to tasks in turn, so a bucket that holds a third of all members loads all tasks alike.
    """
    rows = buckets.join(labels, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid")).drop("node")
    rows = materialize(rows, "near-labelled")
    split = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rows = rows.join(split, "key", "left_semi").join(classes.select("cid", "n", "sketch"), "cid")
    slices = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cid"), slices).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "band", "cid", "component", "n", "sketch")
    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.xxhash64("key"), F.lit(parts)) + F.expr("CAST(j AS BIGINT) * (j + 1) div 2 + i")
    rows = rows.withColumn("part", F.pmod(turn, F.lit(parts)).cast("int"))
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(lambda batches: (made for t in groups(batches, ("key", "i", "j")) for made in likely_in_block(t, percent)), BLOCK_ROWS)


BLOCK_ROWS = "part int, block long, cid long, component long, partners array<long>"


def groups(batches, by: tuple[str, ...]):
    """Tables of the rows that agree in integer columns by, from batches sorted by them."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not t.num_rows:
            continue
        names = np.stack([t.column(c).to_numpy().astype(np.int64) for c in by])
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
        for x, y in zip(cuts[:-2], cuts[1:-1]):
            yield t.slice(x, y - x)
        held = t.slice(cuts[-2])
    if held is not None:
        yield held


def likely_in_block(t: pa.Table, percent: int):
    """BLOCK_ROWS of one block of rows (key, i, j, mine, band, cid, component, n, sketch)."""
    cid, component, n, mine = (t.column(c).to_numpy() for c in ("cid", "component", "n", "mine"))
    if len(cid) < 2 or (component == component[0]).all():
        return
    key, i, j, band = (t.column(c)[0].as_py() for c in ("key", "i", "j", "band"))
    regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    partners: dict[int, list[int]] = {}
    for x in range(len(cid) - 1):
        rest = slice(x + 1, None)
        able = (component[rest] != component[x]) & (np.minimum(n[rest], n[x]) * 100 >= np.maximum(n[rest], n[x]) * percent)
        if i != j:
            able &= mine[rest] != mine[x]
        y = np.flatnonzero(able) + x + 1
        same = regs[y] == regs[x]
        agree = same.mean(1) if len(y) else np.empty(0)
        near = agree >= floor_of(percent)  # the corrected estimate is lower still
        y, same, agree = y[near], same[near], agree[near]
        if not len(y):
            continue
        first = same.reshape(len(y), BANDS, ROWS).all(2).argmax(1) == band
        good = y[first & (estimate(agree, n[y], np.full(len(y), n[x])) >= floor_of(percent))]
        if len(good):
            partners.setdefault(x, []).extend(cid[good].tolist())
            for k in good.tolist():
                partners.setdefault(k, [])
    if partners:
        block = int(mixed(np.array([key], np.int64).view(np.uint64) * _GOLD + np.uint64(i << 32 | j)).view(np.int64)[0])
        at = list(partners)
        yield pa.RecordBatch.from_arrays([pa.array(t.column("part").to_pylist()[:1] * len(at), pa.int32()), pa.array([block] * len(at)), pa.array(cid[at]), pa.array(component[at]), pa.array(list(partners.values()), pa.list_(pa.int64()))], ["part", "block", "cid", "component", "partners"])


def block_links(rows: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that hold on the full sets among the partners of each block of rows; rows must be materialized.

    The sets of a block's members meet in one task, so pairs need no rows of their own; a pair whose components another
    link of the block has joined is not looked at.
    """
    full = full_sets(docs, rows.select(F.col("cid").alias("doc_id")).distinct(), width)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.join(full.withColumnRenamed("doc_id", "cid"), "cid").repartitionById(parts, F.col("part")).sortWithinPartitions("block")

    def run(batches):
        for t in groups(batches, ("block",)):
            cids, components, partners = (t.column(c).to_pylist() for c in ("cid", "component", "partners"))
            sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
            numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
            cuts = np.cumsum([len(s) for s in sets])[:-1]
            place, numbered = {c: k for k, c in enumerate(cids)}, np.split(numbers, cuts)
            joined = {c: c for c in components}

            def top(c, joined=joined):
                while joined[c] != c:
                    joined[c] = c = joined[joined[c]]
                return c

            here, found = np.zeros(int(numbers.max()) + 1, bool), []
            for x, others in enumerate(partners):
                if not others:
                    continue
                here[numbered[x]] = True
                for y in map(place.__getitem__, others):
                    a, b = top(components[x]), top(components[y])
                    if a != b:
                        common = int(np.count_nonzero(here[numbered[y]]))
                        if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                            joined[a] = b
                            found.append((cids[x], cids[y]))
                here[numbered[x]] = False
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return met.select("block", "cid", "component", "partners", "shingles").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z in lower case; a set is the distinct runs of width words, or the whole
    sequence of a shorter text. Null texts and texts without words have empty sets and are linked with nothing. Rows are
    linked if intersection / union is at least percent / 100; component_id is the smallest doc_id that can be
    reached, kept is doc_id = component_id. Rows that share a doc_id are one node. A row without a doc_id has no component and is kept.
    Whole texts count, however long. Empty tables give empty results; only doc_id and text are read.
    """
    rows = materialize(sketched(docs, width), "near-sketches")
    usable = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("top"))
    classes = materialize(classes.select("set_key", F.col("top.doc_id").alias("cid"), F.col("top.n").alias("n"), F.col("top.sketch").alias("sketch")), "near-classes")
    bands = bands_of(classes)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = materialize(bands.join(shared, "key"), "near-buckets")
    first = materialize(likely(hub_pairs(buckets), classes, percent), "near-pairs")
    links = materialize(confirmed(first, docs, width, percent), "near-links")
    labels = connected_components(links)
    second = materialize(block_rows(buckets, labels, classes, percent), "near-blocks")
    if not second.isEmpty():
        further = materialize(block_links(second, docs, width, percent), "near-links")
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = connected_components(stars.union(further))
    found = rows.join(classes.select("set_key", "cid"), "set_key", "left").join(labels, F.col("cid") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "cid"))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that near_groups keeps: one document of each group."""
    dropped = near_groups(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    dropped = small_or_shuffled(materialize(dropped, "near-dropped"))
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["dropped_id"]), "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=4)
