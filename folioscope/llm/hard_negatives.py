"""Hard negatives by bit-sliced integer products.

Each candidate's integer components are cut into bit-planes (two's complement). The score of an anchor with a candidate is a
weighted sum over planes, taken most significant plane first: after some planes, what the rest can still add lies between
the rest's largest value times the anchor's negative and positive components. That interval tightens with every plane; a
candidate is dropped once its interval can't meet any band asked for, or can't reach the k-th best sure one. Scores that come out are whole.

Two passes, the same search: the best k rows of the anchor's own label, without a band; then for each of these positives the best
rows of other labels in the band that its score gives. Rows are dealt to groups of bounded size by a hash of their number; anchors go to every
group (anchors against all rows, in blocks). A task holds one group and streams anchors past it; it returns the best k of
its group for each anchor and band, and windows over anchors keep the best of all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import materialize, table
from folioscope.llm.vectors import common_length, with_integers

ANCHOR_EVERY = 100
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 10
#: A negative's score as a share of the positive's, in percent.
BAND = (30, 90)
#: Rows of a group: at most so many, fewer if there are few rows for the cores.
GROUP_ROWS = 1 << 18
LEAST_GROUP_ROWS = 4096
#: Candidates and anchors whose intervals are computed at once.
CHUNK, BLOCK = 4096, 256
#: Below this share of live pairs the remaining planes are added pair by pair.
SPARSE = 1 / 16
#: Scores stay below this, so that thresholds in percent fit a long.
SCORE_LIMIT = 1 << 55
ALL = np.int64(1) << 62


def planes(x: np.ndarray) -> list[tuple[int, int]]:
    """(bit, weight) of the two's complement planes that x needs, the sign's first."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1, 1).bit_length()
    return [(top, -(1 << top)), *((bit, 1 << bit) for bit in reversed(range(top)))]


def _kth(values: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th largest of the sure values, -ALL if it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -ALL)
    return np.partition(np.where(sure, values, -ALL), -k, axis=1)[:, -k]


def search(anchors: np.ndarray, x: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of every allowed pair whose score may be among the k best of its anchor in some band.

    anchors (m, d) and x (n, d) integers; allowed (m, n); band b of anchor i holds scores from low[i, b] to high[i, b], of which
    those under floor[i, b] aren't wanted. Scores are whole; pairs outside every band are gone, some that aren't among the best may remain.
    """
    kind = np.float32 if int(np.abs(anchors).sum(axis=1).max(initial=0)) < 1 << 24 else np.float64
    factors, live, floor = anchors.astype(kind), allowed.copy(), np.maximum(low, floor)
    up, down = np.clip(anchors, 0, None).sum(axis=1), np.clip(anchors, None, 0).sum(axis=1)
    score = np.zeros(live.shape, dtype=np.int64)
    todo = planes(x)
    while todo and live.mean() > SPARSE:
        bit, weight = todo.pop(0)
        score += weight * (factors @ ((x >> bit) & 1).astype(kind).T).astype(np.int64)
        rest = abs(weight) - 1  # the lower planes add 0 to rest a component
        least, most = score + (rest * down)[:, None], score + (rest * up)[:, None]
        meets = np.zeros_like(live)
        for b in range(low.shape[1]):
            inside = live & (least >= low[:, b, None]) & (most <= high[:, b, None])
            if inside.any():
                floor[:, b] = np.maximum(floor[:, b], _kth(least, inside, k))
            meets |= (most >= floor[:, b, None]) & (least <= high[:, b, None])
        live &= meets
    rows, columns = np.nonzero(live)
    scores = score[rows, columns]
    for bit, weight in todo:
        scores += weight * np.einsum("pd,pd->p", anchors[rows], (x[columns] >> bit) & 1)
        rest = abs(weight) - 1
        least, most = scores + rest * down[rows], scores + rest * up[rows]
        keep = ((most[:, None] >= floor[rows]) & (least[:, None] <= high[rows])).any(axis=1)
        rows, columns, scores = rows[keep], columns[keep], scores[keep]
    return rows, columns, scores


def best(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each key, by falling score, then by id."""
    order = np.lexsort((ids, -scores, keys))
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[rank < k]


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


class Group:
    """Rows of one group, by label."""

    def __init__(self, batches: list[pa.RecordBatch], length: int):
        rows = pa.Table.from_batches(batches).combine_chunks()
        column = {name: rows[name].to_numpy() for name in ("row", "vec_id", "label")}
        order = np.argsort(column["label"], kind="stable")
        self.row, self.vec_id, self.label = (column[name][order] for name in ("row", "vec_id", "label"))
        self.x = _vectors(rows["x"].combine_chunks(), length).astype(np.int32)[order]

    def meet(self, row: np.ndarray, label: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, band, place, score): for each anchor and band the best k of this group, of its own label or of the others."""
        bands = low.shape[1]
        floor = np.full(low.shape, -ALL)
        held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))  # key (anchor * bands + band), place, score
        start, stop = (np.searchsorted(self.label, label.min()), np.searchsorted(self.label, label.max(), "right")) if same else (0, len(self.label))
        for at in range(start, stop, CHUNK):
            part = slice(at, min(at + CHUNK, stop))
            alike = label[:, None] == self.label[None, part]
            allowed = alike & (row[:, None] != self.row[None, part]) if same else ~alike
            rows, columns, scores = search(x, self.x[part], allowed, low, high, floor, k)
            found = [held]
            for b in range(bands):
                fits = (scores >= np.maximum(low, floor)[rows, b]) & (scores <= high[rows, b])
                found.append((rows[fits] * bands + b, columns[fits] + at, scores[fits]))
            keys, places, scores = (np.concatenate(c) for c in zip(*found))
            chosen = best(keys, scores, self.vec_id[places], k)
            held = keys[chosen], places[chosen], scores[chosen]
            full = np.bincount(held[0], minlength=floor.size) >= k
            worst = np.full(floor.size, ALL)
            np.minimum.at(worst, held[0], held[2])
            floor = np.where(full, worst, -ALL).reshape(floor.shape)
        return held[0] // bands, held[0] % bands, held[1], held[2]


def _searcher(length: int, same: bool, k: int):
    """Of rows in order of group and kind (candidates first) the best of each group: anchor, band, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, group = None, [], None
        for batch in batches:
            groups, kinds = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(groups)]):
                piece = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    if number != groups[begin]:
                        number, waiting, group = groups[begin], [], None
                    waiting.append(piece)
                    continue
                if number != groups[begin]:  # no candidates in this group
                    continue
                if waiting:
                    group, waiting = Group(waiting, length), []
                yield from answers(piece, group)

    def answers(piece: pa.RecordBatch, group: Group) -> Iterator[pa.RecordBatch]:
        label = piece.column("label").to_numpy()
        by_label = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[by_label])) + 1 if same else []
        for members in np.split(by_label, cuts):
            for at in range(0, len(members), BLOCK):
                part = piece.take(pa.array(members[at : at + BLOCK]))
                low, high = (np.array(part.column(c).to_pylist(), dtype=np.int64).reshape(len(part), -1) for c in ("low", "high"))
                anchors = part.column("row").to_numpy()
                at_anchor, band, place, score = group.meet(anchors, part.column("label").to_numpy(), _vectors(part.column("x"), length), low, high, same, k)
                yield pa.RecordBatch.from_arrays([pa.array(anchors[at_anchor]), pa.array(band.astype(np.int32)), pa.array(group.vec_id[place]), pa.array(score)], ["anchor", "band", "vec_id", "score"])

    return run


def _search(rows: DataFrame, anchors: DataFrame, groups: int, length: int, same: bool, k: int) -> DataFrame:
    """anchor (its row), band, vec_id, score, rank: the best k rows of each anchor and band. anchors: row, label, x, low, high (arrays, an entry a band)."""
    none = F.lit(None).cast("array<bigint>")
    candidates = rows.select("row", "vec_id", "label", "x", none.alias("low"), none.alias("high"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"))
    asked = anchors.select("row", F.lit(0).cast("long").alias("vec_id"), "label", "x", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"))
    dealt = candidates.unionByName(asked).repartitionById(groups, "group").sortWithinPartitions("group", "kind")
    found = dealt.mapInArrow(_searcher(length, same, k), "anchor long, band int, vec_id long, score long")
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first hard negatives of each anchor and positive.

    Takes no part: a row with a null vec_id or label, with a null vector or one that holds a null, NaN or infinite entry;
    a vector of another length than most (it has no product with them); a vector whose scaled entries are so large that scores
    might pass SCORE_LIMIT (beyond some 90,000 at 64 dimensions). Ties go to the smaller vec_id. Rows that repeat are rows of their own,
    each an anchor, a positive of the other or a negative. Anchors without a row of their label, and positives
    without a negative in the band, give no rows; so does an empty table. Only vec_id, embedding and label are read.
    """
    spark = embeddings.sparkSession
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(LABELS))).otherwise(F.col("label").cast("long"))
    whole = with_integers(embeddings.select("vec_id", "embedding", "label").where("vec_id IS NOT NULL AND label IS NOT NULL"))
    largest = F.array_max(F.transform("x", lambda c: F.abs(c.cast("double"))))
    fits = F.coalesce(largest * largest * F.size("x") < F.lit(float(SCORE_LIMIT)), F.lit(False))
    rows = whole.where(fits).select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), F.transform("x", lambda c: c.cast("int")).alias("x"))
    rows = materialize(rows, "negative-rows")
    length = common_length(rows)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not length:
        return spark.createDataFrame([], shape)
    rows = rows.where(F.size("x") == length)
    cores = spark.sparkContext.defaultParallelism
    total = rows.count()
    groups = max(1, -(-total // min(GROUP_ROWS, max(LEAST_GROUP_ROWS, -(-total // (4 * cores))))))
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    everything = lambda v: F.array(F.lit(int(v)).cast("long"))
    first = _search(rows, anchors.withColumns({"low": everything(-ALL), "high": everything(ALL)}), groups, length, True, positives)
    chosen = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score"))).alias("chosen"))
    # low, high: the whole scores s with band[0] * p <= 100 * s <= band[1] * p
    bound = lambda percent, up: F.transform("chosen", lambda c: (-F.floor(-c.score * percent / F.lit(100).cast("decimal(3,0)")) if up else F.floor(c.score * percent / F.lit(100).cast("decimal(3,0)"))).cast("long"))
    asked = materialize(anchors.withColumnRenamed("row", "anchor").join(chosen, "anchor").withColumns({"low": bound(band[0], True), "high": bound(band[1], False)}).withColumnRenamed("anchor", "row"), "negative-anchors")
    second = _search(rows, asked, groups, length, False, negatives)
    named = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "chosen")
    positive = F.col("chosen")[F.col("band")]
    found = second.withColumnRenamed("vec_id", "negative_id").join(named, "anchor")
    return found.select("anchor_id", positive.positive_id.alias("positive_id"), "rank", "negative_id", positive.score.alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER best AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 10
"""
