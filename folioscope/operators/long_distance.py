"""Edit distance of pairs too long for one task: the matrix is cut into tiles, and tiles of one anti-diagonal run side by side.

A tile needs what its left and its upper neighbour leave: the vertical differences of its left edge (two bit vectors), the
horizontal ones of its upper edge (a byte a column), and the value at its corner. These travel as rows: one goes east with the block of a, one
south with the block of b; where two meet, their task works the tile out, bit-parallel, and sends on two more. One job an anti-diagonal
moves all pairs at once; its rows are written to the shared scratch folder, so a lost executor costs one step.

Only tiles near the diagonal are worked out at first. Beyond the band values are taken to grow by one a cell, which is never too little;
so a result that isn't above the band's width is exact, and else the band doubles. Texts that are nearly alike cost a few tiles a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.distance import edit_distance

#: Symbols of a tile's side. Pairs whose matrix is smaller than LONG tiles are worked out whole.
TILE, LONG = 1 << 16, 2
SCHEMA = "id long, down int, across int, downs int, acrosses int, band int, kind string, block binary, first binary, second binary, corner long"
_FIELDS = ("id", "down", "across", "downs", "acrosses", "band", "kind", "block", "first", "second", "corner")
_TYPES = (pa.int64(), *[pa.int32()] * 5, pa.string(), *[pa.binary()] * 3, pa.int64())


def codes(text: str | None, words: bool, known: dict) -> np.ndarray:
    """Numbers of a text's characters, or of its words: equal words of one pair have one number."""
    if words:
        return np.array([known.setdefault(w, len(known)) for w in (text or "").split()], "<i4")
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<i4")


def _inner(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common ends."""
    n = min(len(a), len(b))
    start = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b, n = a[start:], b[start:], n - start
    tail = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    return a[: len(a) - tail], b[: len(b) - tail]


def tile(a: np.ndarray, b: np.ndarray, grows: int, shrinks: int, above: bytes) -> tuple[int, int, bytes]:
    """The right edge (bits of rows that grow and that shrink) and the lower edge (1 and a difference a column) of a tile from its left and upper edges."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full, top, below = (1 << len(a)) - 1, len(a) - 1, bytearray(len(b))
    for j, x in enumerate(b.tolist()):
        same, step = where.get(x, 0), above[j]
        vertical = same | shrinks
        if step == 0:
            same |= 1
        level = (((same & grows) + grows) ^ grows) | same
        more, less = shrinks | ~(level | grows) & full, grows & level
        below[j] = 1 + (more >> top & 1) - (less >> top & 1)
        more, less = more << 1 & full | (step == 2), less << 1 & full | (step == 0)
        grows, shrinks = less | ~(vertical | more) & full, more & vertical
    return grows, shrinks, bytes(below)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], list(_FIELDS))


def _message(id_: int, down: int, across: int, shape: tuple, kind: str, block: np.ndarray | None = None, first: bytes | None = None, second: bytes | None = None, corner: int | None = None) -> tuple:
    return (id_, down, across, *shape, kind, None if block is None else block.tobytes(), first, second, corner)


def _opening(size: int, words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs (id, a, b, band or null): the distance of a short one (kind done), else the rows that enter the band from its borders."""

    def entering(id_: int, a: np.ndarray, b: np.ndarray, band: int | None) -> Iterator[tuple]:
        downs, acrosses = -(-len(a) // size), -(-len(b) // size)
        band = band or abs(downs - acrosses) + 1
        shape = (downs, acrosses, band)
        for r in range(downs):
            block, n = a[r * size : (r + 1) * size], min(size, len(a) - r * size)
            first = max(0, r - band)
            ones = ((1 << n) - 1).to_bytes(-(-n // 8), "little")
            yield _message(id_, r, first, shape, "east", block, ones, b"", r * size if first == 0 else None)
        for c in range(acrosses):
            block = b[c * size : (c + 1) * size]
            first = max(0, c - band)
            yield _message(id_, first, c, shape, "south", block, b"\x02" * len(block), None, c * size if first == 0 else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, a, b, band in zip(*[batch.column(c).to_pylist() for c in ("id", "a", "b", "band")]):
                known: dict = {}
                a, b = _inner(codes(a, words, known), codes(b, words, known))
                if min(len(a), len(b)) == 0 or len(a) * len(b) <= LONG * size * size:
                    yield _batch([_message(id_, 0, 0, (0, 0, 0), "done", corner=edit_distance(a.tolist(), b.tolist()))])
                    continue
                rows, held = [], 0
                for row in entering(id_, a, b, band):
                    rows.append(row)
                    held += len(row[7]) * 2
                    if held > 1 << 24:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of id, down, across, kind: of each tile the one going east, then the one going south."""
    east = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == "east":
                east = row
                continue
            south = row
            id_, r, c, shape = south["id"], south["down"], south["across"], (south["downs"], south["acrosses"], south["band"])
            a, b = np.frombuffer(east["block"], "<i4"), np.frombuffer(south["block"], "<i4")
            corner = south["corner"] if east["corner"] is None else east["corner"]
            grows, shrinks = (int.from_bytes(east[k] or b"", "little") for k in ("first", "second"))
            upper_right = corner + sum(south["first"]) - len(b)
            lower_left = corner + grows.bit_count() - shrinks.bit_count()
            grows, shrinks, below = tile(a, b, grows, shrinks, south["first"])
            out = []
            if (r, c) == (shape[0] - 1, shape[1] - 1):
                out.append(_message(id_, r, c, shape, "done", corner=lower_left + sum(below) - len(b)))
            width = -(-len(a) // 8)
            if c + 1 < shape[1] and abs(r - c - 1) <= shape[2]:
                out.append(_message(id_, r, c + 1, shape, "east", a, grows.to_bytes(width, "little"), shrinks.to_bytes(width, "little"), upper_right))
            if r + 1 < shape[0] and abs(r + 1 - c) <= shape[2]:
                out.append(_message(id_, r + 1, c, shape, "south", b, below, None, lower_left))
            if out:
                yield _batch(out)


def _small_batches(spark: SparkSession, rows: int = 16):
    """Rows hold blocks of texts, so that few of them go to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    return lambda: spark.conf.set(key, before)


def edit_distances(pairs: DataFrame, write: Callable[[DataFrame, str], DataFrame], words: bool = False, size: int = TILE) -> DataFrame:
    """id, distance of pairs (id, a, b), ids being different; null texts are empty. words: of their words instead of characters.

    write(df, name) must materialize df, as sinks.written does. A run of jobs for as many anti-diagonals as the longest pair has; short pairs are done in the first one.
    """
    spark = pairs.sparkSession
    restore = _small_batches(spark)
    try:
        todo, found = pairs.select("id", "a", "b", F.lit(None).cast("int").alias("band")), []
        while True:
            waiting = write(todo.mapInArrow(_opening(size, words), SCHEMA), "distance-opening")
            last = waiting.agg(F.max(F.col("downs") + F.col("acrosses")).alias("n")).first().n or 0
            done, moving = [waiting.where("kind = 'done'")], None
            for step in range(max(0, last - 1)):
                here = waiting.where((F.col("kind") != "done") & (F.col("down") + F.col("across") == step))
                rows = here if moving is None else here.unionByName(moving.where("kind <> 'done'"))
                # a number of its own: the tiles of a step are few bytes, and must not be put together for that
                met = rows.repartition(2 * spark.sparkContext.defaultParallelism, "id", "down", "across").sortWithinPartitions("id", "down", "across", "kind")
                moving = write(met.mapInArrow(_meet, SCHEMA), f"distance-{step}")
                done.append(moving.where("kind = 'done'"))
            ended = reduce(DataFrame.unionByName, done).select("id", F.col("corner").alias("distance"), "downs", "acrosses", "band")
            exact = (F.col("distance") <= F.col("band") * F.lit(size)) | (F.col("band") >= F.greatest("downs", "acrosses"))
            ended = write(ended.withColumn("exact", exact), "distance-ended")
            found.append(ended.where("exact").select("id", "distance"))
            wider = ended.where("NOT exact").select("id", (F.col("band") * 2).alias("band"))
            if wider.isEmpty():
                return reduce(DataFrame.unionByName, found)
            todo = pairs.select("id", "a", "b").join(wider, "id")
    finally:
        restore()
