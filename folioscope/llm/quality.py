"""Quality scores: random Fourier features, ridge regression by partition sums, isotonic calibration.

STATISTICS describe a text by its bytes, words and lines. Random cosines of the standardised statistics approximate a
Gaussian kernel, so a linear fit over them is a kernel ridge regression. Each task sums the outer products of its rows'
features; the sums of all tasks are the normal equations. Labelled rows that the fit leaves out calibrate its output: the
isotonic step function that fits them best, with straight lines between the middles of its steps.

Labels are only learned from rows that are not held out, from about LABELLED_ROWS of them, which bounds everything that
reaches the driver: TASKS matrices, and one pair of numbers for each calibration row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import body, is_held_out, materialize, table

LABELLED_ROWS = 24_000
#: Cosines, width of the kernel in standard deviations, ridge, tasks that sum, seed.
COSINES, WIDTH, RIDGE, TASKS, SEED = 256, 4.0, 1.0, 8, 20
#: Standardised statistics are cut off here.
FAR = 5.0
#: One labelled row in so many calibrates.
CALIBRATE_ONE_IN = 4
STATISTICS = 22


def _kinds() -> np.ndarray:
    """[256, 9]: which bytes are upper case, lower case, digits, spaces, line ends, sentence marks, brackets and quotes, other signs, beyond ASCII."""
    kinds = np.zeros((256, 9))
    signs = {5: b".,;:!?", 6: b"()[]{}\"'<>", 3: b" \t", 4: b"\n\r\x0b\x0c"}
    for b in range(256):
        c = chr(b)
        kinds[b, next((k for k, s in signs.items() if b in s), 8 if b > 127 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 7)] = 1
    return kinds


KINDS = _kinds()


def statistics(data: bytes) -> np.ndarray:
    """Statistics of a UTF-8 text; an empty text has those of one byte that is none of the kinds."""
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    kinds = histogram @ KINDS / n
    words = data.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    shouted = sum(map(bytes.isupper, distinct)) / max(1, len(distinct))
    repeats = sum(map(bytes.__eq__, words, words[1:])) / w
    share = histogram[histogram > 0] / n
    return np.array(
        [
            *np.sqrt(kinds),
            np.sqrt(histogram[33] / n),
            np.log1p(len(data)),
            np.log1p(len(words)),
            lengths.mean(),
            np.log1p(lengths.std()),
            np.log1p(lengths.max()),
            (1 - len(distinct) / w) / np.log(w + 10) * 5,
            shouted,
            np.sqrt(repeats),
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(len(words) / max(1, len(lines))),
            -(share * np.log2(share)).sum(),
            np.sqrt(max(0, histogram[124] + histogram[42] + histogram[35] + histogram[36] + histogram[37] + histogram[38]) / n),
        ]
    )


def cosines(x: np.ndarray, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, with a constant."""
    random = np.random.default_rng(SEED)
    frequencies, phases = random.normal(0, 1 / WIDTH, (STATISTICS, COSINES)), random.uniform(0, 2 * np.pi, COSINES)
    z = np.clip((x - center) / spread, -FAR, FAR)
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / COSINES) * np.cos(z @ frequencies + phases)])


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (raw, probability) of the best non-decreasing fit: pool adjacent violators; each pool is smoothed by one row of the mean."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of raw, sum of label, rows
    for x, y in zip(raw[order], label[order]):
        pools.append([x, y, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    mean = label.mean()
    points = np.array([(s / n, (y + mean) / (n + 1)) for s, y, n in pools])
    return points[:, 0], np.maximum.accumulate(points[:, 1])


class Scorer:
    """Center and spread of the statistics, weights of the cosines, calibration points."""

    def __init__(self, center, spread, weights, at, probability):
        self.center, self.spread, self.weights, self.at, self.probability = center, spread, weights, at, probability

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cosines(x, self.center, self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; beyond the outer points, and on level steps, raw output still tells rows apart a little."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.at, self.probability) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def _arrays(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return np.array(batch.column(column).flatten()).reshape(-1, STATISTICS)


def labelled_statistics(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """x (array), label, calibrates of about so many labelled rows that are not held out, chosen by a hash of doc_id.

    A doc_id with several labels has the largest. The ids are broadcast: rows bounds them.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    chosen = docs.select("doc_id", body().cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(CALIBRATE_ONE_IN)) == 0

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "label", "calibrates"])

    return chosen.select("text", "label", calibrates.alias("calibrates")).mapInArrow(run, "x array<double>, label int, calibrates boolean")


def _summed(rows: DataFrame, of) -> np.ndarray | None:
    """of(x, label) summed over all rows, task by task."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_arrays(batch), batch.column(1).to_numpy().astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = [np.frombuffer(r.sums) for r in rows.select("x", "label").coalesce(TASKS).mapInArrow(run, "sums binary").collect()]
    return np.sum(sums, axis=0) if sums else None


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from docs (doc_id, text) and labels (doc_id, quality).

    Without labelled rows of both kinds the calibration is a level line at the share of good rows, 0.5 if there are none.
    """
    rows = materialize(labelled_statistics(docs, labels), "quality-rows")
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if moments is None or not 0 < moments[1] < moments[0]:
        level = 0.5 if moments is None else float(moments[1] / moments[0])
        return Scorer(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(COSINES + 1), np.array([0.0]), np.array([level]))
    n = moments[0]
    center = moments[2 : 2 + STATISTICS] / n
    spread = np.sqrt(np.maximum(moments[2 + STATISTICS :] / n - center**2, 0)) + 1e-6

    def equations(x, y):
        z = cosines(x, center, spread)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]]).reshape(-1)

    kept_out = rows.where("calibrates").select("x", "label").collect()
    fitted = _summed(rows.where("NOT calibrates"), equations)
    if fitted is None or not kept_out:
        fitted = _summed(rows, equations)
        kept_out = rows.select("x", "label").collect()
    a = fitted.reshape(COSINES + 1, COSINES + 2)
    weights = np.linalg.solve(a[:, :-1] + RIDGE * np.eye(COSINES + 1), a[:, -1])
    scorer = Scorer(center, spread, weights, None, None)
    label = np.array([float(r.label) for r in kept_out])
    scorer.at, scorer.probability = isotonic(scorer.raw(np.array([r.x for r in kept_out])), label)
    return scorer


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Whole texts are read; a null text is empty, and empty texts get the score of their statistics. Rows without a doc_id
    are not held out and never learned from. Repeated rows get equal scores. Only doc_id and text of docs and doc_id and
    quality of labels are read; empty tables give empty results.
    """
    scorer = train(docs, labels)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = scorer.score(np.array([statistics(t) for t in batch.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", is_held_out().alias("held_out"), body().cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
