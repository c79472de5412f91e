"""Distances by tiles equal those of the plain function."""

import random

import numpy as np
import pytest

from folioscope.functions.distance import edit_distance
from folioscope.operators import long_distance
from folioscope.sources import sinks


def edited(r, text, n, alphabet):
    for _ in range(n):
        i = r.randrange(len(text) + 1)
        text = text[:i] + r.choice(["", r.choice(alphabet)]) + text[i + r.randrange(2) :]
    return text


def plain_matrix(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        rows.append([i + 1])
        for j, y in enumerate(b):
            rows[-1].append(min(rows[-2][j] + (x != y), rows[-2][j + 1] + 1, rows[-1][j] + 1))
    return rows


@pytest.mark.parametrize("seed", range(20))
def test_a_tile_inside_the_matrix(seed):
    """A tile cut out of a whole matrix gets its edges from there and must give the edges that are there."""
    r = random.Random(seed)
    a, b = ([r.randrange(3) for _ in range(r.randint(12, 30))] for _ in range(2))
    whole = plain_matrix(a, b)
    top, left = r.randrange(len(a) - 5), r.randrange(len(b) - 5)
    low, right = r.randint(top + 1, len(a)), r.randint(left + 1, len(b))
    bits = lambda j, d: sum(1 << k for k, i in enumerate(range(top, low)) if whole[i + 1][j] - whole[i][j] == d)
    edge = lambda i: bytes(1 + whole[i][j + 1] - whole[i][j] for j in range(left, right))
    got = long_distance.tile(np.array(a[top:low], "<i4"), np.array(b[left:right], "<i4"), bits(left, 1), bits(left, -1), edge(top))
    assert got == (bits(right, 1), bits(right, -1), edge(low))


def pairs():
    r = random.Random(31)
    out = [(None, None), ("", "abc"), ("abc", None), ("same" * 100, "same" * 100), ("a" * 140, "b" * 120), ("é🙂漢" * 50, "é🙂x" * 45)]
    for _ in range(30):
        alphabet = r.choice(["ab", "abcdefgh ", "aé🙂 "])
        a = "".join(r.choices(alphabet, k=r.randint(0, 180)))
        out.append((a, edited(r, a, r.choice([0, 3, 40]), alphabet) if r.random() < 0.6 else "".join(r.choices(alphabet, k=r.randint(0, 180)))))
    return out


@pytest.mark.parametrize("size", [35])
def test_distances_by_tiles(spark, size):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs())]
    got = long_distance.edit_distances(spark.createDataFrame(rows, "id long, a string, b string").repartition(3), sinks.written, size=size).collect()
    assert sorted((g.id, g.distance) for g in got) == [(i, edit_distance(a or "", b or "")) for i, a, b in rows]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_word_distances_by_tiles(spark):
    r = random.Random(32)
    rows = [(i, " ".join(r.choices("one two three four five".split(), k=r.randint(0, 200))), "\n".join(r.choices("one two three six".split(), k=r.randint(0, 200)))) for i in range(12)]
    got = long_distance.edit_distances(spark.createDataFrame(rows, "id long, a string, b string"), sinks.written, words=True, size=60).collect()
    assert sorted((g.id, g.distance) for g in got) == [(i, edit_distance(a.split(), b.split())) for i, a, b in rows]


def test_a_long_pair_beside_short_ones(spark):
    """A nearly equal long pair takes tiles along the diagonal only; short pairs are done at once."""
    r = random.Random(33)
    a = "".join(r.choices("abcdefghij ", k=40_000))
    b = edited(r, a, 300, "abcdefghij ")
    rows = [(0, "x" + a + "y", "u" + b + "v")] + [(i, a[i : i + 30], a[i + 2 : i + 33]) for i in range(1, 2000)]
    seen = []

    def write(df, name):
        out = sinks.written(df, name)
        seen.append((name, out.where("kind = 'south' OR kind = 'done'").count() if "ended" not in name else 0))
        return out

    got = {g.id: g.distance for g in long_distance.edit_distances(spark.createDataFrame(rows, "id long, a string, b string"), write, size=4096).collect()}
    assert got == {i: edit_distance(a, b) for i, a, b in rows}
    tiles = sum(n for name, n in seen if name not in ("distance-opening", "distance-ended"))
    assert tiles < 10 * 6  # of 10 x 10


def test_tiles_are_dealt_to_all_tasks(spark):
    """Of a pair without likeness all tiles are worked out, those of one anti-diagonal by several tasks."""
    r = random.Random(34)
    a, b = ("".join(r.choices("abcdefghij", k=1500)) for _ in range(2))
    tasks = []

    def write(df, name):
        out = sinks.written(df, name)
        tasks.append(len(out.inputFiles()) if name.startswith("distance-") and name.split("-")[1].isdigit() else 0)
        return out

    (got,) = long_distance.edit_distances(spark.createDataFrame([(7, a, b)], "id long, a string, b string"), write, size=250).collect()
    assert got.distance == edit_distance(a, b) and max(tasks) >= 3


def test_metrics_of_long_pairs(spark):
    """Rows above the limit go by tiles, others as always; the figures are the same."""
    from folioscope.functions.distance import with_metrics
    from folioscope.operators import evaluate

    r = random.Random(35)
    rows = [(i, f"m{i}", " ".join(r.choices("one two three".split(), k=n)), " ".join(r.choices("one two four".split(), k=n))) for i, n in enumerate([0, 3, 9, 40, 60])]
    df = spark.createDataFrame(rows, "doc int, id string, ref string, hyp string")
    plain = with_metrics(df, "ref", "hyp")
    got = evaluate.rated(df, "ref", "hyp", sinks.written, 100)
    assert got.columns == plain.columns and sorted(got.collect()) == sorted(plain.collect())
