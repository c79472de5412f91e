import random

from pyspark.sql import functions as F

from folioscope.functions import distance


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_edit_distance_properties():
    r = random.Random(3)
    for _ in range(1500):
        a, b, c = ("".join(r.choices("abcé🙂", k=r.randint(0, 70 if r.random() < 0.1 else 12))) for _ in range(3))
        d = distance.edit_distance(a, b)
        assert d == plain(a, b) == distance.edit_distance(b, a)
        assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))
        assert d <= distance.edit_distance(a, c) + distance.edit_distance(c, b)
        assert (d == 0) == (a == b)


def test_tokens():
    assert distance.edit_distance("a b c".split(), "a c".split()) == 1


def test_metrics(spark):
    rows = [("abc", "abd"), ("", "x"), ("", ""), ("a", "a b c d"), (None, None), ("x y", "")]
    got = distance.with_metrics(spark.createDataFrame(rows, "r string, h string"), "r", "h").collect()
    assert [(g.cer, g.wer) for g in got] == [(1 / 3, 1.0), (1.0, 1.0), (0.0, 0.0), (6.0, 3.0), (0.0, 0.0), (1.0, 1.0)]
    assert [g.char_distance for g in got] == [1, 1, 0, 6, 0, 3]


def test_round3_is_exact(spark):
    values = [1.0005, 0.0025, 2.6755, 48.23 / 4, -1.0, None]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(distance.round3("v").alias("x")).collect()]
    assert got == [round(max(0.0, v), 3) if v is not None else None for v in values]


def test_builtin_agrees(spark):
    r = random.Random(4)
    rows = [("".join(r.choices("abé", k=9)), "".join(r.choices("abé", k=7))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select(distance.char_distance("a", "b").alias("x"), F.levenshtein("a", "b").alias("y")).collect()
    assert all(g.x == g.y for g in got)
