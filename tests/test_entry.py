"""The registered queries run on the smallest tables, with stable columns."""

import os

import pytest

import __spark_entry__ as entry
from folioscope.operators import select
from folioscope.plans import queries as plans

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one_text(spark, tmp_path):
    """Documents of 40 lines, some 2,600 characters, each line with words of its own."""
    lines = lambda d: "\n".join(f"line {n} of text {d} ends with word{d}x{n} after a few more plain words" for n in range(40))
    rows = [(d, lines(d) + "!" * d) for d in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return dict(rows)


def test_whole_texts_reach_the_operators(spark, tmp_path):
    of = one_text(spark, tmp_path)
    assert {r.doc_id: r.text for r in plans.QUERIES["merge_bands"](spark, str(tmp_path)).collect()} == of
    for name in ("best_attempt", "best_attempt_tiered", "best_attempt_suspected", "cascade_best"):
        got = {r.doc_id: r.text for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == set(of)
        filled = {d: t for d, t in got.items() if t}
        assert len(filled) > 45
        assert all(len(t) > 0.6 * len(of[d]) and "39" in t[-160:] for d, t in filled.items()), name


def test_suspicious_whole_texts_yield(spark, tmp_path):
    runaway = "\n".join("the same few words " * 30 + str(n) for n in range(9))
    spark.createDataFrame([(d, f"{d} {runaway}") for d in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = select.judged(plans.raw_attempts(spark, str(tmp_path)), suspicion=True).where("text <> '' AND idx = 2").select("suspicious", "score").distinct().collect()
    assert rows and all(r.suspicious and r.score == 0.0 for r in rows)


def test_small_tables_are_spread(spark):
    small = plans.spread(spark.range(100, numPartitions=1), "id")
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=64)
    assert plans.spread(many, "id") is many
