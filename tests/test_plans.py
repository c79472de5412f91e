"""What plans must keep: filters that reach the scan, columns that aren't read."""

import re

from pyspark.sql import functions as F

from folioscope.operators import standardize


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def raw_pages(spark, tmp_path):
    rows = [("d1", f"m{i % 3}", str(i), i, f"Téxt  {i}\r\n", "web" if i % 2 else "scan") for i in range(30)]
    spark.createDataFrame(rows, "doc string, model string, page string, ord int, text string, source string").write.parquet(f"{tmp_path}/raw")
    return spark.read.parquet(f"{tmp_path}/raw")


def test_filters_pass_below_normalisation(spark, tmp_path):
    pages = standardize.standardize_pages(raw_pages(spark, tmp_path))
    found = pages.where("source = 'web' AND model = 'm1'").select("page", "text", "text_for_cer_wer")
    plan = plan_of(found)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "EqualTo(source,web)" in pushed and "EqualTo(model,m1)" in pushed
    assert sorted(r.text for r in found.collect()) == sorted(f"Téxt {i}" for i in range(30) if i % 2 and i % 3 == 1)


def test_page_numbers_are_filtered_before_normalisation(spark, tmp_path):
    plan = plan_of(standardize.standardize_pages(raw_pages(spark, tmp_path)).where("page = 3").select("text"))
    # the filter on the number is nearer to the scan than the Python step of the text
    assert "try_cast" in plan or "cast(page" in plan
    assert plan.index("ArrowEvalPython") < plan.index("Filter ")


def test_texts_that_nobody_asks_for_are_not_read(spark, tmp_path):
    plan = plan_of(standardize.standardize_pages(raw_pages(spark, tmp_path)).select("doc", "page"))
    assert "text" not in re.search(r"ReadSchema: (\S+)", plan).group(1) and "ArrowEvalPython" not in plan


def test_normalised_texts_can_be_aggregated(spark, tmp_path):
    pages = standardize.standardize_pages(raw_pages(spark, tmp_path))
    assert pages.groupBy("model").agg(F.max(F.length("text")).alias("n")).count() == 3
