"""Registered queries of image filters. The tables hold no images, so each document's bytes are taken as a gray image of IMAGE_WIDTH pixels a row."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import pixels
from folioscope.operators import images
from folioscope.plans.queries import query, spread, table

IMAGE_WIDTH = 64
BAND = 40


def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    height, data = images.image_of_text(F.col("text"), IMAGE_WIDTH)
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.lit(IMAGE_WIDTH).alias("width"), height.alias("height"), data.alias("pixels"))


@F.pandas_udf(T.StructType().add("mean", "double").add("digest", "string"))
def _digest(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"mean": [np.frombuffer(d, np.uint8).mean() if d else None for d in data], "digest": [hashlib.sha256(d).hexdigest() for d in data]})


@query()
def preprocessed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on every document's image: mean and digest of the pixels."""
    made = images.preprocessed(document_images(spark, sf_dir)).withColumn("of", _digest("pixels"))
    return made.select("doc_id", "width", "height", "filtered", "of.mean", "of.digest")


SQL_HEX = f"""
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, greatest(1, ceil(length(x) / 2.0 / {IMAGE_WIDTH})::INT) AS height FROM b),
i AS (SELECT doc_id, height, rpad(x, height * {IMAGE_WIDTH * 2}, '20') AS x FROM s)"""


@F.pandas_udf(T.StructType().add("low", "integer").add("high", "integer").add("total", "long"))
def _stretched(data: pd.Series) -> pd.DataFrame:
    rows = []
    for d in data:
        image = np.frombuffer(d, np.uint8).reshape(-1, IMAGE_WIDTH)
        rows.append((*pixels.contrast_bounds(image), int(pixels.contrast(pixels.autocontrast(image)).sum(dtype=np.int64))))
    return pd.DataFrame(rows, columns=["low", "high", "total"])


@query(f"""
WITH {SQL_HEX},
p AS (SELECT doc_id, ('0x' || x)::INT AS v FROM (SELECT doc_id, unnest(regexp_extract_all(x, '..')) AS x FROM i)),
h AS (SELECT doc_id, v, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY v) AS below, sum(n) OVER (PARTITION BY doc_id ORDER BY v DESC) AS above, sum(n) OVER (PARTITION BY doc_id) AS size FROM h),
l AS (SELECT doc_id, min(v) FILTER (below > size // 100) AS low, max(v) FILTER (above > size // 100) AS high FROM c GROUP BY doc_id),
a AS (SELECT c.doc_id, n, size, low, high, CASE WHEN high <= low THEN v ELSE least(255, greatest(0, trunc(v * (255.0::DOUBLE / (high - low)) + -low * (255.0::DOUBLE / (high - low))))) END::INT AS v FROM c JOIN l ON c.doc_id = l.doc_id),
m AS (SELECT *, floor(sum(v * n) OVER (PARTITION BY doc_id)::DOUBLE / size + 0.5)::FLOAT AS mean FROM a)
SELECT doc_id, low, high, sum(n * trunc(least(255::FLOAT, greatest(0::FLOAT, mean + 1.4::FLOAT * (v::FLOAT - mean))))::BIGINT)::BIGINT AS total FROM m GROUP BY ALL
""")
def stretched_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two filters: bounds of the values that are left, and the sum of pixels after contrast."""
    return document_images(spark, sf_dir).select("doc_id", _stretched("pixels").alias("of")).select("doc_id", "of.*")


@query(f"""
WITH {SQL_HEX},
n AS (SELECT *, greatest(2, ceil(height::DOUBLE / {BAND})::INT) AS n FROM i), t AS (SELECT *, ceil(height::DOUBLE / n)::INT AS step FROM n),
o AS (SELECT *, least(96, greatest(24, step // 12)) AS overlap FROM t),
k AS (SELECT doc_id, x, height, n, step, overlap, unnest(range(0, n)) AS band FROM o WHERE height > {BAND}),
e AS (SELECT doc_id, x, band, CASE WHEN band = 0 THEN 0 ELSE greatest(0, band * step - overlap) END AS top, CASE WHEN band = n - 1 THEN height ELSE least(height, (band + 1) * step + overlap) END AS bottom FROM k
      UNION ALL SELECT doc_id, x, 0, 0, height FROM i WHERE height <= {BAND})
SELECT doc_id, band, (bottom - top)::INT AS height, md5(substr(x, top * {IMAGE_WIDTH * 2} + 1, (bottom - top) * {IMAGE_WIDTH * 2})) AS digest FROM e
""")
def image_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of every document image's bands."""
    cut = images.cut_bands(document_images(spark, sf_dir), BAND)
    return cut.select("doc_id", F.col("band").cast("long").alias("band"), "height", F.md5(F.hex("pixels")).alias("digest"))
