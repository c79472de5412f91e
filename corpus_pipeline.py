"""A corpus pipeline in five stages: toxic documents go, exact copies go, near copies go, sources are mixed, texts become token ids.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of docs. Null and empty texts pass the first stage, are copies of one another
in the second, are linked with nothing in the third, have no words in the fourth, so the mix leaves them out. Whole texts
are read, however long. Ties go by doc_id in the second and third stage, by the digest that orders the queue in the fourth, so
reruns agree; rows that repeat doc_id and text are one document from the second stage on. An empty table stays empty
through all stages. Columns beside doc_id, text and source may have any names that aren't these, and any types that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from folioscope.llm.shared import materialize, release, scratch_made, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.tokenize_documents(docs, byte_bpe.default_path())


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", tokenized),
]

#: No SQL states the first, third and last stage; tests hold the stages against brute-force versions, libraries and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage was made from is deleted when its own table is written."""
    docs, since = table(spark, sf_dir, "documents"), scratch_made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since)
    return docs
