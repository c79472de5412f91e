"""What the operators of this subpackage share: tables, the shared scratch folder, file systems seen from Python."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python worker gets at once in the steps that are written to the scratch folder.
BATCH_ROWS = 1000
#: A word of a text: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Scratch folders made in this process and not yet released.
_MADE: list[str] = []
#: What the operator that a Python worker runs keeps from task to task.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this operator keeps in a Python worker. Workers are used again by later steps: the first call of another operator drops it, and gives back freed memory."""
    if operator not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        _KEPT[operator] = {}
    return _KEPT[operator]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(column: str = "text") -> F.Column:
    """The text as every operator here sees it: null is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def is_held_out(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; rows without an id count as not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir; release or a JVM hook at the end deletes it.

    Only a local session may go without that setting; then the folder is in the machine's temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/folioscope-scratch"
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)
    _MADE.append(path)
    return path if "://" in path else fs.makeQualified(jvm_path).toString()


def scratch_made() -> int:
    """How many scratch folders there are by now: where a later release begins."""
    return len(_MADE)


def release(spark: SparkSession, since: int) -> None:
    """Deletes the scratch folders made since then but the last one, which holds what all others were made for."""
    for path in _MADE[since:-1]:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    del _MADE[since:-1]


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Python workers get at most so many rows at once while an action runs: rows here are texts, sketches and whole sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet to the shared scratch folder and reads them back."""
    spark = df.sparkSession
    path = f"{scratch(spark, tag)}/table"
    with small_batches(spark):
        df.write.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(nullable).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A materialized table of ids with a broadcast hint if it has at most so many rows (some 40 MB); more are joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def python_fs(uri: str):
    """(file system, path) of pyarrow for a URI such as file:///..., hdfs://..., s3://..."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
