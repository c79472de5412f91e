"""Writing results: documents as files of their own, JSON lines, reports, page-wise checkpoints, tables that cut lineage."""

from __future__ import annotations

import json
import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folioscope.functions.names import output_path

#: Files of a staging folder: what a task wrote, and the tasks' folders once all have ended.
LISTED, COMMITTED = "listed.jsonl", "committed.json"


def file_system(uri: str):
    """(file system, path) of pyarrow for a URI such as file:///..., hdfs://..., or for a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def exists(uri: str) -> bool:
    fs, at = file_system(uri)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


@dataclass
class _TaskFiles(WriterCommitMessage):
    """The staging folders of a task that ended well, one a root."""

    folders: list[str]


class _StagedWriter(DataSourceArrowWriter):
    """Writes rows (place, name, body) as files of a folder that is the attempt's own, with a list of them; nothing appears where files are looked for."""

    def __init__(self, staging: list[str]):
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt = uuid.uuid4().hex
        folders = [f"{s}/{attempt}" for s in self.staging]
        targets = [(*file_system(f), f) for f in folders]
        for fs, at, _ in targets:
            fs.create_dir(at, recursive=True)
        listed: list[list[str]] = [[] for _ in targets]
        for batch in iterator:
            # one document at a time: a list of a batch's bodies would be a second copy of them
            for row_places, text in zip(batch.column("places"), batch.column("body")):
                data = json.dumps(json.loads(text.as_py()), ensure_ascii=False, indent=2).encode()
                for place, (fs, at, folder), files in zip(row_places.as_py(), targets, listed):
                    name = f"{len(files)}.staged"
                    with fs.open_output_stream(f"{at}/{name}") as out:
                        out.write(data)
                    files.append(json.dumps({"staged": f"{folder}/{name}", "path": place, "bytes": len(data)}))
        for (fs, at, _), files in zip(targets, listed):
            with fs.open_output_stream(f"{at}/{LISTED}") as out:
                out.write("\n".join(files).encode())
        return _TaskFiles(folders)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for i, staging in enumerate(self.staging):
            fs, at = file_system(staging)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{COMMITTED}") as out:
                out.write(json.dumps([m.folders[i] for m in messages if m]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _forget(self.staging)


class DocumentFiles(DataSource):
    """Data source that stages documents as files; write_document_files moves them to their places once all are there."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "places array<string>, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _StagedWriter(json.loads(self.options["staging"]))


def _forget(folders: list[str]) -> None:
    for folder in folders:
        fs, at = file_system(folder)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves staged files to their places. A task that is run again finds the moved ones in place and goes on."""
    for batch in batches:
        for staged, path in zip(batch.column("staged").to_pylist(), batch.column("path").to_pylist()):
            (fs, source), (_, to) = file_system(staged), file_system(path)
            if fs.get_file_info(source).type == pafs.FileType.NotFound:
                if fs.get_file_info(to).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"neither {staged} nor {path}")
                continue
            fs.create_dir(posixpath.dirname(to), recursive=True)
            if fs.type_name != "local" and fs.get_file_info(to).type != pafs.FileType.NotFound:
                fs.delete_file(to)  # other stores don't move onto a file
            fs.move(source, to)
        yield batch.select(["path", "bytes"])


def write_document_files(documents: DataFrame, root: str, extra_root: str | None = None, source: str = "source_pdf", run: str | None = None) -> DataFrame:
    """Each document as a JSON file of its own, under the path that output_path builds from its model and source; returns path, bytes of each.

    The files are indented by two spaces, keep what is not ASCII and replace what is there; extra_root gets a copy. discover finds them there. root must be a
    folder that all executors share. Tasks write to a hidden staging folder of this run; if any fails for good, the folder goes and no
    file has appeared or changed. When all have ended, a second job moves the files to their places; it can be repeated. A run that is
    named and has been completed isn't written again: its files are returned.
    """
    spark = documents.sparkSession
    roots = list(dict.fromkeys(r.rstrip("/") for r in (root, extra_root) if r))
    run = run or uuid.uuid4().hex
    done = [f"{r}/data/.runs/{run}" for r in roots]
    if not all(exists(f"{d}/_SUCCESS") for d in done):
        staging = [f"{r}/data/.staging-{run}" for r in roots]
        if not all(exists(f"{s}/{COMMITTED}") for s in staging):
            _forget(staging)
            spark.dataSource.register(DocumentFiles)
            body = F.to_json(F.struct(*[c for c in documents.columns]), {"ignoreNullFields": "false"})
            rows = documents.select(F.array(*[output_path(r, F.col("model"), F.col(source)) for r in roots]).alias("places"), body.alias("body"))
            rows.write.format("document_files").option("staging", json.dumps(staging)).mode("append").save()
        for staged, to in zip(staging, done):
            fs, at = file_system(staged)
            folders = json.loads(fs.open_input_stream(f"{at}/{COMMITTED}").read())
            listed = spark.read.schema("staged string, path string, bytes long").json([f"{f}/{LISTED}" for f in folders] or [f"{staged}/{COMMITTED}"]).where("path IS NOT NULL")
            moved = listed.repartition(max(1, min(len(folders), spark.sparkContext.defaultParallelism * 4))).mapInArrow(_moved, "path string, bytes long")
            moved.write.mode("overwrite").parquet(to)
        _forget(staging)
    return spark.read.schema("path string, bytes long").parquet(*done)


def write_documents(documents: DataFrame, path: str, extra_path: str | None = None) -> None:
    """Documents as JSON lines, non-ASCII kept, replacing what is there; a second copy if another path is named."""
    for p in dict.fromkeys(x for x in (path, extra_path) if x):
        documents.write.mode("overwrite").json(p)


def write_texts(documents: DataFrame, path: str) -> None:
    """The documents' texts, a row each, partitioned by model."""
    documents.select("model", F.col("text").alias("value")).write.mode("overwrite").partitionBy("model").text(path, lineSep="\x1e")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def append_pages(pages: DataFrame, path: str, run: str = "run", batch: int = 0) -> None:
    """Page-wise progress: finished pages, in a folder of their run and batch, by model; a rerun reads them and leaves them out.

    A batch that is written again replaces itself, so a replay adds nothing. read_pages reads what all runs wrote.
    """
    pages.write.mode("overwrite").partitionBy("model").parquet(f"{path.rstrip('/')}/run={run}/batch={batch}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages that append_pages wrote, with run and batch; of a page that several batches wrote the last counts (by ord, then batch)."""
    rows = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/run=*/batch=*").withColumn("model", F.col("model").cast("string"))
    last = Window.partitionBy("doc", "model", "page").orderBy(F.desc("ord"), F.desc("batch"), F.desc("run"))
    return rows.withColumn("nth_", F.row_number().over(last)).where("nth_ = 1").drop("nth_")


def scratch_folder(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share; only a local session may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/folioscope-scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a scratch folder and read back: what came before it is not computed again."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
