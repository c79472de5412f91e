"""Scanning extraction results: discovery, the two JSON shapes, resume, reports."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import geometry
from folioscope.functions.names import YES
from folioscope.operators.quality import reusable_pages
from folioscope.sources.sinks import file_system, written

#: Where results are looked for, and where if there are none.
RESULTS, FALLBACK = "data/extracted/*_output_*.json", "ocr_models/*/*_output.json"
#: Files that the driver lists at most, some KB each; more are listed and opened by tasks of about so many bytes or files.
DRIVER_FILES, TASK_BYTES, TASK_FILES = 1_000, 16 << 20, 10_000
#: Keys of a page that are no metadata.
PAGE_KEYS = (
    "page", "image_file", "status", "text", "text_for_cer_wer", "char_count", "word_count", "processing_seconds",
    "rotation_applied_degrees", "extraction_mode", "ocr_method", "warnings", "error", "metadata", "meta",
)


def resolved(spark: SparkSession, paths: list[str]) -> list[str]:
    """Full paths of files, each once, in order; one that is missing is an error."""
    conf, of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return list(dict.fromkeys(of(p).getFileSystem(conf).resolvePath(of(p)).toString() for p in paths))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, engine, document, bytes, json of whole files; a path that is named twice, however it is written, counts once.

    engine and document are what the file's name says before and after _output_ (the first may have no document). They come from the listing, as
    path and bytes do: a filter on them opens only the files that it lets through. Small files share a task, by their sizes.
    """
    return _files(spark, resolved(spark, paths))


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.text(paths, wholetext=True)
    meta = F.col("_metadata")
    return files.select(meta["file_path"].alias("path"), *_named(meta["file_name"]), meta["file_size"].alias("bytes"), F.col("value").alias("json"))


def _named(file: Column) -> list[Column]:
    return [F.regexp_extract(file, r"\A(.*?)_output(?:_.*)?\.json\z", 1).alias("engine"), F.regexp_extract(file, r"_output_(.*)\.json\z", 1).alias("document")]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """read_files of the results under root, or of the fallback pattern only if there are none.

    Up to DRIVER_FILES are listed by the driver. More are listed by a task into a table, from which tasks open them, so that the driver holds none;
    this needs a root without wildcards in a store that pyarrow opens, the driver lists any other. A filter opens only its files either way.
    """
    for pattern in (RESULTS, FALLBACK):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        listed = _listing(spark, fs.makeQualified(path).toString().removesuffix(f"/{pattern}"), pattern)
        if listed is not None and listed.limit(DRIVER_FILES + 1).count() > DRIVER_FILES:
            return _opened(written(listed, "listed"))
        found = fs.globStatus(path)
        if found:
            return _files(spark, sorted(s.getPath().toString() for s in found))
    return spark.createDataFrame([], "path string, engine string, document string, bytes long, json string")


def _as_uri(path: str) -> str:
    """A path as Spark's file metadata write it: what is not ASCII stays, but for spaces and controls."""
    return re.sub(r"[^A-Za-z0-9_.!~'()*,;:$&+=@/-]", lambda c: quote(c[0]) if c[0] < "\x80" or unicodedata.category(c[0]) in ("Cc", "Zs", "Zl", "Zp") else c[0], path)


def _entries(fs: pafs.FileSystem, at: str, fits) -> Iterator[tuple[str, bool, int]]:
    """(name, whether a folder, bytes) of the entries of a folder whose names fit; none if there is no such folder. A local folder is read entry by entry."""
    if fs.type_name != "local":
        yield from ((i.base_name, i.type == pafs.FileType.Directory, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if fits(i.base_name))
    elif os.path.isdir(at):
        with os.scandir(at) as entries:
            yield from ((e.name, e.is_dir(), e.stat().st_size) for e in entries if fits(e.name))


def _matching(fs: pafs.FileSystem, at: str, parts: list[str]) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files that the parts of a pattern fit, and of all in folders that they fit; hidden and empty ones are left out, as Spark's readers do."""
    if parts and "*" not in parts[0]:
        yield from _matching(fs, f"{at}/{parts[0]}", parts[1:])
        return
    hidden = lambda name: name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    for name, folder, size in _entries(fs, at, lambda n: fnmatchcase(n, parts[0] if parts else "*") and (bool(parts[1:]) or not hidden(n))):
        if folder:
            yield from _matching(fs, f"{at}/{name}", parts[1:])
        elif size and not parts[1:]:
            yield f"{at}/{name}", size


def _listing(spark: SparkSession, root: str, pattern: str) -> DataFrame | None:
    """path, bytes of the files under root that pattern fits, listed by one task; none if only Spark can list them."""
    try:
        at = file_system(root)[1].rstrip("/")
    except (pa.ArrowException, OSError, ValueError):
        return None
    if re.search(r"[*?\[\]{}\\]", root):
        return None
    before = root.rstrip("/").removesuffix(at)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list(batches)
        found = _matching(file_system(root)[0], at, pattern.split("/"))
        while some := list(islice(found, 1000)):
            yield pa.RecordBatch.from_pylist([{"path": before + _as_uri(p), "bytes": n} for p, n in some])

    return spark.range(1, numPartitions=1).mapInArrow(rows, "path string, bytes long")


def _opened(listed: DataFrame) -> DataFrame:
    """read_files of a written listing. Texts are exploded, so that Spark takes filters on the other columns below the UDF, but none on texts, which would open a file again."""

    @F.udf("array<string>", useArrow=False)  # Arrow would hold the texts of ten thousand files
    def content(path: str) -> list[str]:
        fs, at = file_system(unquote(path))
        with fs.open_input_stream(at) as file:
            return [file.read().decode("utf-8", "replace")]

    files, size = listed.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES, files // TASK_FILES)
    return listed.repartition(tasks, "path").select("path", *_named(F.substring_index("path", "/", -1)), "bytes", F.explode(content("path")).alias("json"))


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*\z", 1)


def load_documents(files: DataFrame, default_model: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, raw pages) of files (path, json) that hold an array of pages or an object with pages.

    documents: path, source_pdf, model, page_count, run_elapsed_seconds. Raw pages: path, model, ord and the raw fields.
    Array members that are no objects are skipped; another shape is an error. Of repeated keys in an object the last counts if
    spark.sql.variant.allowDuplicateKeys is set.
    """
    v = files.select("path", F.parse_json("json").alias("v"))
    shape = F.schema_of_variant("v")
    listed = shape.startswith("ARRAY")
    pages = F.when(listed, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.pages", "array<variant>"))
    text = lambda key: F.when(~listed, F.try_variant_get("v", f"$.{key}", "string"))
    model = F.coalesce(F.nullif(text("model"), F.lit("")), default_model if default_model is not None else parent_folder(F.col("path")))
    checked = F.when(pages.isNull(), F.raise_error(F.concat(F.lit("unsupported JSON shape in "), F.col("path")))).otherwise(pages)
    base = v.select("path", model.alias("model"), text("source_pdf").alias("source_pdf"), F.when(~listed, F.try_variant_get("v", "$.page_count", "int")).alias("declared"), F.when(~listed, F.try_variant_get("v", "$.run_elapsed_seconds", "double")).alias("elapsed"), checked.alias("pages"))
    objects = F.filter("pages", lambda p: F.schema_of_variant(p).startswith("OBJECT"))
    base = base.withColumn("pages", objects)
    exploded = base.select("path", "model", F.posexplode("pages").alias("ord", "p"))
    get = lambda key, kind="string": F.try_variant_get("p", f"$.{key}", kind)
    number = lambda key: F.coalesce(F.try_variant_get("p", f"$.{key}", "int").cast("string"), get(key))
    others = F.map_filter(F.try_variant_get("p", "$", "map<string,string>"), lambda k, _: ~k.isin(*PAGE_KEYS))
    raw = exploded.select(
        "path", "model", "ord",
        number("page").alias("page"), get("image_file").alias("image_file"), get("text").alias("text"), get("processing_seconds").alias("processing_seconds"),
        number("rotation_applied_degrees").alias("rotation_applied_degrees"), get("extraction_mode").alias("extraction_mode"), get("ocr_method").alias("ocr_method"),
        get("warnings", "array<string>").alias("warnings"), get("error").alias("error"),
        get("metadata", "map<string,string>").alias("metadata"), get("meta", "map<string,string>").alias("meta"), others.alias("extra"),
    )
    numbers = F.filter(F.transform("pages", lambda p: F.try_variant_get(p, "$.page", "int")), lambda n: n > 0)
    derived = F.coalesce(F.array_max(numbers), F.size("pages"))
    documents = base.select("path", "source_pdf", "model", F.coalesce("declared", derived).alias("page_count"), F.coalesce("elapsed", F.lit(0.0)).alias("run_elapsed_seconds"))
    return documents, raw


def load_report(files: DataFrame) -> DataFrame:
    """rank, model, page, cer, wer of reports (path, json): each ranked model with its pages; of models of one id the last counts."""
    page = "array<struct<page:int,cer:double,wer:double>>"
    schema = f"struct<ranking:array<struct<rank:int,model:string,cer:double,wer:double>>,models:array<struct<model:string,pages:{page}>>>"
    r = files.select("path", F.from_json("json", schema).alias("r"))
    ranking = r.select("path", F.inline("r.ranking")).withColumnsRenamed({"cer": "doc_cer", "wer": "doc_wer"})
    models = r.select("path", F.posexplode("r.models").alias("ord", "m")).select("path", "ord", "m.*")
    last = models.groupBy("path", "model").agg(F.max_by("pages", "ord").alias("pages"))
    return ranking.join(last, ["path", "model"]).select("path", "rank", "model", "doc_cer", "doc_wer", F.explode("pages").alias("p")).select("path", "rank", "model", "doc_cer", "doc_wer", "p.*")


def accepted_cache(previous: DataFrame, file_name: Column, source_pdf: Column, model: Column) -> DataFrame:
    """Earlier results (file_name, source_pdf, model, pages) that belong to this run: same file; same source and model where they say so."""
    fits = (F.col("file_name") == file_name) & F.coalesce(F.col("source_pdf") == source_pdf, F.lit(True)) & F.coalesce(F.col("model") == model, F.lit(True))
    return previous.where(fits & F.col("pages").isNotNull())


def resume_plan(images: DataFrame, cached: DataFrame, keys=("doc",)) -> DataFrame:
    """keys, page, reused, text: each page image with its reusable cached page, the last by ord; the others are to be extracted."""
    last = F.row_number().over(Window.partitionBy(*keys, "page").orderBy(F.desc("ord")))
    good = reusable_pages(cached).withColumn("page", F.col("page").try_cast("int")).withColumn("nth", last).where("nth = 1").select(*keys, "page", "text")
    rows = images.join(good, [*keys, "page"], "left")
    return rows.select(*keys, "page", F.col("text").isNotNull().alias("reused"), "text")


@dataclass(frozen=True)
class Settings:
    """Settings of an extraction run; of_conf reads them from folioscope.* keys of the session, as text."""

    render_dpi: int = 220
    image_max_dim: int = geometry.MAX_DIM
    fallback_max_dims: tuple[int, ...] = ()
    band_heights: tuple[int, ...] = geometry.BAND_HEIGHTS
    save_preprocessed_images: bool = False
    resume_progress: bool = True
    orientation_detection: bool = False

    @property
    def fallbacks(self) -> tuple[int, ...]:
        """The dims to fall back to: the largest, then three quarters of it but not below 1200, unless set."""
        return self.fallback_max_dims or (self.image_max_dim, max(1200, int(self.image_max_dim * 0.75)))

    @classmethod
    def of_conf(cls, spark: SparkSession) -> Settings:
        values = {}
        for name, field in cls.__dataclass_fields__.items():
            text = spark.conf.get(f"folioscope.{name}", None)
            if text is None:
                continue
            if isinstance(field.default, bool):
                values[name] = text.strip().lower() in YES
            elif isinstance(field.default, tuple):
                values[name] = tuple(int(x) for x in text.split(",") if x.strip().isdigit() and int(x) > 0)
            else:
                values[name] = int(text)
        return cls(**values)
