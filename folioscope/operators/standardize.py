"""Raw pages to standard pages, standard pages to standard documents.

Page tables carry doc, model and ord (the place of a page in its input) beside the page's own fields; later rows of the
same page win by ord. Free-form metadata are maps of strings, whose values hold JSON where they are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.distance import round3
from folioscope.functions.text import count_spaced_words, display_text, scoring_text, strip

SCHEMA_VERSION = "2.0"
#: The attempts of the extraction cascade, in order; what a document says about its texts.
PIPELINE = ("pagina_inteira", "pagina_inteira_pre", "faixas", "faixas_pre")
TEXT_NORMALIZATION = '{"text":"multiline_canonical","text_for_cer_wer":"single_line_whitespace_normalized_per_page"}'
PAGE_FIELDS = (
    "page", "image_file", "status", "text", "text_for_cer_wer", "char_count", "word_count", "processing_seconds",
    "rotation_applied_degrees", "extraction_mode", "warnings", "error", "metadata",
)
#: The fields of a raw page, beside PAGE_FIELDS those of a standard one. Absent columns count as null.
RAW_FIELDS = {
    "page": "string", "image_file": "string", "text": "string", "processing_seconds": "string", "rotation_applied_degrees": "string",
    "extraction_mode": "string", "ocr_method": "string", "warnings": "array<string>", "error": "string",
    "metadata": "map<string,string>", "meta": "map<string,string>", "extra": "map<string,string>",
}


def later_wins(*maps: Column) -> Column:
    """Maps folded into one; of equal keys the last map's value stays."""
    empty = F.create_map().cast("map<string,string>")
    merged = F.coalesce(maps[0], empty)
    for m in maps[1:]:
        merged = _folded(merged, F.coalesce(m, empty))
    return merged


def _folded(base: Column, over: Column) -> Column:
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def merge_nested(base: Column, extra: Column) -> Column:
    """map<string, map<string,string>> folded one level deep: inner maps of both are merged, later values win."""
    empty = F.create_map().cast("map<string,map<string,string>>")
    return F.map_zip_with(F.coalesce(base, empty), F.coalesce(extra, empty), lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(later_wins(a, b)))


def _blank_to_null(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def standardize_pages(raw: DataFrame) -> DataFrame:
    """PAGE_FIELDS of each raw page, with all columns of raw that are no raw field.

    Nothing is rejected: bad numbers become 0, negative seconds and NaN 0, warnings that are no list none. An error makes the
    status error even beside a text.
    """
    own = [c for c in raw.columns if c not in RAW_FIELDS]
    field = lambda name: (F.col(name) if name in raw.columns else F.lit(None)).cast(RAW_FIELDS[name])
    rows = raw.select(*own, *[field(n).alias(f"raw_{n}") for n in RAW_FIELDS])
    rows = rows.withColumn("text", display_text(F.col("raw_text")))
    rows = rows.withColumn("text_for_cer_wer", scoring_text(F.col("text"), F.col("raw_text")))
    error = _blank_to_null(F.col("raw_error"))
    seconds = F.nanvl(F.coalesce(F.col("raw_processing_seconds").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    whole = lambda name: F.coalesce(F.col(f"raw_{name}").try_cast("int"), F.lit(0))
    mode = F.coalesce(F.when(F.col("raw_extraction_mode") != "", F.col("raw_extraction_mode")), F.col("raw_ocr_method"))
    warnings = F.filter(F.transform(F.coalesce("raw_warnings", F.array().cast("array<string>")), lambda w: F.coalesce(strip(w), F.lit("None"))), lambda w: w != "")
    return rows.select(
        *own,
        whole("page").alias("page"),
        F.coalesce("raw_image_file", F.lit("")).alias("image_file"),
        F.when(error.isNotNull(), "error").when(F.col("text") != "", "ok").otherwise("empty").alias("status"),
        "text",
        "text_for_cer_wer",
        F.length("text").alias("char_count"),
        count_spaced_words(F.col("text_for_cer_wer")).alias("word_count"),
        round3(F.when(seconds > 0.0, seconds).otherwise(F.lit(0.0))).alias("processing_seconds"),
        whole("rotation_applied_degrees").alias("rotation_applied_degrees"),
        _blank_to_null(mode).alias("extraction_mode"),
        warnings.alias("warnings"),
        error.alias("error"),
        later_wins(F.col("raw_metadata"), F.col("raw_meta"), F.col("raw_extra")).alias("metadata"),
    )


def _joined(text: str, separator: str) -> Column:
    """The non-empty texts in order of page, then ord."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct("page", "ord", F.col(text).alias("t")))))
    return F.array_join(F.transform(parts, lambda p: p["t"]), separator)


def build_documents(pages: DataFrame, keys=("doc", "model")) -> DataFrame:
    """One row a document: counts, joined texts, times, and the pages as an ordered array.

    All pages count, whatever their number. The average time is taken from the rounded total.
    """
    return rolled_up(pages, keys).drop("page_numbers")


def rolled_up(pages: DataFrame, keys=("doc", "model")) -> DataFrame:
    """build_documents with page_numbers, the distinct positive numbers of the pages."""
    page = F.struct("page", "ord", F.struct(*[c for c in PAGE_FIELDS if c not in ("page", "metadata")], F.map_entries("metadata").alias("metadata")).alias("fields"))
    rows = pages.withColumn("_page", page).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("timed_pages_count"),
        F.count_if(F.col("status") == "ok").alias("successful_pages_count"),
        F.count_if(F.col("status") == "error").alias("failed_pages_count"),
        F.coalesce(F.max(F.when(F.col("page") > 0, F.col("page"))).cast("long"), F.count(F.lit(1))).alias("page_count"),
        _joined("text", "\n\n").alias("text"),
        _joined("text_for_cer_wer", "\n").alias("text_for_cer_wer"),
        F.sum("processing_seconds").alias("seconds"),
        F.array_sort(F.collect_list("_page")).alias("pages"),
        F.collect_set(F.when(F.col("page") > 0, F.col("page"))).alias("page_numbers"),
    )
    rows = rows.withColumn("total_processing_seconds", round3("seconds"))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        *keys,
        "page_count",
        "timed_pages_count",
        "successful_pages_count",
        "failed_pages_count",
        F.array(*[F.lit(p) for p in PIPELINE]).alias("extraction_pipeline"),
        "text",
        "text_for_cer_wer",
        F.length("text").alias("total_char_count"),
        count_spaced_words(F.col("text_for_cer_wer")).alias("total_word_count"),
        "total_processing_seconds",
        round3(F.col("total_processing_seconds") / F.col("timed_pages_count")).alias("average_page_processing_seconds"),
        F.create_map(F.lit("text_normalization"), F.lit(TEXT_NORMALIZATION)).alias("metadata"),
        F.transform("pages", _page_of).alias("pages"),
        "page_numbers",
    )


def _page_of(p: Column) -> Column:
    """A standard page from its sortable form: maps can't be ordered, so metadata travel as entries."""
    f = p["fields"]
    whole = {c: f[c] for c in PAGE_FIELDS if c not in ("page", "metadata")}
    return F.struct(p["page"].alias("page"), *[c.alias(n) for n, c in whole.items()], F.map_from_entries(f["metadata"]).alias("metadata"))


def last_of_page(pages: DataFrame, keys=("doc", "model")) -> DataFrame:
    """The page map of evaluation: positive pages, of equal numbers the one with the last ord."""
    last = F.row_number().over(Window.partitionBy(*keys, "page").orderBy(F.desc("ord")))
    return pages.where("page > 0").withColumn("nth", last).where("nth = 1").drop("nth")
