"""Error rates of candidates against a reference, by page and by document, and the ranking of models.

Every table is keyed by doc, so one call rates a whole corpus; with a single doc it is the one-reference evaluation.
Document rates compare the joined texts of all pages, separators included: they are not means of page rates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.distance import METRICS, fixed, with_counts, with_metrics, with_rates
from folioscope.operators.long_distance import LONG, TILE, edit_distances
from folioscope.operators.standardize import build_documents, rolled_up

EXCERPT = 120


def rated(rows: DataFrame, reference: str, hypothesis: str, write: Callable[[DataFrame, str], DataFrame] | None = None, size: int = TILE) -> DataFrame:
    """rows with METRICS of two scoring texts. With write (as sinks.written), pairs too long for one task are dealt to many as tiles of the given side."""
    if write is None:
        return with_metrics(rows, reference, hypothesis)
    rows = write(rows.withColumn("pair_", F.monotonically_increasing_id()), "rated-pairs")
    long = F.length(reference).cast("long") * F.length(hypothesis) > LONG * size * size
    pairs = rows.where(long).select(F.col("pair_").alias("id"), F.col(reference).alias("a"), F.col(hypothesis).alias("b"))
    if pairs.isEmpty():
        return with_metrics(rows, reference, hypothesis).drop("pair_")
    found = [edit_distances(pairs, write, words, size).select(F.col("id").alias("pair_"), F.col("distance").cast("int").alias(name)) for words, name in ((False, "char_distance"), (True, "word_distance"))]
    of_long = with_counts(rows.where(long), reference, hypothesis).join(found[0], "pair_").join(found[1], "pair_")
    return with_metrics(rows.where(F.coalesce(~long, F.lit(True))), reference, hypothesis).unionByName(with_rates(of_long)).drop("pair_")


def page_metrics(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each reference page and model of its doc: status, missing_page, excerpts, error and METRICS.

    A page that a model lacks has an empty text and status missing. Duplicate pages: the last one counts.
    """
    version = lambda model, *of: F.struct(model.alias("model"), "ord", *[c.alias(n) for n, c in zip(("status", "error"), of)], F.col("text").alias("text"), F.col("text_for_cer_wer").alias("scored"))
    none = F.lit(None).cast("string")
    both = reference.where("page > 0").select("doc", "page", version(none, none, none).alias("v")).unionByName(candidates.where("page > 0").select("doc", "page", version(F.col("model"), F.col("status"), F.col("error")).alias("v")))
    # all versions of a page meet once; of each maker the last one counts
    pages = both.groupBy("doc", "page").agg(F.collect_list("v").alias("versions"))
    last = lambda is_of: F.array_max(F.filter("versions", is_of))
    pages = pages.withColumn("ref", last(lambda v: v["model"].isNull())).where("ref IS NOT NULL")
    models = candidates.groupBy("doc").agg(F.collect_set("model").alias("models"))
    made = F.transform("models", lambda m: F.struct(m.alias("model"), last(lambda v: v["model"] == m).alias("cand")))
    rows = pages.join(models, "doc").select("doc", "page", "ref", F.explode(made).alias("made"))
    rows = rows.select(
        "doc",
        "made.model",
        "page",
        F.coalesce("made.cand.status", F.lit("missing")).alias("status"),
        F.col("made.cand.scored").isNull().alias("missing_page"),
        F.left("ref.text", F.lit(EXCERPT)).alias("reference_excerpt"),
        F.left(F.coalesce("made.cand.text", F.lit("")), F.lit(EXCERPT)).alias("hypothesis_excerpt"),
        F.col("made.cand.error").alias("error"),
        F.col("ref.scored").alias("ref_scored"),
        F.coalesce("made.cand.scored", F.lit("")).alias("cand_scored"),
    )
    return with_metrics(rows, "ref_scored", "cand_scored").drop("ref_scored", "cand_scored")


def _number_sets(ref: str, cand: str) -> list:
    """missing_pages and extra_pages of two arrays of page numbers."""
    return [F.array_sort(F.array_except(ref, cand)).alias("missing_pages"), F.array_sort(F.array_except(cand, ref)).alias("extra_pages")]


def page_sets(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc, model, missing_pages, extra_pages: sorted page numbers that only one side has."""
    ref = reference.where("page > 0").groupBy("doc").agg(F.collect_set("page").alias("r"))
    cand = candidates.groupBy("doc", "model").agg(F.collect_set(F.when(F.col("page") > 0, F.col("page"))).alias("c"))
    rows = cand.join(ref, "doc", "left").withColumn("r", F.coalesce("r", F.array().cast("array<int>")))
    return rows.select("doc", "model", *_number_sets("r", "c"))


def document_metrics(reference: DataFrame, candidates: DataFrame, write: Callable[[DataFrame, str], DataFrame] | None = None, size: int = TILE) -> DataFrame:
    """A row for each doc and model: METRICS of the documents' texts, counts and times, missing and extra pages; docs without a reference drop out.

    Each side's pages are grouped once, for texts, counts and page numbers alike, and joined once. write and size as for rated.
    """
    ref = rolled_up(reference, ("doc",)).select("doc", F.col("text_for_cer_wer").alias("ref_scored"), F.col("page_numbers").alias("ref_pages"))
    counts = ["page_count", "successful_pages_count", "failed_pages_count", "total_processing_seconds", "average_page_processing_seconds"]
    cand = rolled_up(candidates).select("doc", "model", *counts, F.col("text_for_cer_wer").alias("cand_scored"), F.col("page_numbers").alias("cand_pages"))
    rows = cand.join(ref, "doc").select("doc", "model", *counts, "ref_scored", "cand_scored", *_number_sets("ref_pages", "cand_pages"))
    return rated(rows, "ref_scored", "cand_scored", write, size).select("doc", "model", *counts, *METRICS, "missing_pages", "extra_pages")


def ranked(rows: DataFrame) -> DataFrame:
    """rank from 1 within each doc by cer, wer, model: unique, as ties go on to output_file where there is one."""
    ties = ["output_file"] if "output_file" in rows.columns else []
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("cer", "wer", "model", *ties)))


def leaderboard(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ranking: rank, model, rates, distances, times, and counts of failed, missing and extra pages, for each doc."""
    rows = ranked(document_metrics(reference, candidates))
    return rows.select(
        "doc", "rank", "model", "cer", "wer", "char_distance", "word_distance", "total_processing_seconds", "average_page_processing_seconds",
        "failed_pages_count", F.size("missing_pages").alias("missing_pages_count"), F.size("extra_pages").alias("extra_pages_count"),
    )


def report(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a doc: generated_at, reference, ranking[] and models[] (each with document, timing, pages), as the JSON report nests them."""
    pages = page_metrics(reference, candidates)
    of_page = F.struct("page", "status", "missing_page", "reference_excerpt", "hypothesis_excerpt", "error", *METRICS)
    pages = pages.groupBy("doc", "model").agg(F.array_sort(F.collect_list(of_page)).alias("pages"))
    rows = ranked(document_metrics(reference, candidates)).join(pages, ["doc", "model"], "left")
    timing = F.struct("total_processing_seconds", "average_page_processing_seconds")
    rank = F.struct("rank", "model", "cer", "wer", "char_distance", "word_distance", "total_processing_seconds", "average_page_processing_seconds", "failed_pages_count", F.size("missing_pages").alias("missing_pages_count"), F.size("extra_pages").alias("extra_pages_count"))
    model = F.struct("rank", "model", "successful_pages_count", "failed_pages_count", "page_count", "missing_pages", "extra_pages", F.struct(*METRICS).alias("document"), timing.alias("timing"), "pages")
    nested = rows.groupBy("doc").agg(F.array_sort(F.collect_list(rank)).alias("ranking"), F.array_sort(F.collect_list(model)).alias("models"))
    ref = build_documents(reference, ("doc",)).select("doc", F.struct("page_count", F.length("text_for_cer_wer").alias("total_char_count"), "total_word_count").alias("reference"))
    return nested.join(ref, "doc").select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("generated_at"), "doc", "reference", "ranking", "models")


def console_lines(board: DataFrame) -> DataFrame:
    """The fixed-width lines of a leaderboard, in order of rank."""
    line = F.format_string("%-20s %8s %8s %8d %8d %10s %8d %10d %8d", F.left("model", F.lit(20)), fixed(F.col("cer"), 4), fixed(F.col("wer"), 4), "char_distance", "word_distance", fixed(F.col("total_processing_seconds"), 3), "failed_pages_count", "missing_pages_count", "extra_pages_count")
    return board.select("doc", "rank", line.alias("line"))


def console_page_lines(pages: DataFrame) -> DataFrame:
    """The fixed-width lines of each model's pages, for the longer form of the console report."""
    line = F.format_string("%4d %8s %8s %8d %8d %10s", "page", fixed(F.col("cer"), 4), fixed(F.col("wer"), 4), "char_distance", "word_distance", F.left("status", F.lit(10)))
    return pages.select("doc", "model", "page", line.alias("line"))


#: Headings of the console report, and the lengths of their rules.
REFERENCE_LINE = "Referencia: %s | paginas=%d | chars=%d | words=%d"
MODEL_HEADINGS, MODEL_RULE = ("Modelo", "CER", "WER", "DistC", "DistW", "Tempo(s)", "Falhas", "Faltantes", "Extras"), 97
PAGE_HEADINGS, PAGE_RULE = ("Pag", "CER", "WER", "DistC", "DistW", "Status"), 56


def console_report(reference: DataFrame, board: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc, n, line: the whole console report of each doc, in order of n from 1.

    reference: doc, file_name, page_count, total_char_count, total_word_count. board: as of leaderboard. pages: as of page_metrics, for the longer form.
    """
    heads = ["%-20s %8s %8s %8s %8s %10s %8s %10s %8s" % MODEL_HEADINGS, "-" * MODEL_RULE]
    about = F.format_string(REFERENCE_LINE, "file_name", "page_count", "total_char_count", "total_word_count")
    place = lambda rank, part, page: F.struct(rank.cast("int").alias("rank"), part.cast("int").alias("part"), page.cast("int").alias("page"))
    none = F.lit(0)
    first = reference.select("doc", F.posexplode(F.array(about, F.lit(""), *[F.lit(h) for h in heads])).alias("at", "line")).select("doc", place(none - 1, F.col("at"), none).alias("place"), "line")
    parts = [first, console_lines(board).select("doc", place(none, F.col("rank"), none).alias("place"), "line")]
    if pages is not None:
        titles = F.array(F.lit(""), F.concat(F.lit("["), F.col("model"), F.lit("]")), F.lit("%4s %8s %8s %8s %8s %10s" % PAGE_HEADINGS), F.lit("-" * PAGE_RULE))
        parts.append(board.select("doc", "rank", F.posexplode(titles).alias("at", "line")).select("doc", place(F.col("rank"), F.col("at") - 4, none).alias("place"), "line"))
        listed = console_page_lines(pages).join(board.select("doc", "model", "rank"), ["doc", "model"])
        parts.append(listed.select("doc", place(F.col("rank"), none, F.col("page")).alias("place"), "line"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("place")).alias("n"), "line")
