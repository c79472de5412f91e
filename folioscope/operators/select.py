"""Choosing among attempts, and the staged cascade that makes them.

Spark evaluates Python functions for all rows of a stage, so a cheaper attempt that suffices must end a page's way: each
stage of the cascade runs on the pages that are still open only, and is written before the next one reads it. An open page
carries its best attempt so far in columns of its own, so no stage groups, joins or shuffles texts. Attempts that are rows of
their own are grouped by best_attempt; those in one row are chosen from by best_of, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import dedupe_lines, let, score_text
from folioscope.operators.quality import judgement, with_suspicion

#: Columns of an attempt beside its keys.
ATTEMPT = ("idx", "mode", "text", "score", "suspicious", "warnings", "error")


def _best(order: list[Column]) -> Column:
    """The attempt that is largest in order; the earliest of equals."""
    return F.max_by(F.struct(*ATTEMPT), F.struct(*order, (-F.col("idx")).alias("first")))


def best_attempt(attempts: DataFrame, keys=("doc", "page"), tiered: bool = False) -> DataFrame:
    """The attempt of the best score among those with a text; without any text the last attempt.

    tiered puts attempts that are not suspicious before all others.
    """
    filled = F.coalesce(F.col("text"), F.lit("")) != ""
    trusted = [(filled & ~F.coalesce("suspicious", F.lit(False))).alias("trusted")] if tiered else []
    score = F.when(filled, F.coalesce("score", F.lit(0.0)))
    # without a text the score is null and the last idx wins
    last = F.when(filled, F.lit(0)).otherwise(F.col("idx") * 2)
    chosen = attempts.groupBy(*keys).agg(_best([*trusted, filled.alias("filled"), score.alias("score"), last.alias("last")]).alias("best"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "warnings"))), lambda a: F.coalesce(a["warnings"], F.array().cast("array<string>")))).alias("all_warnings"), _errors().alias("all_errors"))
    return chosen.select(*keys, *[F.col(f"best.{c}").alias(c) for c in ATTEMPT if c not in ("warnings", "error")], F.col("all_warnings").alias("warnings"), F.when(F.col("best.text") == "", F.col("all_errors")).alias("error"))


def best_of(attempts: Column, tiered: bool = False) -> Column:
    """best_attempt of an array of attempts in order of idx (structs with ATTEMPT's fields), as a struct; null for an empty array."""

    def ranked(a: Column, place: Column) -> Column:
        filled = F.coalesce(a["text"], F.lit("")) != ""
        trusted = [(filled & ~F.coalesce(a["suspicious"], F.lit(False))).alias("trusted")] if tiered else []
        # of equals the first, without any text the last
        return F.struct(*trusted, filled.alias("filled"), F.when(filled, F.coalesce(a["score"], F.lit(0.0))).alias("score"), F.when(filled, -place).otherwise(place).alias("turn"), place.alias("place"))

    def told(all_: Column) -> Column:
        best = all_[F.array_max(F.transform(all_, ranked))["place"]]
        warnings = F.flatten(F.transform(all_, lambda a: F.coalesce(a["warnings"], F.array().cast("array<string>"))))
        failed = F.transform(F.filter(all_, lambda a: F.coalesce(a["error"], F.lit("")) != ""), lambda a: F.concat_ws(": ", a["mode"], a["error"]))
        kept = [best[c].alias(c) for c in ATTEMPT if c not in ("warnings", "error")]
        return F.struct(*kept, warnings.alias("warnings"), F.when(best["text"] == "", F.array_join(failed, " | ")).alias("error"))

    return let(F.when(F.size(attempts) > 0, attempts), lambda all_: F.when(all_.isNotNull(), told(all_)))


def _errors() -> Column:
    """mode: error of the attempts that failed, in order, joined by |."""
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull() & (F.col("error") != ""), F.struct("idx", F.concat_ws(": ", "mode", "error").alias("e")))))
    return F.array_join(F.transform(failed, lambda a: a["e"]), " | ")


def merge_bands(bands: DataFrame, keys=("doc", "page", "height_idx"), counts: tuple[str, ...] = ()) -> DataFrame:
    """text of each key: the non-empty band texts in order of band, one a line, repeated lines dropped. Keys without text drop out.

    With counts (columns of what each band's answer holds, such as tables_count) also bands_count and their sums over the bands that have a text; what is no number counts as 0.
    """
    filled = F.coalesce("text", F.lit("")) != ""
    parts = F.array_sort(F.collect_list(F.when(filled, F.struct("band", "text"))))
    sums = [F.sum(F.when(filled, F.coalesce(F.col(c).cast("string").try_cast("long"), F.lit(0)))).alias(c) for c in counts]
    rows = bands.groupBy(*keys).agg(parts.alias("parts"), *sums).where(F.size("parts") > 0)
    joined = rows.withColumn("joined", F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    told = [F.size("parts").alias("bands_count"), *counts] if counts else []
    return joined.select(*keys, dedupe_lines(F.col("joined")).alias("text"), *told)


def best_height(merged: DataFrame, keys=("doc", "page"), tiered: bool = False) -> DataFrame:
    """Of merged texts (height_idx, text, suspicious) the best score among the heights tried: up to the first that is not generic.

    tiered: a suspicious text scores 0 and does not end the search, and 0 is never chosen.
    """
    suspicious = F.coalesce("suspicious", F.lit(False)) if tiered and "suspicious" in merged.columns else F.lit(False)
    rows = merged.dropna(subset=list(keys)).select(*keys, "height_idx", "text", suspicious.alias("suspicious"), judgement(F.col("text")).alias("j"))
    one = F.struct(F.when(F.col("suspicious"), F.lit(0.0)).otherwise(F.col("j.score")).alias("score"), (-F.col("height_idx")).alias("turn"), "height_idx", "text", (~F.col("j.generic") & ~F.col("suspicious")).alias("ends"))
    # a key's few heights meet once: each text is judged once and shuffled once
    met = rows.groupBy(*keys).agg(F.collect_list(one).alias("all"), F.min(F.when(~F.col("j.generic") & ~F.col("suspicious"), F.col("height_idx"))).alias("stop"))
    best = met.select(*keys, F.array_max(F.filter("all", lambda a: (F.col("stop").isNull() | (a["height_idx"] <= F.col("stop"))) & (a["score"] > 0))).alias("b")).where("b IS NOT NULL")
    return best.select(*keys, F.col("b.text").alias("text"), F.col("b.score").alias("score"), F.col("b.height_idx").alias("height_idx"))


def judged(attempts: DataFrame, suspicion: bool) -> DataFrame:
    """Raw attempts (keys, idx, mode, text, error, warnings, width, height) with score and suspicious."""
    if suspicion:
        attempts = with_suspicion(attempts, "text", "width", "height")
    else:
        attempts = attempts.withColumn("suspicious", F.lit(False))
    return attempts.withColumn("score", F.when(F.col("suspicious"), F.lit(0.0)).otherwise(score_text(F.col("text"))))


#: What an open page of the cascade carries of its best attempt so far, of all warnings and of all errors.
_CARRIED = {
    "best_idx": "int", "best_mode": "string", "best_text": "string", "best_score": "double", "best_suspicious": "boolean", "best_warnings": "array<string>", "best_errors": "array<string>",
}


def _carried_on(rows: DataFrame, suspicion: bool) -> DataFrame:
    """rows (of one stage, judged, with _CARRIED) with the better of the new attempt and the carried one, and closed: whether the new one is taken and acceptable."""
    filled, had = (F.coalesce(c, F.lit("")) != "" for c in ("text", "best_text"))
    trusted, was = ~F.coalesce("suspicious", F.lit(False)), ~F.coalesce("best_suspicious", F.lit(False))
    higher = F.coalesce("score", F.lit(0.0)) > F.coalesce("best_score", F.lit(0.0))
    ahead = F.when(trusted == was, higher).otherwise(trusted) if suspicion else higher
    rows = rows.withColumn("better", F.when(filled & had, ahead).otherwise(filled | ~had))
    none = F.array().cast("array<string>")
    new = {f"best_{c}": F.when(F.col("better"), F.col(c)).otherwise(F.col(f"best_{c}")) for c in ("idx", "mode", "text", "score", "suspicious")}
    error = F.when(F.coalesce("error", F.lit("")) != "", F.array(F.concat_ws(": ", "mode", "error"))).otherwise(none)
    new |= {"best_warnings": F.concat("best_warnings", F.coalesce("warnings", none)), "best_errors": F.concat("best_errors", error)}
    return rows.withColumns(new | {"closed": F.col("better") & F.col("acceptable") & trusted})


def cascade(pages: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], write: Callable[[DataFrame, str], DataFrame], keys=("doc", "page"), suspicion: bool = False) -> DataFrame:
    """The best attempt of each page. A stage gets the open pages and returns them, all columns, with text, error and warnings.

    After each stage a page is closed if its best attempt so far is acceptable. write(df, name) must materialize df. Pages have no columns whose
    names begin with best_; what a closed page needs no more isn't written again.
    """
    own = [c for c in pages.columns if c not in keys]
    empty = {c: F.array().cast(t) if t.startswith("array") else F.lit(None).cast(t) for c, t in _CARRIED.items()}
    still, ended = pages.withColumns(empty), []
    for idx, (mode, run) in enumerate(stages):
        made = run(still).withColumns({"idx": F.lit(idx), "mode": F.lit(mode)})
        made = with_suspicion(made, "text", "width", "height") if suspicion else made.withColumn("suspicious", F.lit(False))
        made = made.withColumn("judged", judgement(F.col("text")))
        made = made.withColumns({"score": F.when(F.col("suspicious"), F.lit(0.0)).otherwise(F.col("judged.score")), "acceptable": F.col("judged.acceptable")})
        rows = _carried_on(made, suspicion)
        rows = write(rows.select(*keys, *[F.when(~F.col("closed"), F.col(c)).alias(c) for c in own], *_CARRIED, "closed"), f"attempt-{idx}")
        ended.append(rows.where("closed"))
        still = rows.where("NOT closed").drop("closed")
    last = reduce(DataFrame.unionByName, [r.select(*keys, *_CARRIED) for r in (*ended, still)])
    error = F.when(F.col("best_text") == "", F.array_join("best_errors", " | "))
    return last.select(*keys, *[F.col(f"best_{c}").alias(c) for c in ATTEMPT if c not in ("warnings", "error")], F.col("best_warnings").alias("warnings"), error.alias("error"))
