"""Names: files, models, labels, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import strip

#: Settings that mean yes; the palette.
YES = ("1", "true", "yes", "on", "sim")
COLORS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")


def safe_name(c: Column) -> Column:
    """A part of a file name: other characters become _, marks at the ends go, nothing left is arquivo."""
    plain = F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "_"), r"\A[._-]+|[._-]+\z", "")
    return F.when(plain == "", F.lit("arquivo")).otherwise(plain)


def output_path(root: str, model: Column, source: Column) -> Column:
    """Where a model's result for a source file goes."""
    file = F.regexp_extract(source, r"([^/]*)/*\z", 1)
    stem = F.when(file.rlike(r"\A.+\.[^.]+\z") & ~file.rlike(r"\A\.[^.]*\z"), F.regexp_replace(file, r"\.[^.]*\z", "")).otherwise(file)
    return F.concat(F.lit(f"{root.rstrip('/')}/data/extracted/"), safe_name(model), F.lit("_output_"), safe_name(stem), F.lit(".json"))


def label(model: Column, labels: dict[str, str] | None = None, families: dict[str, str] | None = None) -> Column:
    """How a chart names a model: by its id in labels, else by the first of families that its id begins with, else by its id."""
    named = [F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), model)] if labels else []
    return F.coalesce(*named, *[F.when(model.startswith(prefix), F.lit(shown)) for prefix, shown in (families or {}).items()], model)


def color(index: Column) -> Column:
    """Of the cyclic palette, from index 0."""
    return F.element_at(F.array(*[F.lit(c) for c in COLORS]), (F.pmod(index, F.lit(len(COLORS))) + 1).cast("int"))


def flag(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*YES)


def optional_flag(c: Column) -> Column:
    """A flag that may be unset: null for an absent or blank setting."""
    return F.when(strip(F.coalesce(c, F.lit(""))) != "", flag(c))


def positive_ints(c: Column) -> Column:
    """The positive integers of a comma-separated setting."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x).try_cast("int")), lambda x: x > 0)


def languages(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,+]"), strip), lambda x: x != "")


def model_id(family: str, langs: Column, suffix: Column, joiner: str = ",") -> Column:
    """family:languages:suffix, such as a device or an engine mode."""
    return F.concat_ws(":", F.lit(family), F.array_join(langs, joiner), suffix)


def keyed_engine_config(oem: int, psm: Column, preserve_spaces: bool = True, data_dir: str | None = None) -> Column:
    """Command-line settings of the engine that returns keyed words."""
    parts = [F.lit(f"--oem {oem}"), F.concat(F.lit("--psm "), psm.cast("string"))]
    parts += [F.lit("-c preserve_interword_spaces=1")] if preserve_spaces else []
    parts += [F.lit(f'--tessdata-dir "{data_dir}"')] if data_dir else []
    return F.concat_ws(" ", *parts)


def image_format(c: Column) -> Column:
    """struct(extension, encoder) of an image format; an error for others."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    of = lambda ext, enc: F.struct(F.lit(ext).alias("extension"), F.lit(enc).alias("encoder"))
    return F.when(low.isin("", "jpg", "jpeg"), of("jpg", "JPEG")).when(low == "png", of("png", "PNG")).otherwise(F.raise_error(F.concat(F.lit("unsupported image format: "), low)))
