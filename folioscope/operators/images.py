"""Page images as rows: keys, width, height, pixels (bytes, row after row, one a pixel or three for RGB).

Pixels travel through Arrow in batches of a bounded number of bytes, so a worker holds a few pages, however many a task has; bands are cut in the JVM.
Small pages of one size that meet in such a batch are filtered together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import geometry, pixels

#: Bytes of pixels that are taken and given back at once.
TOGETHER = 16 << 20
#: Pixels and numbers in tables of the images that are filtered together, so that they stay near the processor.
STACK = 1 << 19

Filter = Callable[[list[np.ndarray | None], list[dict]], list[np.ndarray | None]]


def _array(data: bytes, width: int, height: int) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8)
    return flat.reshape(height, width) if flat.size == width * height else flat.reshape(height, width, 3)


def _attempt(apply: Callable[..., np.ndarray], *of) -> np.ndarray | None:
    try:
        return apply(*of)
    except Exception:  # noqa: BLE001  a page that can't be filtered is recognised as it is
        return None


def _each(apply: Callable[[np.ndarray, dict], np.ndarray]) -> Filter:
    return lambda arrays, rows: [None if a is None else _attempt(apply, a, row) for a, row in zip(arrays, rows)]


def _filtered(images: DataFrame, apply: Filter, reads: tuple[str, ...] = ()) -> DataFrame:
    """images with what apply makes of some at once, and filtered: whether it did. An image that fails, as one whose bytes don't fit its size, stays as it is."""
    kept = [c for c in images.columns if c not in ("width", "height", "pixels", "filtered")]
    schema = ", ".join([f"`{c}` {images.schema[c].dataType.simpleString()}" for c in kept] + ["width int", "height int", "pixels binary", "filtered boolean"])
    types = {"width": pa.int32(), "height": pa.int32(), "pixels": pa.binary(), "filtered": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in ("width", "height", "pixels", *reads)}
            rows, size, start = [], 0, 0

            def out(stop: int) -> pa.RecordBatch:
                found = apply([_attempt(_array, of["pixels"], of["width"], of["height"]) for of in rows], rows)
                made = [(of["width"], of["height"], of["pixels"], False) if x is None else (x.shape[1], x.shape[0], x.tobytes(), True) for of, x in zip(rows, found)]
                same = [batch.column(c).slice(start, stop - start) for c in kept]
                new = [pa.array(column, t) for column, t in zip(zip(*made), types.values())]
                return pa.RecordBatch.from_arrays([*same, *new], [*kept, *types])

            for i in range(batch.num_rows):
                rows.append({c: column[i].as_py() for c, column in columns.items()})
                size += len(rows[-1]["pixels"] or b"")
                if size >= TOGETHER:
                    yield out(i + 1)
                    rows, size, start = [], 0, i + 1
            if rows:
                yield out(batch.num_rows)

    return images.select(*kept, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels").mapInArrow(run, schema)


def _preprocessed(arrays: list[np.ndarray | None], rows: list[dict]) -> list[np.ndarray | None]:
    """pixels.preprocess of each image, in stacks of one size."""
    made, of_size = [None] * len(arrays), {}
    for i, a in enumerate(arrays):
        if a is not None and a.size:
            of_size.setdefault(a.shape[:2], []).append(i)
    for (height, width), found in of_size.items():
        n = max(1, STACK // (height * width + pixels.TABLES))
        for at in range(0, len(found), n):
            part = found[at : at + n]
            stack = _attempt(lambda part: pixels.preprocess_stack(np.stack([arrays[i] if arrays[i].ndim == 2 else pixels.gray(arrays[i]) for i in part])), part)
            for i, image in zip(part, [_attempt(pixels.preprocess, arrays[i]) for i in part] if stack is None else stack):
                made[i] = image
    return made


def preprocessed(images: DataFrame) -> DataFrame:
    """images readied for recognition by pixels.preprocess, in gray, and filtered. Null, empty or ill-sized pixels stay as they are, with filtered false."""
    return _filtered(images, _preprocessed)


def turned(images: DataFrame, degrees: str = "rotation") -> DataFrame:
    """images turned by 180 degrees where the column says so (see geometry.rotation)."""
    return _filtered(images, _each(lambda image, of: image[::-1, ::-1] if of[degrees] == 180 else image), (degrees,))


def candidates(images: DataFrame, max_dim: int = geometry.MAX_DIM, fallbacks=geometry.FALLBACK_DIMS, ascending: bool = False) -> DataFrame:
    """A row for each distinct size to try (geometry.candidate_sizes), numbered by candidate, with the pixels resampled."""
    sizes = geometry.candidate_sizes(F.col("width"), F.col("height"), max_dim, fallbacks, ascending)
    rows = images.select("*", F.posexplode(sizes).alias("candidate", "to"))

    def scale(image: np.ndarray, of: dict) -> np.ndarray:
        width, height = of["to"]["width"], of["to"]["height"]
        if image.ndim == 2:
            return pixels.resized(image, width, height)
        return np.stack([pixels.resized(image[..., c], width, height) for c in range(3)], axis=-1)

    return _filtered(rows, _each(scale), ("to",)).drop("to")


def cut_bands(images: DataFrame, limit: Column | int) -> DataFrame:
    """A row for each overlapping band (geometry.bands) of at most about limit pixels of height, numbered by band from the top."""
    of_row = F.length("pixels") / F.greatest(F.lit(1), F.col("height"))
    bands = images.select("*", F.posexplode(geometry.bands(F.col("height"), limit if isinstance(limit, Column) else F.lit(limit))).alias("band", "part"))
    start, size = F.col("part.top") * of_row, (F.col("part.bottom") - F.col("part.top")) * of_row
    bands = bands.withColumn("pixels", F.substring("pixels", (start + 1).cast("int"), size.cast("int")))
    return bands.withColumn("height", F.col("part.bottom") - F.col("part.top")).drop("part")


def image_of_text(text: Column, width: int) -> tuple[Column, Column]:
    """(height, pixels) of a text's bytes as gray values, row after row, blanks to the end; one row at least."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    height = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(width)).cast("int"))
    return height, F.rpad(data, height * width, F.lit(" ").cast("binary"))
