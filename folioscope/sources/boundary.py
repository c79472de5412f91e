"""What surrounds an extraction engine: results of any shape, page renderers with fallback, checks before a run.

Engines and renderers themselves are not part of this package; their libraries are used if they are installed. Everything
here is plain Python that runs inside a task (or before a run), and works with stand-ins in tests.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- results of any shape


#: What needs no unpacking.
_BASIC = (Mapping, list, tuple, str, bytes, int, float, type(None))
#: How an object may hand over what it holds, the first that it has counts. The last may be text in JSON.
OFFERED = ("tolist", "item", "res", "data", "to_dict", "asdict", "json")


def plain(value: Any) -> Any:
    """An engine's result as mappings, lists and scalars, taken out of objects by OFFERED as often as it takes; an object that offers nothing is the mapping of its public attributes."""
    while not isinstance(value, _BASIC):
        offered = [n for n in OFFERED if hasattr(value, n)]
        if not offered:
            return {k: v for k, v in getattr(value, "__dict__", {}).items() if k[0] != "_"} or value
        held = getattr(value, offered[0])
        value = held() if callable(held) else held
        if offered[0] == "json" and isinstance(value, str):
            value = json.loads(value)
    return value


def number(value: Any, default: float = 0.0) -> float:
    try:
        return float(plain(value))
    except (TypeError, ValueError):
        return default


def corners(box: Any) -> list[tuple[float, float]]:
    """Points of a box in any nesting: a list of four numbers is two opposite corners, one of two numbers a point; all else holds further lists or nothing."""
    found, waiting = [], [box]
    while waiting:
        part = plain(waiting.pop())
        if not isinstance(part, list | tuple):
            continue
        if len(part) in (2, 4) and all(isinstance(v, int | float) for v in part):
            found += [(float(part[i]), float(part[i + 1])) for i in range(0, len(part), 2)]
        else:
            waiting += reversed(part)
    return found


def is_box(value: Any) -> bool:
    """Numbers alone, in any nesting, with a corner among them; a line of a page, which holds its text, is none."""
    value = plain(value)
    only = lambda v: isinstance(v, int | float) or isinstance(v, list | tuple) and all(map(only, v))
    return isinstance(value, list | tuple) and only(value) and bool(corners(value))


#: The names under which an answer's parts come, in the order in which they count.
TEXTS, SCORES, BOXES = ("rec_texts", "texts"), ("rec_scores", "scores"), ("rec_boxes", "rec_polys", "dt_polys", "boxes")


def _first(found: Mapping, *names: str, default: Any = None) -> Any:
    return next((found[n] for n in names if found.get(n) is not None), default)


def results(answer: Any, place: int = 0) -> Iterator[tuple[int, str, float, Any]]:
    """(place, text, confidence, box) of an answer: a text; a box with its text; a mapping with parallel lists, with one text, or
    with another answer under res; a list of answers, to any depth."""
    match plain(answer):
        case str(text):
            yield place, text, 0.0, None
        case {"res": inner} if (found := list(results(inner))):
            yield from found
        case Mapping() as m if _first(m, *TEXTS) is not None and "res" not in m:
            texts = plain(_first(m, *TEXTS))
            scores, boxes = (plain(_first(m, *names, default=[])) for names in (SCORES, BOXES))
            at = lambda values, i: values[i] if isinstance(values, list | tuple) and i < len(values) else None
            for i, text in enumerate(texts if isinstance(texts, list | tuple) else [texts]):
                yield i, str(text or ""), number(at(scores, i)), at(boxes, i)
        case {"text": str(text)} as m:
            yield 0, text, number(_first(m, "score", "confidence")), _first(m, "box", "bbox")
        case [box, said, *_] if is_box(box):
            match plain(said):
                case [text, *rest]:
                    yield place, str(text), number(rest[0] if rest else 0.0), box
                case []:
                    yield place, "", 0.0, box
                case text:
                    yield place, str(text or ""), 0.0, box
        case list() | tuple() as parts:
            for i, part in enumerate(parts):
                own = plain(part)
                yield from results(own, i if isinstance(own, list | tuple) and own and is_box(own[0]) else 0)


ITEM = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("confidence", "left", "top", "right", "bottom")]]))


def boxed(answer: Any) -> list[tuple]:
    """ITEM's fields of an answer's texts; a text without a box gets one below the earlier ones, eight units a character wide."""
    found = []
    for place, text, confidence, box in results(answer):
        if not text.strip():
            continue
        at = corners(box)
        if at:
            (left, top), (right, bottom) = ([f(c) for c in zip(*at)] for f in (min, max))
        else:
            left, top, right, bottom = 0.0, 20.0 * place, max(1.0, 8.0 * len(text.strip())), 20.0 * place + 10.0
        found.append((place, text.strip(), confidence, left, top, right, bottom))
    return found


@F.udf(ITEM, useArrow=True)
def boxes_of_answer(answer: str | None):
    """boxed of an answer in JSON; null without one. What confidence drops is up to quality.confident."""
    return None if answer is None else boxed(json.loads(answer))


# ---- page renderers

Renderer = Callable[[bytes, int], list[tuple[int, int, bytes]]]


def render_with_fallback(content: bytes, dpi: int, renderers: Mapping[str, Renderer], wanted: str = "auto") -> list[tuple[int, int, bytes]]:
    """(width, height, image) of each page by the wanted renderer, or by the first of all that works; a document without pages is a failure.

    The error names what each renderer that was tried said. An unknown name is an error at once.
    """
    name = wanted.strip().lower()
    if name not in ("auto", *renderers):
        raise ValueError(f"unknown page renderer {wanted!r}: auto, {', '.join(renderers)}")
    said = []
    for own, render in renderers.items():
        if name in ("auto", own):
            try:
                if pages := render(content, dpi):
                    return pages
                said.append(f"{own}: no pages")
            except Exception as e:  # noqa: BLE001  the next renderer may work
                said.append(f"{own}: {e}")
    raise RuntimeError("no page renderer worked: " + " | ".join(said))


def _jpeg(image) -> tuple[int, int, bytes]:
    import io

    out = io.BytesIO()
    image.convert("RGB").save(out, "JPEG", quality=92)
    return image.width, image.height, out.getvalue()


def render_in_process(content: bytes, dpi: int) -> list[tuple[int, int, bytes]]:
    """By the public pypdfium2 library, at dpi / 72."""
    import pypdfium2

    document = pypdfium2.PdfDocument(content)
    return [_jpeg(document[i].render(scale=max(dpi, 1) / 72).to_pil()) for i in range(len(document))]


def render_by_tool(content: bytes, dpi: int, folder: str | None = None) -> list[tuple[int, int, bytes]]:
    """By the public pdf2image library, whose tool is looked for in folder."""
    from pdf2image import convert_from_bytes

    return [_jpeg(image) for image in convert_from_bytes(content, dpi=dpi, thread_count=max(1, (os.cpu_count() or 2) // 2), poppler_path=folder)]


RENDERERS: dict[str, Renderer] = {"in_process": render_in_process, "tool": render_by_tool}


def tool_folder(tool: str, named: list[str], usual: list[str], which=shutil.which) -> str | None:
    """Folder of a renderer's tool: of the settings in named the first that has it (a setting may name the tool itself); none if it is on the path; else the first of usual."""

    def has(place: str) -> str | None:
        folder = os.path.dirname(place) if os.path.isfile(place) else place
        return folder if os.path.exists(os.path.join(folder, tool)) else None

    found = [has(os.path.expanduser(p)) for p in named if p.strip()]
    if not any(found) and which(tool):
        return None
    return next((f for f in [*found, *(has(os.path.expanduser(p)) for p in usual)] if f), None)


def rendered_or_reused(files: DataFrame, images: DataFrame | None = None, dpi: int = 220, renderers: Mapping[str, Renderer] | None = None, wanted: str = "auto") -> DataFrame:
    """path, page, image_file, width, height, image, reused of documents (binaryFile rows of path, content).

    Documents that have pages in images (path, image_file, image; jpg before png) keep these, numbered in order of their
    names; only the others are rendered, a task at a time. Pages are numbered from 1 and named page_0001.jpg and so on.
    """
    renderers = dict(renderers or RENDERERS)
    schema = "path string, page int, image_file string, width int, height int, image binary, reused boolean"

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                for n, (width, height, image) in enumerate(render_with_fallback(bytes(content), dpi, renderers, wanted), 1):
                    rows.append((path, n, f"page_{n:04d}.jpg", width, height, image, False))
            yield pd.DataFrame(rows, columns=["path", "page", "image_file", "width", "height", "image", "reused"])

    if images is None:
        return files.select("path", "content").mapInPandas(run, schema)
    kinds = images.withColumn("kind", F.lower(F.regexp_extract("image_file", r"\.([^.]+)\z", 1))).where("kind IN ('jpg', 'png')")
    first = kinds.groupBy(F.col("path").alias("of")).agg(F.min("kind").alias("chosen"))
    kept = kinds.join(first, (F.col("path") == F.col("of")) & (F.col("kind") == F.col("chosen")))
    kept = kept.withColumn("page", F.row_number().over(Window.partitionBy("path").orderBy("image_file")))
    none = F.lit(None).cast("int")
    kept = kept.select("path", "page", "image_file", none.alias("width"), none.alias("height"), "image", F.lit(True).alias("reused"))
    open_ = files.select("path", "content").join(first, F.col("path") == F.col("of"), "left_anti")
    return kept.unionByName(open_.mapInPandas(run, schema))


# ---- checks before a run


def check_model(wanted: str, available: list[str]) -> None:
    """The model is there by its name, or by its name before the colon."""
    names = {n for n in available if n}
    if wanted not in names and wanted.split(":")[0] not in {n.split(":")[0] for n in names}:
        raise RuntimeError(f"model {wanted!r} is not available: {', '.join(sorted(names)) or 'none is'}")


def check_languages(wanted: list[str], available: list[str]) -> None:
    missing = [x for x in wanted if x not in available]
    if missing:
        raise RuntimeError(f"languages {', '.join(missing)} are not available: {', '.join(sorted(available)) or 'none is'}")


def device(wanted: bool | None, accelerator: bool) -> tuple[bool, str | None]:
    """(whether to use the accelerator, a warning): as asked for if there is one; if nothing is asked for, whenever there is one."""
    if wanted and not accelerator:
        return False, "an accelerator was asked for, but there is none"
    return (accelerator if wanted is None else wanted), None


def tool_command(named: str | None, wrapper: str, tool: str, which=shutil.which) -> str:
    """The command of an engine's tool: the one named, a wrapper that exists, the one on the path, or its bare name."""
    return (named or "").strip() or (wrapper if os.path.exists(wrapper) else which(tool) or tool)


def first_constructor(build: Callable, variants: list[dict]) -> Any:
    """build with the first settings that its version accepts; the error tells of the last six variants."""
    said = []
    for settings in variants:
        try:
            return build(**settings)
        except Exception as e:  # noqa: BLE001  versions reject settings in different ways
            said.append(f"{settings}: {e}")
    raise RuntimeError("no variant of the settings worked: " + " | ".join(said[-6:]))
