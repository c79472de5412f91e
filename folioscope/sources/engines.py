"""The boundary to extraction engines, page renderers and image filters.

An engine is anything with recognise(pages) -> results over an iterator of pandas frames; it runs inside mapInPandas, so
it loads once a task and streams. What it returns for a page is text or raw boxes; everything after that is in operators.
Engines and renderers themselves are not part of this package; image filters are in operators.images.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import engine_text, let, strip
from folioscope.operators.quality import RETRYABLE

ATTEMPT_SCHEMA = "text string, error string, warnings array<string>, processing_seconds double"


class OcrEngine(Protocol):
    def open(self) -> None:
        """Loads models and validates settings; called once a task."""

    def recognise(self, page: dict) -> str:
        """The text of a page or band (a dict of its columns); raises if it can't."""


#: How often one page's call is made again at most, so that a page which always fails doesn't use up what all share.
REPEATS_A_PAGE = 2


class _Calls:
    """Calls of one task: at most `in_flight` at once, results in the order of the pages, and a budget of repeats that all calls share.

    A call that takes longer than the deadline becomes an error and is left to end by itself; its place is free again.
    """

    def __init__(self, recognise: Callable[[dict], str], in_flight: int, deadline: float | None, repeats: int):
        self.recognise, self.in_flight, self.deadline, self.repeats = recognise, max(1, in_flight), deadline, repeats
        self.lock = threading.Lock()

    def _may_repeat(self) -> bool:
        with self.lock:
            self.repeats -= 1
            return self.repeats >= 0

    def _call(self, page: dict, answer: dict) -> None:
        for left in range(REPEATS_A_PAGE, -1, -1):
            try:
                answer["text"], answer["error"] = self.recognise(page), None
            except Exception as e:  # noqa: BLE001  any failure of an engine is a page's error
                answer["text"], answer["error"] = "", str(e)
                if left and self._may_repeat():
                    continue
            break
        answer["seconds"] = time.perf_counter() - answer["began"]
        answer["done"].set()

    def _ended(self, answer: dict) -> tuple[str, str | None, list, float]:
        left = None if self.deadline is None else max(0.0, answer["began"] + self.deadline - time.perf_counter())
        if answer["done"].wait(left):
            return answer["text"], answer["error"], [], answer["seconds"]
        return "", f"no answer within {self.deadline:g} s", [], time.perf_counter() - answer["began"]

    def run(self, pages: list[dict]) -> list[tuple[str, str | None, list, float]]:
        flying, made = deque(), []
        for page in pages:
            if len(flying) == self.in_flight:
                made.append(self._ended(flying.popleft()))
            answer = {"began": time.perf_counter(), "done": threading.Event()}
            threading.Thread(target=self._call, args=(page, answer), daemon=True).start()
            flying.append(answer)
        return made + [self._ended(answer) for answer in flying]


def run_engine(pages: DataFrame, engine: OcrEngine, in_flight: int = 1, deadline: float | None = None, repeats: int = 0) -> DataFrame:
    """pages with ATTEMPT_SCHEMA's columns. An exception becomes the row's error and never ends the run.

    An engine that waits for others, such as a model server, can answer several pages of a task at once (in_flight; recognise is then called from several
    threads). deadline: seconds a page may take, its repeats included. repeats: how many failed calls of a task are made again, in all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine.open()
        calls = _Calls(engine.recognise, in_flight, deadline, repeats)
        for frame in frames:
            made = calls.run(frame.to_dict("records"))
            yield frame.assign(**dict(zip(("text", "error", "warnings", "processing_seconds"), map(list, zip(*made)) if made else ([], [], [], []))))

    kept = [c for c in pages.columns if c not in ("text", "error", "warnings", "processing_seconds")]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + [ATTEMPT_SCHEMA])
    return pages.select(*kept).mapInPandas(run, schema)


def first_answer(recognise: Callable, candidates: list, generic: Callable[[str], bool]) -> str:
    """The first candidate's text that is not generic; else the last error, or the last text."""
    text, error = "", None
    for c in candidates:
        try:
            text = recognise(c)
            if text and not generic(text):
                return text
        except Exception as e:  # noqa: BLE001
            error = e
    if not text and error:
        raise error
    return text


def first_working(calls: list[Callable], *args):
    """The result of the first call that works; engines' interfaces differ between versions. Else the last error."""
    error: Exception = RuntimeError("no call was given")
    for call in calls:
        try:
            return call(*args)
        except (AttributeError, TypeError) as e:
            error = e
    raise error


def last_attempts(errors: Column, n: int = 6) -> Column:
    """The last n entries of a list of attempts, for an error text."""
    return F.slice(errors, F.greatest(F.size(errors) - n + 1, F.lit(1)), F.lit(n))


def with_retries(request: Callable[[], tuple[int, str]], attempts: int, backoff: float, sleep=time.sleep) -> str:
    """A request's body; codes that may pass, and requests that fail without an answer, are tried again after backoff * 2 ** attempt seconds."""
    for attempt in range(attempts):
        last = attempt == attempts - 1
        try:
            status, answer = request()
        except Exception as e:  # noqa: BLE001  a connection fails in many ways
            if last:
                raise RuntimeError(f"no answer: {e}") from e
        else:
            if status < 400:
                return answer
            if status not in RETRYABLE or last:
                raise RuntimeError(f"HTTP {status}: {answer}")
        sleep(backoff * 2**attempt)
    raise RuntimeError("no attempt was made")


def render_pages(files: DataFrame, renderer: Callable[[bytes], list[tuple[int, int, bytes]]]) -> DataFrame:
    """path, page, width, height, image of binaryFile rows: one row a rendered page, numbered from 1."""

    def run(frames):
        for frame in frames:
            rows = [(p, n, w, h, image) for p, content in zip(frame.path, frame.content) for n, (w, h, image) in enumerate(renderer(bytes(content)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "width", "height", "image"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, width int, height int, image binary")


def cloud_response_to_text(payload: Column, header: bool = True, footer: bool = True) -> Column:
    """struct(text, summary) of a cloud answer (JSON): pages' header, markdown and footer joined by blank lines, cleaned of markup.

    Pages that are no objects count, but say nothing. An answer without a list of pages, or with an empty one, is an
    error. summary keeps usage_info as JSON where it is an object.
    """

    def of(answer: Column) -> Column:
        listed = F.try_variant_get(answer, "$.pages", "array<variant>")
        checked = F.when(F.coalesce(F.size(listed), F.lit(0)) <= 0, F.raise_error(F.lit("the answer holds no pages"))).otherwise(listed)
        usage = F.try_variant_get(answer, "$.usage_info", "variant")
        return F.struct(checked.alias("pages"), F.when(F.schema_of_variant(usage).startswith("OBJECT"), F.to_json(usage)).alias("usage_info"))

    def said(p: Column, key: str, on: bool = True) -> Column:
        text = strip(F.try_variant_get(p, f"$.{key}", "string"))
        return F.when(F.lit(on) & (text != ""), text)

    def page(p: Column) -> Column:
        listed = lambda key: F.greatest(F.coalesce(F.size(F.try_variant_get(p, f"$.{key}", "array<variant>")), F.lit(0)), F.lit(0))
        return F.struct(
            F.concat_ws("\n\n", said(p, "header", header), said(p, "markdown"), said(p, "footer", footer)).alias("text"),
            F.try_variant_get(p, "$.index", "int").alias("index"),
            listed("tables").alias("tables"), listed("images").alias("images"), listed("hyperlinks").alias("hyperlinks"),
        )

    def summed(answer: Column) -> Column:
        objects = F.filter(answer["pages"], lambda p: F.schema_of_variant(p).startswith("OBJECT"))
        pages = F.struct(F.transform(objects, page).alias("said"), F.size(answer["pages"]).alias("n"), answer["usage_info"].alias("usage_info"))

        def told(x: Column) -> Column:
            total = lambda field: F.aggregate(x["said"], F.lit(0), lambda a, p: a + p[field]).alias(f"{field}_count")
            indices = F.filter(F.transform(x["said"], lambda p: p["index"]), lambda i: i.isNotNull())
            text = F.array_join(F.filter(F.transform(x["said"], lambda p: p["text"]), lambda t: t != ""), "\n\n")
            summary = F.struct(x["n"].alias("response_pages_count"), indices.alias("response_page_indices"), total("tables"), total("images"), total("hyperlinks"), x["usage_info"].alias("usage_info"))
            return F.struct(text.alias("raw"), summary.alias("summary"))

        return let(pages, told)

    found = let(let(F.parse_json(payload), of), summed)
    return F.struct(engine_text(found["raw"], markup=True).alias("text"), found["summary"].alias("summary"))


def chat_response_to_text(payload: Column) -> Column:
    """The content of a local model server's answer (JSON): of its message, or of response where there is a message that is no object."""

    def of(answer: Column) -> Column:
        message = F.try_variant_get(answer, "$.message", "variant")
        other = message.isNotNull() & ~F.schema_of_variant(message).startswith("OBJECT")
        return strip(F.coalesce(F.when(other, F.try_variant_get(answer, "$.response", "string")).otherwise(F.try_variant_get(answer, "$.message.content", "string")), F.lit("")))

    return F.coalesce(let(F.try_parse_json(payload), of), F.lit(""))


def error_message(payload: Column, default: str = "Erro desconhecido.") -> Column:
    """The first message that a JSON error body holds."""
    v = F.try_parse_json(payload)

    def said(path: str) -> Column:
        of = F.try_variant_get(v, path, "variant")
        text = strip(F.try_variant_get(v, path, "string"))
        return F.when((F.schema_of_variant(of) == "STRING") & (text != ""), text)

    plain = F.when(v.isNull(), F.nullif(strip(payload), F.lit("")))
    return F.coalesce(*[said(f"$.{k}") for k in ("message", "detail", "error", "title")], *[said(f"$.error.{k}") for k in ("message", "detail", "type")], said("$"), plain, F.lit(default))


def data_url(image: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(image))


def boxes_of_parallel_arrays(payload: Column) -> Column:
    """array of struct(idx, text, confidence, box) of a JSON answer with parallel arrays, perhaps wrapped in res; short arrays give 0.0 and null."""
    parts = "rec_texts:array<string>,texts:array<string>,rec_scores:array<double>,scores:array<double>,rec_boxes:array<array<double>>,boxes:array<array<double>>"
    r = F.from_json(payload, f"struct<res:struct<{parts}>,{parts}>")
    field = lambda *names: F.coalesce(*[r["res"][n] for n in names], *[r[n] for n in names])
    texts, scores, boxes = field("rec_texts", "texts"), field("rec_scores", "scores"), field("rec_boxes", "boxes")
    return F.transform(texts, lambda t, i: F.struct(i.alias("idx"), t.alias("text"), F.coalesce(F.get(scores, i), F.lit(0.0)).alias("confidence"), F.get(boxes, i).alias("box")))


def boxes_of_legacy_lists(payload: Column) -> Column:
    """array of struct(idx, text, confidence, box) of [box, [text, confidence]] lists (JSON), also one level deeper, a list a page."""
    v = F.try_parse_json(payload)
    flat = F.try_variant_get(v, "$", "array<variant>")
    deeper = F.flatten(F.transform(flat, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))))
    items = F.when(F.try_variant_get(v, "$[0][0][1][0]", "string").isNotNull() & F.try_variant_get(v, "$[0][1][1]", "double").isNull(), deeper).otherwise(flat)
    read = lambda x, i: F.struct(i.alias("idx"), F.try_variant_get(x, "$[1][0]", "string").alias("text"), F.coalesce(F.try_variant_get(x, "$[1][1]", "double"), F.lit(0.0)).alias("confidence"), F.try_variant_get(x, "$[0]", "array<array<double>>").alias("box"))
    return F.filter(F.transform(items, read), lambda b: b["text"].isNotNull())


def words_of_parallel_arrays(data: DataFrame, keys=("page",)) -> DataFrame:
    """keys, idx and the fields of each word, of rows with parallel arrays of strings; short arrays give the default, word_num its place.

    A word with a field that is no number is dropped, as is one without text.
    """
    defaults = {"left": "0", "top": "0", "width": "0", "height": "0", "block_num": "0", "par_num": "0", "line_num": "0", "word_num": None}
    at = lambda c: F.get(F.col(c), F.col("idx"))
    rows = data.select("*", F.posexplode("text").alias("idx", "word"))
    fields = {c: F.coalesce(at(c), F.lit(d) if d is not None else F.col("idx").cast("string")).try_cast("double").cast("int") for c, d in defaults.items()}
    rows = rows.select(*keys, "idx", engine_text(F.col("word"), markup=False).alias("text"), F.coalesce(at("conf").try_cast("double"), F.lit(-1.0)).alias("conf"), *[f.alias(c) for c, f in fields.items()])
    known = [F.col(c).isNotNull() for c in fields]
    ok = F.col("text") != ""
    for k in known:
        ok = ok & k
    return rows.where(ok)
