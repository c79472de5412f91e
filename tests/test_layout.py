"""Reading order against plain loops over the boxes or words of a page."""

import random
import time

import pytest

from folioscope.operators import layout
from tests.test_text import deduped

BOXES = "doc string, page long, idx long, text string, left double, top double, bottom double"
WORDS = "page long, idx long, text string, top long, height long, block_num int, par_num int, line_num int"


def rendered(lines):
    """lines: (text, top, bottom, height, section)."""
    out, before = [], None
    for text, top, bottom, height, section in lines:
        text = text.strip()
        if not text:
            continue
        if before and (section != before[2] or top - before[0] > max(18.0, before[1] * 1.4, height * 1.2)):
            out.append("")
        out.append(text)
        before = bottom, height, section
    return deduped("\n".join(out))


def plain_boxes(boxes):
    lines = []
    for idx, text, left, top, bottom in sorted(boxes, key=lambda b: (b[3], b[2], b[0])):
        middle, height = (top + bottom) / 2, max(1.0, bottom - top)
        if lines:
            now = lines[-1]
            n = len(now)
            if abs(middle - sum(w[4] for w in now) / n) <= max(12.0, min(sum(w[5] for w in now) / n, height) * 0.65):
                now.append((left, top, idx, text, middle, height, bottom))
                continue
        lines.append([(left, top, idx, text, middle, height, bottom)])
    return rendered([(" ".join(w[3] for w in sorted(line)), min(w[1] for w in line), max(w[6] for w in line), sum(w[5] for w in line) / len(line), 0) for line in lines])


def plain_words(words):
    lines = []
    for _, text, top, height, *key in sorted(words, key=lambda w: w[0]):
        height = max(1, height)
        if lines and lines[-1]["key"] == key:
            now = lines[-1]
            now["words"].append(text)
            now["top"], now["bottom"], now["height"] = min(now["top"], top), max(now["bottom"], top + height), (now["height"] + height) / 2
        else:
            lines.append({"key": key, "words": [text], "top": top, "bottom": top + height, "height": float(height)})
    return rendered([(" ".join(line["words"]), line["top"], line["bottom"], line["height"], line["key"][:2]) for line in lines])


def test_boxes_against_plain_loops(spark):
    r = random.Random(12)
    pages = {(d, p): [(i, r.choice(["alpha", "beta", "Beta ", "...", "x 1", " "]), r.randrange(300) / 2, r.randrange(r.choice([30, 300])) * 1.5, 0) for i in range(r.randint(1, 40))] for d in ("a", "b") for p in range(60)}
    pages = {k: [(i, t, left, top, top + r.choice([-3, 8, 12.5, 30])) for i, t, left, top, _ in boxes] for k, boxes in pages.items()}
    table = spark.createDataFrame([(*k, *b) for k, boxes in pages.items() for b in boxes], BOXES).repartition(7)
    got = {(x.doc, x.page): x.text for x in layout.boxes_to_text(table, ("doc", "page")).collect()}
    assert got == {k: plain_boxes(boxes) for k, boxes in pages.items()}


def test_words_against_plain_loops(spark):
    r = random.Random(13)
    pages = {p: [(i, r.choice(["alpha", "beta", "gamma", " ", "..."]), r.randrange(200), r.randrange(-2, 40), r.randrange(2), r.randrange(2), r.randrange(2)) for i in range(r.randint(1, 40))] for p in range(150)}
    table = spark.createDataFrame([(p, *w) for p, words in pages.items() for w in words], WORDS).repartition(7)
    got = {x.page: x.text for x in layout.keyed_words_to_text(table).collect()}
    assert got == {p: plain_words(words) for p, words in pages.items()}


def test_null_keys_of_words_part_lines(spark):
    table = spark.createDataFrame([(1, 0, "a", 0, 10, 1, None, 1), (1, 1, "b", 0, 10, 1, None, 1)], WORDS)
    assert layout.keyed_words_to_text(table).first().text == "a\nb"


@pytest.mark.parametrize("kind", ["boxes", "words"])
def test_large_pages_in_proportion(spark, kind):
    """100,000 boxes on one page; ten times the boxes take less than twenty times the time."""

    def run(n):
        if kind == "boxes":
            table = spark.range(n).selectExpr("'d' AS doc", "1L AS page", "id AS idx", "concat('w', id) AS text", "(id % 10) * 9.0 AS left", "(id div 10) * 20.0 AS top", "(id div 10) * 20.0 + 10 AS bottom")
            made = layout.boxes_to_text(table, ("doc", "page"))
        else:
            made = layout.keyed_words_to_text(spark.range(n).selectExpr("1L AS page", "id AS idx", "concat('w', id) AS text", "(id div 10) * 20 AS top", "10 AS height", "1 AS block_num", "1 AS par_num", "id div 10 AS line_num"))
        began = time.perf_counter()
        text = made.first().text
        return text, time.perf_counter() - began

    run(1_000)
    _, small = run(10_000)
    text, large = run(100_000)
    assert text.split("\n") == [" ".join(f"w{i * 10 + j}" for j in range(10)) for i in range(10_000)]
    assert large < 20 * max(small, 0.5)
