"""The image filters against plain loops over pixels, and the operators on rows of images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import pixels
from folioscope.operators import images


def at(image, y, x):
    """The pixel, or the nearest one of the edge."""
    return int(image[min(max(y, 0), len(image) - 1)][min(max(x, 0), len(image[0]) - 1)])


def cut(v):
    return max(0, min(255, int(v)))


def plain_autocontrast(image):
    values = sorted(int(v) for row in image for v in row)
    n = len(values) // 100
    low, high = values[n], values[-1 - n]
    if high <= low:
        return image
    return [[cut(v * (255.0 / (high - low)) - low * (255.0 / (high - low))) for v in map(int, row)] for row in image]


def plain_blend(base, image, factor):
    f = np.float32
    return [[cut(f(b) + f(factor) * f(int(v) - int(b))) for b, v in zip(r, s)] for r, s in zip(base, image)]


def plain_contrast(image):
    mean = int(sum(int(v) for row in image for v in row) / (len(image) * len(image[0])) + 0.5)
    return plain_blend([[mean] * len(image[0]) for _ in image], image, 1.4)


def plain_sharpness(image):
    h, w = len(image), len(image[0])
    smooth = [[int(image[y][x]) for x in range(w)] for y in range(h)]
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            total = sum(at(image, y + i, x + j) * (5 if i == j == 0 else 1) for i in (-1, 0, 1) for j in (-1, 0, 1))
            smooth[y][x] = cut(total / 13 + 0.5)
    return plain_blend(smooth, image, 1.1)


def plain_median(image):
    return [[sorted(at(image, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1))[4] for x in range(len(image[0]))] for y in range(len(image))]


def mirrored(i, n):
    while not 0 <= i < n:
        i = 0 if n == 1 else -i if i < 0 else 2 * n - 2 - i
    return i


def plain_equalized(image, tiles=8):
    h, w = len(image), len(image[0])
    even = h % tiles == 0 and w % tiles == 0
    hh, ww = (h, w) if even else (h + tiles - h % tiles, w + tiles - w % tiles)
    th, tw = hh // tiles, ww // tiles
    tables = {}
    for ty in range(tiles):
        for tx in range(tiles):
            counts = [0] * 256
            for y in range(ty * th, ty * th + th):
                for x in range(tx * tw, tx * tw + tw):
                    counts[int(image[mirrored(y, h)][mirrored(x, w)])] += 1
            limit = max(int(2.0 * th * tw / 256), 1)
            over = sum(max(0, c - limit) for c in counts)
            counts = [min(c, limit) + over // 256 for c in counts]
            left, i = over % 256, 0
            step = max(256 // left, 1) if left else 1
            while left and i < 256:
                counts[i] += 1
                i, left = i + step, left - 1
            total, table = 0, []
            for c in counts:
                total += c
                table.append(max(0, min(255, round(float(np.float32(total) * (np.float32(255) / np.float32(th * tw)))))))
            tables[ty, tx] = table
    f, out = np.float32, []
    for y in range(h):
        fy = f(y) * (f(1) / f(th)) - f(0.5)
        row = []
        for x in range(w):
            fx = f(x) * (f(1) / f(tw)) - f(0.5)
            y1, x1 = math.floor(fy), math.floor(fx)
            ya, xa = fy - f(y1), fx - f(x1)
            pick = lambda ty, tx: f(tables[min(max(ty, 0), tiles - 1), min(max(tx, 0), tiles - 1)][int(image[y][x])])  # noqa: B023, E731
            upper = pick(y1, x1) * (f(1) - xa) + pick(y1, x1 + 1) * xa
            lower = pick(y1 + 1, x1) * (f(1) - xa) + pick(y1 + 1, x1 + 1) * xa
            row.append(max(0, min(255, round(float(upper * (f(1) - ya) + lower * ya)))))
        out.append(row)
    return out


def plain_blur(image, sigma):
    s = sigma * sigma / 3
    n = math.floor((math.sqrt(12 * s + 1) - 1) / 2)
    radius = n + (2 * n + 1) * (n * (n + 1) - 3 * s) / (6 * (s - (n + 1) ** 2))
    weight = int(2**24 / (2 * radius + 1))
    edge = (2**24 - (2 * n + 1) * weight) // 2
    for _ in range(2):
        for _ in range(3):
            image = [[(sum(at(image, y, x + i) for i in range(-n, n + 1)) * weight + (at(image, y, x - n - 1) + at(image, y, x + n + 1)) * edge + 2**23) >> 24 for x in range(len(image[0]))] for y in range(len(image))]
        image = [list(column) for column in zip(*image)]
    return image


def plain_unsharp(image):
    out = []
    for row, soft in zip(image, plain_blur(image, 1.2)):
        out.append([cut(int(v) + math.trunc((int(v) - b) * 120 / 100)) if abs(int(v) - b) > 3 else int(v) for v, b in zip(row, soft)])
    return out


PLAIN = {"autocontrast": plain_autocontrast, "contrast": plain_contrast, "sharpness": plain_sharpness, "median": plain_median, "equalized": plain_equalized, "unsharp": plain_unsharp}


def pictures():
    g = np.random.default_rng(4)
    slope = np.add.outer(np.arange(24), np.arange(40)) * 3
    return {
        "noise": g.integers(0, 256, (17, 23)),
        "even tiles": g.integers(60, 120, (16, 24)),
        "one side even": g.integers(0, 40, (16, 21)),
        "slope": slope,
        "page": np.where(g.random((30, 41)) < 0.15, g.integers(0, 60, (30, 41)), 230),
        "plain": np.full((9, 9), 77),
        "a pixel": np.full((1, 1), 3),
        "a row": g.integers(0, 256, (1, 12)),
        "a column": g.integers(0, 256, (13, 2)),
    }


@pytest.mark.parametrize("name", pictures())
def test_filters_against_plain_loops(name):
    image = pictures()[name].astype(np.uint8)
    for of, plain in PLAIN.items():
        got = getattr(pixels, of)(image)
        assert got.dtype == np.uint8 and got.tolist() == [[int(v) for v in row] for row in plain(image)], of
    chained = image
    for of in ("autocontrast", "contrast", "sharpness", "median", "equalized"):
        chained = PLAIN[of](chained)
    if np.mean(chained) < 127:
        chained = [[255 - int(v) for v in row] for row in chained]
    assert pixels.preprocess(image).tolist() == [[int(v) for v in row] for row in plain_unsharp(chained)]


def test_filters_by_hand():
    assert pixels.gray(np.array([[[255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[255, 76, 150, 29]]
    # 200 pixels: two are cut at either end
    image = np.array([10, 20] + [50] * 98 + [100] * 98 + [200, 250], np.uint8).reshape(10, 20)
    assert pixels.contrast_bounds(image) == (50, 100)
    assert sorted(set(pixels.autocontrast(image).ravel().tolist())) == [0, 254, 255]  # 100 * 5.1 - 255 is a little below 255
    assert pixels.median(np.array([[9, 9, 9], [9, 0, 9], [9, 9, 9]], np.uint8)).tolist() == [[9] * 3] * 3
    flat = np.full((20, 20), 100, np.uint8)
    assert (pixels.unsharp(flat) == flat).all() and (pixels.blurred(flat, 1.2) == flat).all()


def plain_resized(image, width, height):
    def rows(image, width):
        out = []
        for row in image:
            line = []
            for x in range(width):
                scale = len(row) / width
                reach, centre = max(scale, 1.0), (x + 0.5) * scale
                near = [(i, max(0.0, 1 - abs((i + 0.5 - centre) / reach))) for i in range(len(row)) if max(0, int(centre - reach + 0.5)) <= i < min(len(row), int(centre + reach + 0.5))]
                total = sum(k for _, k in near)
                line.append(max(0, min(255, (sum(int(row[i]) * math.floor(k / total * 2**22 + 0.5) for i, k in near) + 2**21) >> 22)))
            out.append(line)
        return out

    if width != len(image[0]):
        image = rows(image, width)
    return [list(c) for c in zip(*rows([list(c) for c in zip(*image)], height))] if height != len(image) else image


@pytest.mark.parametrize("size", [(10, 7), (23, 9), (5, 17), (1, 1), (30, 25)])
def test_resampling_against_plain_loops(size):
    image = pictures()["noise"].astype(np.uint8)
    assert pixels.resized(image, *size).tolist() == [[int(v) for v in row] for row in plain_resized(image.tolist(), *size)]


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(5)
    gray, rgb = g.integers(0, 256, (50, 30)).astype(np.uint8), g.integers(0, 256, (20, 10, 3)).astype(np.uint8)
    data = [(1, 30, 50, gray.tobytes()), (2, 10, 20, rgb.tobytes()), (3, 4, 4, b"abc"), (4, None, None, None), (5, 0, 0, b"")]
    return gray, rgb, spark.createDataFrame([(*d, "kept") for d in data], "doc long, width int, height int, pixels binary, filtered string").repartition(2)


def test_preprocessed_rows(rows, monkeypatch):
    gray, rgb, table = rows
    monkeypatch.setattr(images, "TOGETHER", 1)
    got = {r.doc: r for r in images.preprocessed(table).collect()}
    assert bytes(got[1].pixels) == pixels.preprocess(gray).tobytes() and got[1].filtered
    assert bytes(got[2].pixels) == pixels.preprocess(pixels.gray(rgb)).tobytes() and (got[2].width, got[2].height) == (10, 20)
    assert [(got[d].filtered, got[d].pixels) for d in (3, 4, 5)] == [(False, b"abc"), (False, None), (False, b"")]
    assert images.preprocessed(table.where("false")).count() == 0


def test_small_pages_of_one_size_are_filtered_together(spark, monkeypatch):
    """A thousand small pages once took as many rounds of calls of numpy; pages of other sizes and failing ones are dealt with beside them."""
    g = np.random.default_rng(6)
    made = [g.integers(a, b, (h, 16)).astype(np.uint8) for h, (a, b) in zip([9, 12, 9, 40] * 50, [(0, 256), (200, 256), (0, 30), (7, 8), (90, 120)] * 40)]
    stacks, run = [], pixels.preprocess_stack
    monkeypatch.setattr(pixels, "preprocess_stack", lambda stack: stacks.append(stack.shape) or run(stack))
    got = images._preprocessed([*made, None, np.empty((0, 5), np.uint8), np.dstack([made[0]] * 3)], [])
    assert [x.tolist() for x in got[:200]] == [run(x[None])[0].tolist() for x in made] and got[200:202] == [None, None]
    assert got[202].tolist() == run(pixels.gray(np.dstack([made[0]] * 3))[None])[0].tolist()
    assert len(stacks) < 12 and sum(n for n, *_ in stacks) == 201 and {(h, w) for _, h, w in stacks} == {(9, 16), (12, 16), (40, 16)}

    def short(stack):
        if len(stack) > 1:
            raise MemoryError
        return run(stack)

    monkeypatch.setattr(pixels, "preprocess_stack", short)
    assert [x.tolist() for x in images._preprocessed(made, [])] == [x.tolist() for x in got[:200]]


def test_turned_and_scaled_rows(rows):
    gray, rgb, table = rows
    got = {r.doc: r for r in images.turned(table.where("doc < 3").withColumn("rotation", F.when(F.col("doc") == 1, 180).otherwise(0))).collect()}
    assert bytes(got[1].pixels) == gray[::-1, ::-1].tobytes() and bytes(got[2].pixels) == rgb.tobytes()
    made = images.candidates(table.where("doc < 3"), 25, (25, 12)).collect()
    sizes = {(r.doc, r.candidate): (r.width, r.height, len(r.pixels)) for r in made}
    assert sizes == {(1, 0): (15, 25, 375), (1, 1): (7, 12, 84), (2, 0): (10, 20, 600), (2, 1): (6, 12, 216)}
    assert next(bytes(r.pixels) for r in made if (r.doc, r.candidate) == (1, 1)) == pixels.resized(gray, 7, 12).tobytes()


def test_bands_of_rows(rows):
    gray, rgb, table = rows
    got = images.cut_bands(table.where("doc < 3"), 30).orderBy("doc", "band").collect()
    tops = {(1, 0): (0, 49), (1, 1): (1, 50), (2, 0): (0, 20)}
    assert {(r.doc, r.band): r.height for r in got} == {k: b - a for k, (a, b) in tops.items()}
    for r in got:
        a, b = tops[r.doc, r.band]
        assert bytes(r.pixels) == {1: gray, 2: rgb}[r.doc][a:b].tobytes()
