"""Filters of gray images as numpy arrays of height by width bytes: what the tasks of operators.images apply to each page.

Each follows the public definition of its filter to the last bit: 8-bit stages, the rounding of each, and how edges count.
The filters of the chain take one image or a stack of images of one size, in front of whose axes the stack's own stands: many small
pages then cost few calls of numpy. Sums are held in the narrowest numbers that fit them.
"""

from __future__ import annotations

import math

import numpy as np

#: Fixed values of the chain that readies a page for recognition.
CUTOFF, CONTRAST, SHARPNESS, CLIP_LIMIT, TILES, DARK = 1, 1.4, 1.1, 2.0, 8, 127
UNSHARP_RADIUS, UNSHARP_PERCENT, UNSHARP_THRESHOLD = 1.2, 120, 3
#: Weights of red, green and blue in 65,536ths.
LUMA = np.array([19595, 38470, 7471], np.uint32)
_RESIZE_BITS = 22
#: Numbers in the tables of one image in preprocess.
TABLES = TILES * TILES * 256


def gray(rgb: np.ndarray) -> np.ndarray:
    """Height x width x 3 bytes to gray."""
    return ((rgb.astype(np.uint32) @ LUMA + 0x8000) >> 16).astype(np.uint8)


def _stack(image: np.ndarray) -> np.ndarray:
    return image.reshape(-1, *image.shape[-2:])


def _numbered(stack: np.ndarray, values: int = 256) -> np.ndarray:
    """The pixels plus values times the number of their image."""
    return stack + (np.arange(len(stack)) * values)[:, None, None]


def _counts(stack: np.ndarray, numbered: np.ndarray) -> np.ndarray:
    return np.bincount(numbered.ravel(), minlength=len(stack) * 256).reshape(-1, 256)


def _bounds(counts: np.ndarray, size: int, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    cut, below = size * cutoff // 100, np.cumsum(counts, axis=1)
    # the values above v hold size - below[v] pixels
    return (below <= cut).sum(axis=1), (below < size - cut).sum(axis=1)


def _stretching(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What autocontrast makes of each value."""
    scale = (255.0 / np.maximum(high - low, 1))[:, None]
    table = np.clip((np.arange(256) * scale + -low[:, None] * scale).astype(np.int64), 0, 255).astype(np.uint8)
    return np.where((high <= low)[:, None], np.arange(256, dtype=np.uint8), table)


def _contrasting(totals: np.ndarray, size: int, factor: float) -> np.ndarray:
    """What contrast makes of each value, by the sums of pixels."""
    mean = (totals / size + 0.5).astype(np.uint8)[:, None]
    return blended(np.broadcast_to(mean, (len(mean), 256)), np.broadcast_to(np.arange(256, dtype=np.uint8), (len(mean), 256)), factor)


def contrast_bounds(image: np.ndarray, cutoff: int = CUTOFF) -> tuple[int, int]:
    """The darkest and the brightest value left once cutoff percent of the pixels are cut at either end."""
    low, high = _bounds(_counts(image[None], image), image.size, cutoff)
    return int(low[0]), int(high[0])


def autocontrast(image: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """Stretches the values between contrast_bounds to 0 to 255."""
    stack = _stack(image)
    numbered = _numbered(stack)
    return _stretching(*_bounds(_counts(stack, numbered), stack[0].size, cutoff)).ravel()[numbered].reshape(image.shape)


def blended(base: np.ndarray, image: np.ndarray, factor: float) -> np.ndarray:
    """base and what image differs from it, factor times; fractions are cut."""
    base = base.astype(np.float32)
    out = image.astype(np.float32)
    out -= base
    out *= np.float32(factor)
    out += base
    return np.minimum(np.maximum(out, 0, out=out), 255, out=out).astype(np.uint8)


def contrast(image: np.ndarray, factor: float = CONTRAST) -> np.ndarray:
    """Away from the mean value, rounded."""
    stack = _stack(image)
    return _contrasting(stack.sum(axis=(1, 2), dtype=np.int64), stack[0].size, factor).ravel()[_numbered(stack)].reshape(image.shape)


def stretched(image: np.ndarray) -> np.ndarray:
    """contrast of autocontrast, by one table of values."""
    stack = _stack(image)
    numbered, size = _numbered(stack), stack[0].size
    counts = _counts(stack, numbered)
    table = _stretching(*_bounds(counts, size, CUTOFF))
    further = _contrasting((counts * table).sum(axis=1), size, CONTRAST)
    return np.take_along_axis(further, table.astype(np.int64), axis=1).ravel()[numbered].reshape(image.shape)


def _wider(image: np.ndarray, by: int, kind) -> np.ndarray:
    """image, in its own order in memory, with its first and last pixel of each row repeated by times."""
    w = image.shape[-1]
    wide = np.empty_like(image, kind, shape=(*image.shape[:-1], w + 2 * by))
    wide[..., by : by + w] = image
    _repeat_ends(wide, by)
    return wide


def _repeat_ends(wide: np.ndarray, by: int) -> None:
    wide[..., :by] = wide[..., by : by + 1]
    wide[..., -by:] = wide[..., -by - 1 : -by]


def _three(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's pixels but the last two, but the first and the last one, but the first two."""
    return image[..., :-2], image[..., 1:-1], image[..., 2:]


def smooth(image: np.ndarray) -> np.ndarray:
    """Means of 3 x 3 pixels in which the middle weighs 5; pixels at the edges stay."""
    out = image.copy()
    if min(image.shape[-2:]) >= 3:
        wide = image.astype(np.uint16)
        a, b, c = _three(wide[..., :-2, :] + wide[..., 1:-1, :] + wide[..., 2:, :])
        total = wide[..., 1:-1, 1:-1] * np.uint16(4)
        for part in (a, b, c):
            total += part
        # a sum over 13, rounded: no sum is halfway between two multiples of 13
        total *= np.uint16(2)
        total += np.uint16(13)
        out[..., 1:-1, 1:-1] = total // np.uint16(26)
    return out


def sharpness(image: np.ndarray, factor: float = SHARPNESS) -> np.ndarray:
    return blended(smooth(image), image, factor)


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def median(image: np.ndarray) -> np.ndarray:
    """Medians of 3 x 3 pixels; the edge's own pixels stand beyond it.

    With each column of three in order, the median is that of the greatest least, the middle one's median and the least greatest.
    """
    wide = np.swapaxes(_wider(np.swapaxes(_wider(image, 1, np.uint8), -1, -2), 1, np.uint8), -1, -2)
    a, b, c = wide[..., :-2, :], wide[..., 1:-1, :], wide[..., 2:, :]
    low, high = np.minimum(a, b), np.maximum(a, b)
    least, most = _three(np.minimum(low, c)), _three(np.maximum(high, c))
    mid = _three(np.maximum(low, np.minimum(high, c)))
    return _middle(np.maximum(np.maximum(least[0], least[1]), least[2]), _middle(*mid), np.minimum(np.minimum(most[0], most[1]), most[2]))


def _dealt() -> np.ndarray:
    """For each remainder of counts below 256, which values get one of it."""
    left = np.arange(256)[:, None]
    step = np.maximum(256 // np.maximum(left, 1), 1)
    value = np.arange(256)
    return ((value % step == 0) & (value < step * left)).astype(np.int32)


_DEALT = _dealt()


def equalized(image: np.ndarray, clip_limit: float = CLIP_LIMIT, tiles: int = TILES) -> np.ndarray:
    """Adaptive histogram equalisation with limited contrast: a table for each of tiles x tiles, blended between their centres.

    An image that doesn't part evenly is mirrored beyond its right and lower edges, in both directions. Counts above the limit are dealt to all values evenly.
    """
    stack = _stack(image)
    (h, w), values = image.shape[-2:], tiles * tiles * 256
    even = h % tiles == 0 and w % tiles == 0
    hh, ww = (h, w) if even else (h + tiles - h % tiles, w + tiles - w % tiles)
    th, tw = hh // tiles, ww // tiles

    def mirrored(n: int, size: int) -> np.ndarray:
        turn = np.arange(n, size) % max(2 * n - 2, 1)
        return np.minimum(turn, 2 * n - 2 - turn)

    numbered = _numbered(stack, values)
    at = numbered
    if not even:
        at = np.empty((len(stack), hh, ww), np.int64)
        at[:, :h, :w] = numbered
        at[:, h:, :w] = numbered[:, mirrored(h, hh)]
        at[:, :, w:] = at[:, :, mirrored(w, ww)]
    at = at + ((np.arange(hh) // th * tiles)[:, None] + np.arange(ww) // tw) * 256
    counts = np.bincount(at.ravel(), minlength=len(stack) * values).astype(np.int32).reshape(-1, 256)
    del at
    np.minimum(counts, max(int(clip_limit * th * tw / 256), 1), out=counts)
    over = th * tw - counts.sum(axis=1)
    counts += _DEALT[over % 256]
    if over.max() >= 256:
        counts += (over // 256).astype(np.int32)[:, None]
    tables = np.cumsum(counts, axis=1, dtype=np.int32).astype(np.float32)
    tables *= np.float32(255.0) / np.float32(th * tw)
    tables = np.minimum(np.rint(tables, out=tables), 255, out=tables).ravel()

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n, dtype=np.float32) * (np.float32(1.0) / np.float32(size)) - np.float32(0.5)
        first = np.floor(at).astype(np.int64)
        return np.maximum(first, 0), np.minimum(first + 1, tiles - 1), at - first.astype(np.float32)

    (y1, y2, ya), (x1, x2, xa) = between(h, th), between(w, tw)
    one = np.float32(1.0)

    def row(y: np.ndarray) -> np.ndarray:
        y = (y * (tiles * 256))[:, None]
        a = tables[numbered + (y + x1 * 256)]
        a *= one - xa
        b = tables[numbered + (y + x2 * 256)]
        b *= xa
        a += b
        return a

    upper, lower = row(y1), row(y2)
    upper *= (one - ya)[:, None]
    lower *= ya[:, None]
    upper += lower
    return np.minimum(np.maximum(np.rint(upper, out=upper), 0, out=upper), 255, out=upper).astype(np.uint8).reshape(image.shape)


def _box_radius(sigma: float, passes: int) -> float:
    """The radius of the box whose passes come nearest to a Gaussian of this deviation; its fraction weighs the outermost pixels."""
    s = sigma * sigma / passes
    whole = math.floor((math.sqrt(12.0 * s + 1.0) - 1.0) / 2.0)
    return whole + (2 * whole + 1) * (whole * (whole + 1) - 3.0 * s) / (6.0 * (s - (whole + 1) ** 2))


def _box_rows(image: np.ndarray, radius: float, passes: int) -> np.ndarray:
    whole = int(radius)
    weight = int((1 << 24) / (radius * 2 + 1))
    edge = np.uint32(((1 << 24) - (whole * 2 + 1) * weight) // 2)
    w = image.shape[-1]
    wide = _wider(image, whole + 1, np.uint32)
    for n in range(passes):
        if n:
            _repeat_ends(wide, whole + 1)
        # weights add up to at most 1 << 24, so sums of weighted bytes fit
        inner = wide[..., 1 : 1 + w] * np.uint32(weight)
        for i in range(2, 2 * whole + 2):
            inner += wide[..., i : i + w] * np.uint32(weight)
        outer = wide[..., :w] + wide[..., 2 * whole + 2 :]
        outer *= edge
        inner += outer
        inner += np.uint32(1 << 23)
        np.right_shift(inner, np.uint32(24), out=wide[..., whole + 1 : whole + 1 + w])
    return wide[..., whole + 1 : whole + 1 + w].astype(np.uint8)


def blurred(image: np.ndarray, sigma: float, passes: int = 3) -> np.ndarray:
    """A Gaussian blur by passes of boxes, along rows first, then along columns."""
    radius = _box_radius(sigma, passes)
    for _ in range(2):
        image = np.swapaxes(_box_rows(image, radius, passes), -1, -2)
    return image


def unsharp(image: np.ndarray, sigma: float = UNSHARP_RADIUS, percent: int = UNSHARP_PERCENT, threshold: int = UNSHARP_THRESHOLD) -> np.ndarray:
    """Adds percent of what pixels differ from the blurred image, where they differ by more than the threshold."""
    # what is added for each difference from -255 to 255
    apart = np.arange(-255, 256)
    more = np.where(np.abs(apart) > threshold, np.sign(apart) * (np.abs(apart) * percent // 100), 0)
    own = image.astype(np.int64)
    out = more[own + 255 - blurred(image, sigma)]
    out += own
    return np.minimum(np.maximum(out, 0, out=out), 255, out=out).astype(np.uint8)


def preprocess(image: np.ndarray) -> np.ndarray:
    """The whole chain on a gray or RGB image: contrast, sharpness, median, equalisation, inversion of dark pages, unsharp mask."""
    return preprocess_stack((gray(image) if image.ndim == 3 else image)[None])[0]


def preprocess_stack(stack: np.ndarray) -> np.ndarray:
    """preprocess of each of a stack of gray images of one size."""
    out = equalized(median(sharpness(stretched(stack))))
    dark = out.sum(axis=(1, 2), dtype=np.int64) < DARK * out[0].size
    out[dark] = 255 - out[dark]
    return unsharp(out)


def _resize_rows(image: np.ndarray, width: int) -> np.ndarray:
    """Each output pixel is the mean of the input under a triangle as wide as the reduction; weights in 2^-22ths."""
    n = image.shape[1]
    scale = n / width
    reach = max(scale, 1.0)
    out = np.empty((image.shape[0], width), np.uint8)
    for x in range(width):
        centre = (x + 0.5) * scale
        first, last = max(0, int(centre - reach + 0.5)), min(n, int(centre + reach + 0.5))
        weights = np.maximum(0.0, 1.0 - np.abs((np.arange(first, last) - centre + 0.5) / reach))
        weights = np.floor(weights / weights.sum() * (1 << _RESIZE_BITS) + 0.5).astype(np.int64)
        out[:, x] = np.clip((image[:, first:last].astype(np.int64) @ weights + (1 << _RESIZE_BITS - 1)) >> _RESIZE_BITS, 0, 255)
    return out


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """A gray image resampled along rows, then along columns."""
    if image.shape[1] != width:
        image = _resize_rows(image, width)
    return _resize_rows(image.T, height).T if image.shape[0] != height else image
