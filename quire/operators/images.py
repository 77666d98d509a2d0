"""Page images as arrays: statistics, thresholds, crops, flips, specks.

Rows have ``height``, ``width``, ``channels`` and ``data`` (rows of unsigned bytes, blue green red), as Spark's
image source gives them.  A bad image gets an error, not a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the page heuristics.
BLANK_LUMA, COLOR_SHARE, COLOR_LEVEL, NARROW, DARK = 245.0, 0.05, 30, 0.5, 200


#: Pixels of an image at most; larger ones get an error before anything is computed of them.
MOST_PIXELS = 200_000_000


def array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    if height * width > MOST_PIXELS:
        raise ValueError(f"image too large: {width}x{height} = {width * height} pixels (limit {MOST_PIXELS})")
    out = np.frombuffer(data, np.uint8)
    return out.reshape((height, width) if channels == 1 else (height, width, channels))


def luma(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def signals(image: np.ndarray) -> dict[str, float]:
    gray = luma(image)
    spread = 0.0
    imbalance = 0.0
    colored = 0.0
    if image.ndim == 3:
        channels = image[:, :, :3].astype(float)
        means = channels.reshape(-1, 3).mean(0)
        imbalance = float(np.abs(means - means.mean()).max())
        span = channels.max(2) - channels.min(2)
        colored, spread = float((span > COLOR_LEVEL).mean()), float(span.std())
    h, w = (max(n // 8, 1) for n in gray.shape)
    step = (gray.shape[0] // h, gray.shape[1] // w)
    small = gray[: h * step[0], : w * step[1]].reshape(h, step[0], w, step[1]).mean((1, 3))
    columns = np.flatnonzero((gray < DARK).any(0))
    content = float(columns[-1] - columns[0] + 1) / gray.shape[1] if len(columns) else 0.0
    return {"mean_luma": float(gray.mean()), "colored": colored, "chroma": spread, "imbalance": imbalance, "illumination": float(small.std()), "contrast": float((gray - gray.mean()).std()), "content_width": content}


SIGNALS = ("mean_luma", "colored", "chroma", "imbalance", "illumination", "contrast", "content_width")


def measure(images: DataFrame, key: str) -> DataFrame:
    """Signals of each image, or its error."""
    kind = images.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                try:
                    out.append({"key": r.key, **signals(array(r.height, r.width, r.channels, r.data)), "error": None})
                except (ValueError, TypeError) as e:
                    out.append({"key": r.key, "error": str(e)[:200]})
            yield pd.DataFrame(out, columns=["key", *SIGNALS, "error"])

    rows = images.select(F.col(key).alias("key"), "height", "width", "channels", "data")
    return rows.mapInPandas(run, f"key {kind}, " + ", ".join(f"{s} double" for s in SIGNALS) + ", error string").withColumnRenamed("key", key)


def suggestion() -> list[Column]:
    """Suggested page type, alignment and confidence from the signals."""
    blank, color = F.col("mean_luma") >= BLANK_LUMA, F.col("colored") > COLOR_SHARE
    confidence = F.when(blank, F.least(F.lit(1.0), (F.col("mean_luma") - BLANK_LUMA) / 10 + 0.6)).when(color, F.least(F.lit(1.0), F.col("colored") / 0.2 + 0.4)).otherwise(0.0)
    narrow = ~blank & ~color & F.col("content_width").between(1e-9, NARROW - 1e-9)
    return [F.when(blank, "blank").when(color, "plate_p").otherwise("normal").alias("page_type"), F.when(narrow, "center").otherwise("default").alias("alignment"), confidence.alias("confidence")]


def otsu(gray: np.ndarray) -> int:
    """Level that parts the histogram with the largest variance between the two sides."""
    n = np.bincount(gray.astype(np.uint8).ravel(), minlength=256).astype(float)
    weight, total = n.cumsum(), (n * np.arange(256)).cumsum()
    rest = weight[-1] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * rest * (total / weight - (total[-1] - total) / rest) ** 2
    return int(np.nan_to_num(between).argmax())


def threshold(image: np.ndarray, level: int | None = None, invert: bool = False) -> np.ndarray:
    """White above the level (by Otsu if none is given), black below."""
    gray = luma(image)
    out = np.where(gray > (otsu(gray) if level is None else level), 255, 0).astype(np.uint8)
    return 255 - out if invert else out


def crop(image: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    h, w = image.shape[:2]
    return image[max(top, 0) : min(max(bottom, top), h), max(left, 0) : min(max(right, left), w)]


def content_box(image: np.ndarray, dark: int = DARK) -> tuple[int, int, int, int]:
    """Left, top, right, bottom of what is darker than ``dark``; the whole image if nothing is."""
    mask = luma(image) < dark
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return 0, 0, image.shape[1], image.shape[0]
    return int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1


def flip(image: np.ndarray, horizontal: bool = False, vertical: bool = False, turns: int = 0) -> np.ndarray:
    image = image[:, ::-1] if horizontal else image
    return np.rot90(image[::-1] if vertical else image, -turns)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and column behind the last of each stretch of a mask, in order."""
    h, w = mask.shape
    edges = np.zeros((h, w + 2), np.int8)
    edges[:, 1:-1] = mask
    step = np.diff(edges, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1]


def _touching(row: np.ndarray, first: np.ndarray, behind: np.ndarray, width: int, corners: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of stretches of neighbouring rows that touch, with ``corners`` at corners too."""
    reach, wide = int(corners), width + 2
    # The stretches of the row below that end behind this one's start and start before its end.
    low = np.searchsorted(row * wide + behind, (row + 1) * wide + first - reach, side="right")
    high = np.searchsorted(row * wide + first, (row + 1) * wide + behind + reach, side="left")
    count = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(row)), count)
    return above, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's set after all pairs were united: roots are hooked onto smaller ones, paths halved."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def areas(mask: np.ndarray, corners: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of a mask (row, first, behind), the number of each one's connected area, and the areas' pixels.

    Work is in proportion to the stretches, whatever the areas' shapes; areas are numbered in order of their first pixel.
    """
    row, first, behind = _runs(mask)
    root = _united(len(row), *_touching(row, first, behind, mask.shape[1], corners))
    _, number = np.unique(root, return_inverse=True)
    return row, first, behind, number, np.bincount(number, weights=behind - first).astype(np.int64)


def components(mask: np.ndarray, corners: bool = False) -> np.ndarray:
    """Numbers of connected (four neighbours, with ``corners`` eight) areas from 1 on, 0 outside."""
    row, first, behind, number, _ = areas(mask, corners)
    change = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int64)
    np.add.at(change, (row, first), number + 1)
    np.add.at(change, (row, behind), -number - 1)
    return change.cumsum(axis=1)[:, :-1]


def median(binary: np.ndarray, size: int) -> np.ndarray:
    """Each pixel of a black and white image as most of the ``size`` times ``size`` around it; edges go on outside."""
    if size < 3:
        return binary
    h, w = binary.shape
    sums = np.pad(np.pad(binary > 127, size // 2, mode="edge").astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    white = sums[size : size + h, size : size + w] - sums[:h, size : size + w] - sums[size : size + h, :w] + sums[:h, :w]
    return np.where(2 * white > size * size, 255, 0).astype(np.uint8)


def denoise(binary: np.ndarray, least_area: int = 6, median_size: int = 0, white_text: bool = False) -> np.ndarray:
    """Black areas smaller than ``least_area`` turn white, after a median filter if it has a size; with ``white_text`` white ones turn black."""
    page = median(255 - binary if white_text else binary, median_size)
    row, first, behind, number, size = areas(page == 0)
    change = np.zeros((page.shape[0], page.shape[1] + 1), np.int8)
    small = size[number] < least_area
    np.add.at(change, (row[small], first[small]), 1)
    np.add.at(change, (row[small], behind[small]), -1)
    out = np.where(change.cumsum(axis=1, dtype=np.int8)[:, :-1] > 0, 255, page).astype(np.uint8)
    return 255 - out if white_text else out


def zones(binary: np.ndarray, least_area: int = 1, corners: bool = False) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the black areas of ``least_area`` pixels, in order of y and x."""
    row, first, behind, number, size = areas(binary == 0, corners)
    low, high = np.full((2, len(size)), max(binary.shape), np.int64), np.zeros((2, len(size)), np.int64)
    for k, values in enumerate((first, row)):
        np.minimum.at(low[k], number, values)
    for k, values in enumerate((behind, row + 1)):
        np.maximum.at(high[k], number, values)
    kept = size >= least_area
    boxes = zip(*(v[kept].tolist() for v in (*low, *(high - low))), strict=True)
    return sorted(boxes, key=lambda b: (b[1], b[0]))


def resample(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image in another size; each new pixel is the mean of the area that it covers."""

    def shares(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        cell = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, None) * m / n

    down, across = shares(image.shape[0], height), shares(image.shape[1], width)
    out = np.tensordot(down, image.astype(float), axes=(1, 0))
    out = np.moveaxis(np.tensordot(out, across, axes=(1, 1)), -1, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def turned(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """An image turned around its middle, counter-clockwise; each pixel is taken between the four around where it was."""
    h, w = image.shape[:2]
    angle = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    from_x, from_y = np.cos(angle) * x - np.sin(angle) * y + (w - 1) / 2, np.sin(angle) * x + np.cos(angle) * y + (h - 1) / 2
    framed = np.pad(image.astype(float), ((1, 1), (1, 1), *[(0, 0)] * (image.ndim - 2)), constant_values=fill)
    at_y, at_x = np.clip(from_y + 1, 0, h + 1), np.clip(from_x + 1, 0, w + 1)
    top, left = np.minimum(at_y.astype(int), h), np.minimum(at_x.astype(int), w)
    down, right = at_y - top, at_x - left
    if image.ndim == 3:
        down, right = down[..., None], right[..., None]
    upper = framed[top, left] * (1 - right) + framed[top, left + 1] * right
    lower = framed[top + 1, left] * (1 - right) + framed[top + 1, left + 1] * right
    return np.clip(np.rint(upper * (1 - down) + lower * down), 0, 255).astype(np.uint8)


def skew(binary: np.ndarray, most: float = 5.0, steps: tuple[float, ...] = (0.5, 0.1, 0.02)) -> float:
    """Degrees, counter-clockwise, by which the black lines of a page rise: where the profile of its rows is sharpest.

    The sharpest of the angles a step apart is searched around with the next smaller step.  An empty page has 0.
    """
    y, x = np.nonzero(binary == 0)
    if not len(y):
        return 0.0
    best, x = 0.0, x - binary.shape[1] / 2
    for k, step in enumerate(steps):
        reach = most if not k else steps[k - 1]
        tries = best + np.arange(-round(reach / step), round(reach / step) + 1) * step
        rows = [np.rint(y + x * np.tan(np.deg2rad(a))).astype(np.int64) for a in tries]
        sharp = [(np.bincount(r - r.min()).astype(float) ** 2).sum() for r in rows]
        # Of equal ones the smallest turn.
        best = float(min(tries[np.flatnonzero(np.array(sharp) == max(sharp))], key=abs))
    return best


def deskew(image: np.ndarray, most: float = 5.0, fill: int = 255) -> np.ndarray:
    return turned(image, -skew(threshold(image), most), fill)


def on_canvas(image: np.ndarray, height: int, width: int, align: str = "default", fill: int = 255) -> np.ndarray:
    """An image scaled to fit a canvas and laid on it, in the middle across; ``align`` is top, bottom, center or default, a third of the room above."""
    scale = min(height / image.shape[0], width / image.shape[1])
    h, w = max(1, min(height, round(image.shape[0] * scale))), max(1, min(width, round(image.shape[1] * scale)))
    out = np.full((height, width, *image.shape[2:]), fill, np.uint8)
    top = {"top": 0, "bottom": height - h, "center": (height - h) // 2}.get(align, (height - h) // 3)
    left = (width - w) // 2
    out[top : top + h, left : left + w] = resample(image, h, w)
    return out


def chain(images: DataFrame, key: str, steps: list[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Images after all steps, in one pass over each, or their errors."""
    kind = images.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                try:
                    image = array(r.height, r.width, r.channels, r.data)
                    for step in steps:
                        image = step(image)
                    out.append((r.key, image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], image.tobytes(), None))
                except (ValueError, TypeError, IndexError) as e:
                    out.append((r.key, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["key", "height", "width", "channels", "data", "error"]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    rows = images.select(F.col(key).alias("key"), "height", "width", "channels", "data")
    return rows.mapInPandas(run, f"key {kind}, height int, width int, channels int, data binary, error string").withColumnRenamed("key", key)


def from_source(found: DataFrame) -> DataFrame:
    """Rows of Spark's image source in this module's shape."""
    return found.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
