"""Parts of page images: crops for OCR by reading order, and illustration regions.

Where parts lie is worked out in columns, clamped to the image; each task then cuts the bytes of the images it has.  A part
that can't be cut has an error instead of data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.images import array, luma

PART = "left int, top int, right int, bottom int"


def _cut(parts: DataFrame, keep: list[str]) -> DataFrame:
    """height, width, channels, data and error of each part; ``gray`` tells whether its colours go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                try:
                    if r.right <= r.left or r.bottom <= r.top:
                        raise ValueError(f"empty region after clamping: L={r.left} R={r.right} T={r.top} B={r.bottom}")
                    piece = array(r.height, r.width, r.channels, r.data)[r.top : r.bottom, r.left : r.right]
                    if r.gray and piece.ndim == 3:
                        piece = np.rint(luma(piece)).astype(np.uint8)
                    out.append((r.bottom - r.top, r.right - r.left, 1 if piece.ndim == 2 else piece.shape[2], piece.tobytes(), None))
                except (ValueError, TypeError) as e:
                    out.append((None, None, None, None, str(e)[:200]))
            made = pd.DataFrame(out, columns=["height", "width", "channels", "data", "error"]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})
            yield pd.concat([f[keep].reset_index(drop=True), made], axis=1)

    kinds = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in keep)
    return parts.select(*keep, *(c for c in ("left", "top", "right", "bottom", "gray", "height", "width", "channels", "data"))).mapInPandas(run, f"{kinds}, height int, width int, channels int, data binary, error string")



def ocr_crops(pages: DataFrame, key: str) -> DataFrame:
    """key, suffix, reading_order and the image of each part that OCR reads.

    ``pages``: key, image columns, insets (top, bottom, left, right of the project, taken off first; null: none) and splits
    (array of suffix, reading_order and L, R, T, B within what is left; null sides are the image's).  Without splits
    the page is one part; a split that is empty is left out, a page with nothing left has an error.
    """
    h, w = F.col("height"), F.col("width")
    inset = {side: F.greatest(F.coalesce(F.col(f"insets.{side}"), F.lit(0)), F.lit(0)) for side in ("top", "bottom", "left", "right")}
    # What is left of the page.
    x, y = F.least(inset["left"], w), F.least(inset["top"], h)
    wide, high = F.greatest(w - inset["right"] - x, F.lit(0)), F.greatest(h - inset["bottom"] - y, F.lit(0))
    whole = F.array(F.struct(F.lit("").alias("suffix"), F.lit(0).alias("reading_order"), x.alias("left"), y.alias("top"), (x + wide).alias("right"), (y + high).alias("bottom"), F.lit(True).alias("whole")))

    def placed(s: Column) -> Column:
        left, top = F.greatest(F.coalesce(s["L"], F.lit(0)), F.lit(0)), F.greatest(F.coalesce(s["T"], F.lit(0)), F.lit(0))
        right, bottom = F.least(F.coalesce(s["R"], wide), wide), F.least(F.coalesce(s["B"], high), high)
        return F.struct(s["suffix"].alias("suffix"), s["reading_order"].alias("reading_order"), (x + left).alias("left"), (y + top).alias("top"), (x + right).alias("right"), (y + bottom).alias("bottom"), F.lit(False).alias("whole"))

    kind = f"array<struct<suffix:string,reading_order:int,{PART.replace(' int', ':int').replace(' ', '')},whole:boolean>>"
    parts = F.when(F.size("splits") > 0, F.transform("splits", placed).cast(kind)).otherwise(whole.cast(kind))
    rows = pages.select(key, "height", "width", "channels", "data", F.inline(parts), F.lit(False).alias("gray"))
    kept = rows.where(F.col("whole") | ((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top"))) | F.col("height").isNull())
    return _cut(kept, [key, "suffix", "reading_order"])


REGION = "array<struct<index:int,L:int,T:int,R:int,B:int,gray:boolean,output_format:string>>"


def regions_of(regions: Column, page_type: Column) -> Column:
    """A page's own regions; for a plate without any, one region of the whole page."""
    plate = F.array(F.struct(F.lit(1).alias("index"), F.lit(0).alias("L"), F.lit(0).alias("T"), F.lit(0).alias("R"), F.lit(0).alias("B"), F.lit(False).alias("gray"), F.lit("jpg").alias("output_format"))).cast(REGION)
    return F.when(F.size(regions) > 0, regions).when(page_type == "plate_p", plate).otherwise(F.array().cast(REGION))


def region_crops(pages: DataFrame, key: str) -> DataFrame:
    """key, index, output_format and the image of each illustration region.

    ``pages``: key, page_type, image columns and regions (array of index, L, T, R, B, gray, output_format).  Sides are clamped to
    the image; a right or lower side of 0 or null is the image's.
    """
    each = pages.select(key, "height", "width", "channels", "data", F.inline(regions_of(F.col("regions").cast(REGION), F.col("page_type"))))
    h, w = F.col("height"), F.col("width")
    side = lambda c, whole: F.least(F.when(F.coalesce(F.col(c), F.lit(0)) == 0, whole).otherwise(F.col(c)), whole).cast("int")
    start = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("int")
    rows = each.withColumns({"left": start("L"), "top": start("T"), "right": side("R", w), "bottom": side("B", h), "gray": F.coalesce("gray", F.lit(False))})
    return _cut(rows, [key, "index", "output_format"])
