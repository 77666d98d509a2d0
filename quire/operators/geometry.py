"""Boxes, zones, crops and sizes of page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 10
#: Boxes that a task orders at a time, on average; a page is never divided.
ROWS = 500_000


def by_page(boxes: DataFrame, by: str) -> DataFrame:
    """``boxes`` dealt out by page to as many tasks as their number asks for, where that is more than Spark would take."""
    parts = boxes.count() // ROWS + 1
    return boxes.repartition(parts, by) if parts > int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")) else boxes


def merge_zones(boxes: DataFrame, by: str = "page_no", gap: int = GAP) -> DataFrame:
    """Boxes of a page that overlap vertically, or nearly, become one; zones are numbered down the page.

    A zone begins where a box starts below all boxes before it by more than ``gap``.
    """
    order = Window.partitionBy(by).orderBy("y", "x", "w", "h").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.when(F.col("y") > F.max(F.col("y") + F.col("h")).over(order) + gap, 1).otherwise(0)
    zone = F.sum("_new").over(Window.partitionBy(by).orderBy("y", "x", "w", "h").rowsBetween(Window.unboundedPreceding, 0))
    grouped = by_page(boxes, by).withColumn("_new", starts).withColumn("zone", zone).groupBy(by, "zone")
    merged = grouped.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.count("*").alias("boxes"))
    return merged.select(by, F.col("zone").cast("int").alias("zone"), "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), "boxes")


def zone_id(x: Column, y: Column, w: Column, h: Column, i: Column) -> Column:
    return F.concat(F.lit("z"), F.substring(F.sha1(F.concat_ws(",", *(c.cast("string") for c in (x, y, w, h, i))).cast("binary")), 1, 12))


def normalise(zones: DataFrame, width: Column, height: Column) -> DataFrame:
    """Coordinates as shares of the page."""
    part = lambda c, of: (F.col(c) / of).alias(f"{c}_share")
    return zones.select("*", part("x", width), part("y", height), part("w", width), part("h", height))


def clamp_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> list[Column]:
    """A box cut to the page; missing edges are the page's."""
    inside = lambda v, of: F.greatest(F.lit(0), F.least(v, of))
    return [inside(F.coalesce(left, F.lit(0)), width).alias("l"), inside(F.coalesce(top, F.lit(0)), height).alias("t"), inside(F.coalesce(right, width), width).alias("r"), inside(F.coalesce(bottom, height), height).alias("b")]


def pad_box(left: Column, top: Column, right: Column, bottom: Column, share: float, width: Column, height: Column) -> list[Column]:
    """A box widened by a share of its size, rounded towards zero, inside the page."""
    dx, dy = ((right - left) * share).cast("int"), ((bottom - top) * share).cast("int")
    return [F.greatest(F.lit(0), left - dx).alias("l"), F.greatest(F.lit(0), top - dy).alias("t"), F.least(width, right + dx).alias("r"), F.least(height, bottom + dy).alias("b")]


def thumbnail_size(width: Column, height: Column, short_side: int) -> list[Column]:
    """Size with the shorter side at most ``short_side``."""
    scale = F.least(F.lit(1.0), short_side / F.least(width, height))
    size = lambda v: F.greatest(F.lit(1), F.floor(v * scale)).cast("int")
    return [size(width).alias("thumb_width"), size(height).alias("thumb_height")]


def blank_size(width: Column, ratio: Column) -> Column:
    """Height of a blank page of that width."""
    return F.greatest(F.lit(1), F.round(width * ratio)).cast("int")


#: Fixed values of the converter's decision.
IMBALANCE, CHROMA, ILLUMINATION, CONTRAST = 20.0, 15.0, 30.0, 40.0


def converter(imbalance: Column, chroma: Column, gpu: bool = False) -> Column:
    """Grayscale converter from the sample's mean signals."""
    return F.when(imbalance > IMBALANCE, "best_channel").when(chroma > CHROMA, "color2gray" if gpu else "best_channel").otherwise("luma")


def keep_regions(regions: DataFrame, kinds: list[str], least: float) -> DataFrame:
    """Regions of the kept kinds with enough confidence, numbered from 1 on each page."""
    order = Window.partitionBy("page_no").orderBy("box_no", "x", "y", "w", "h")
    return regions.where(F.col("kind").isin(*kinds) & (F.col("confidence") >= least)).withColumn("region", F.row_number().over(order))


def ocr_word(left: Column, top: Column, right: Column, bottom: Column, confidence: Column, percent: bool = False) -> list[Column]:
    """An engine's word as whole numbers; no width or height is negative, a missing confidence is 0."""
    c = F.when(confidence.isNull() | (confidence < 0), 0.0).otherwise(confidence / (100.0 if percent else 1.0))
    whole = lambda v: v.cast("int")
    return [whole(left).alias("left"), whole(top).alias("top"), F.greatest(F.lit(0), whole(right) - whole(left)).alias("width"), F.greatest(F.lit(0), whole(bottom) - whole(top)).alias("height"), c.alias("confidence")]
