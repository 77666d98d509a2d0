"""Geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.operators import geometry as G
from quire.registry import query
from quire.tables import table

_ZONES = """SELECT page_no, CAST(zone AS INT) AS zone, MIN(x) AS x, MIN(y) AS y, MAX(x + w) - MIN(x) AS w, MAX(y + h) - MIN(y) AS h, COUNT(*) AS boxes FROM
 (SELECT *, SUM(s) OVER (PARTITION BY page_no ORDER BY y, x, w, h ROWS UNBOUNDED PRECEDING) AS zone FROM
  (SELECT *, CASE WHEN y > MAX(y + h) OVER (PARTITION BY page_no ORDER BY y, x, w, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 1 ELSE 0 END AS s FROM fx_boxes)) GROUP BY page_no, zone"""


@query(oracle("SELECT * FROM z", "fx_boxes", z=_ZONES))
def merged_zones(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_zones(fx.boxes(spark, d))


@query(oracle("SELECT page_no, zone, 'z' || substr(sha1(x || ',' || y || ',' || w || ',' || h || ',' || zone), 1, 12) AS zone_id, ROUND(x / 500.0, 6) AS x_share, ROUND(y / 1000.0, 6) AS y_share, ROUND(w / 500.0, 6) AS w_share, ROUND(h / 1000.0, 6) AS h_share FROM z", "fx_boxes", z=_ZONES))
def zone_shares(spark: SparkSession, d: str) -> DataFrame:
    zones = G.normalise(G.merge_zones(fx.boxes(spark, d)), F.lit(500.0), F.lit(1000.0))
    shares = [F.round(f"{c}_share", 6).alias(f"{c}_share") for c in "xywh"]
    return zones.select("page_no", "zone", G.zone_id(*(F.col(c) for c in ("x", "y", "w", "h", "zone"))).alias("zone_id"), *shares)




@query(oracle("SELECT page_no, box_no, x, y, w, h, greatest(0, least(CASE WHEN box_no % 3 = 0 THEN 0 ELSE x - 20 END, 300)) AS l, greatest(0, least(y, 800)) AS t, greatest(0, least(x + w, 300)) AS r, greatest(0, least(CASE WHEN box_no % 3 = 1 THEN 800 ELSE y + h END, 800)) AS b FROM fx_boxes", "fx_boxes"))
def clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("box_no")
    box = G.clamp_box(F.when(b % 3 != 0, F.col("x") - 20), F.col("y"), F.col("x") + F.col("w"), F.when(b % 3 != 1, F.col("y") + F.col("h")), F.lit(300), F.lit(800))
    return fx.boxes(spark, d).select("page_no", "box_no", "x", "y", "w", "h", *box)


@query(oracle("SELECT page_no, box_no, x, y, w, h, greatest(0, x - CAST(trunc(w * 0.15) AS INT)) AS l, greatest(0, y - CAST(trunc(h * 0.15) AS INT)) AS t, least(480, x + w + CAST(trunc(w * 0.15) AS INT)) AS r, least(940, y + h + CAST(trunc(h * 0.15) AS INT)) AS b FROM fx_boxes", "fx_boxes"))
def padded_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = G.pad_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), 0.15, F.lit(480), F.lit(940))
    return fx.boxes(spark, d).select("page_no", "box_no", "x", "y", "w", "h", *box)


@query(oracle("SELECT page_no, box_no, x, y, w, h, CAST(greatest(1, floor(w * least(1.0, 25.0 / least(w, h)))) AS INT) AS thumb_width, CAST(greatest(1, floor(h * least(1.0, 25.0 / least(w, h)))) AS INT) AS thumb_height, CAST(greatest(1, round(w * 1.65)) AS INT) AS blank_height FROM (SELECT page_no, box_no, x, y, CAST(w AS DOUBLE) AS wd, CAST(h AS DOUBLE) AS hd, w, h FROM fx_boxes)", "fx_boxes"))
def target_sizes(spark: SparkSession, d: str) -> DataFrame:
    return fx.boxes(spark, d).select("page_no", "box_no", "x", "y", "w", "h", *G.thumbnail_size(F.col("w"), F.col("h"), 25), G.blank_size(F.col("w"), F.lit(1.65)).alias("blank_height"))


@query(
    oracle(
        "SELECT page_no, box_no, kind, CAST(confidence AS DOUBLE) AS confidence, CAST(ROW_NUMBER() OVER (PARTITION BY page_no ORDER BY box_no, x, y, w, h) AS INT) AS region FROM (SELECT *, CASE x % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'plate' ELSE 'text' END AS kind, (y % 100) / 100.0 AS confidence FROM fx_boxes) WHERE kind IN ('figure', 'plate') AND confidence >= 0.4",
        "fx_boxes",
    )
)
def kept_regions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("x") % 3 == 0, "figure").when(F.col("x") % 3 == 1, "plate").otherwise("text")
    regions = fx.boxes(spark, d).withColumn("kind", kind).withColumn("confidence", F.col("y") % 100 / 100.0)
    return G.keep_regions(regions, ["figure", "plate"], 0.4).select("page_no", "box_no", "kind", "confidence", "region")


@query(oracle("SELECT page_no, box_no, x, y, w, h, x AS \"left\", y AS top, greatest(0, w - 50) AS width, h AS height, CAST(CASE WHEN x % 7 = 0 THEN 0.0 ELSE (y % 100) / 100.0 END AS DOUBLE) AS confidence FROM fx_boxes", "fx_boxes"))
def engine_words(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("x") % 7 == 0, -1.0).otherwise((F.col("y") % 100).cast("double"))
    word = G.ocr_word(F.col("x"), F.col("y"), F.col("x") + F.col("w") - 50, F.col("y") + F.col("h"), c, percent=True)
    return fx.boxes(spark, d).select("page_no", "box_no", "x", "y", "w", "h", *word)


_SIGNALS = "SELECT label, AVG(v[1] * 40) AS a, AVG(v[2] * 40) AS b FROM (SELECT label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings) GROUP BY label"


@query(f"SELECT label, ROUND(a, 6) AS imbalance, ROUND(b, 6) AS chroma, CASE WHEN a > 20.0 THEN 'best_channel' WHEN b > 15.0 THEN 'best_channel' ELSE 'luma' END AS converter FROM ({_SIGNALS})")
def converters(spark: SparkSession, d: str) -> DataFrame:
    """Converter for each label's sample, from its mean signals."""
    v = lambda k: F.abs(F.element_at("embedding", k).cast("double")) * 40
    found = table(spark, d, "embeddings").groupBy("label").agg(F.avg(v(1)).alias("a"), F.avg(v(2)).alias("b"))
    return found.select("label", F.round("a", 6).alias("imbalance"), F.round("b", 6).alias("chroma"), G.converter(F.col("a"), F.col("b")).alias("converter"))


@query(oracle("SELECT page_no AS project_id, COALESCE(median(CASE WHEN box_no % 4 <> 0 THEN CAST(h AS DOUBLE) / w END), 1.65) AS ratio FROM fx_boxes GROUP BY page_no", "fx_boxes"))
def median_ratios(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.listing import median_ratio

    sizes = fx.boxes(spark, d).select(F.col("page_no").alias("project_id"), F.when(F.col("box_no") % 4 != 0, F.col("w")).alias("width"), F.col("h").alias("height"))
    return median_ratio(sizes)
