"""Queries over parts of images: areas, specks, crops, regions. Embeddings are read as images of eight by eight gray pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import imageparts as P
from quire.operators import images as I
from quire.plans.events import _PIX, _pixels
from quire.registry import query

_AREAS = f"""WITH RECURSIVE v AS ({_PIX}), b AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, i FROM v, range(64) r(i) WHERE v[i + 1] <= 128),
r AS (SELECT vec_id, i, i AS j FROM b UNION SELECT r.vec_id, r.i, n.i FROM r JOIN b n ON n.vec_id = r.vec_id AND abs(n.y - r.j // 8) + abs(n.x - r.j % 8) = 1),
l AS (SELECT vec_id, i, min(j) AS label FROM r GROUP BY vec_id, i), a AS (SELECT l.vec_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS pixels FROM l JOIN b ON b.vec_id = l.vec_id AND b.i = l.i GROUP BY l.vec_id, label)
"""


@query(_AREAS + "SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM a WHERE pixels >= 3")
def image_zones(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the dark areas of three pixels or more."""

    def boxes(frames):
        for f in frames:
            rows = [(r.vec_id, *box) for r in f.itertuples(index=False) for box in I.zones(I.threshold(I.array(r.height, r.width, r.channels, r.data), 128), 3)]
            yield pd.DataFrame(rows, columns=["vec_id", "x", "y", "w", "h"])

    return _pixels(spark, d).mapInPandas(boxes, "vec_id long, x int, y int, w int, h int")


@query(_AREAS + f"SELECT vec_id, CAST(coalesce(sum(pixels) FILTER (pixels >= 6), 0) AS INT) AS black FROM (SELECT vec_id FROM v) LEFT JOIN a USING (vec_id) GROUP BY vec_id")
def denoised_images(spark: SparkSession, d: str) -> DataFrame:
    """Thresholded, small areas taken out; the black pixels left."""
    done = I.chain(_pixels(spark, d), "vec_id", [lambda x: I.threshold(x, 128), lambda x: I.denoise(x, 6)])
    return done.select("vec_id", (F.length(F.regexp_replace(F.hex("data"), "FF", "")) / 2).cast("int").alias("black"))


_HEX = "(SELECT string_agg(printf('%02x', CAST(v[yy * 8 + xx + 1] AS INT)), '' ORDER BY yy, xx) FROM range(CAST(top AS BIGINT), CAST(bottom AS BIGINT)) a(yy), range(CAST(lft AS BIGINT), CAST(rgt AS BIGINT)) b(xx))"


@query(f"""WITH v AS ({_PIX}), i AS (SELECT vec_id, v, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM v),
s AS (SELECT *, '' AS suffix, 0 AS reading_order, n AS lft, n AS top, 8 - n AS rgt, 8 - n AS bottom FROM i WHERE vec_id % 3 = 0
  UNION ALL SELECT *, 'b', 1, n, n, n + 3, 8 - n FROM i WHERE vec_id % 3 > 0 UNION ALL SELECT *, 'a', 0, n + 3, n, 8 - n, least(n + 20, 8 - n) FROM i WHERE vec_id % 3 > 0)
SELECT vec_id, suffix, reading_order, CAST(bottom - top AS INT) AS height, CAST(rgt - lft AS INT) AS width, {_HEX} AS pixels FROM s""")
def ocr_image_crops(spark: SparkSession, d: str) -> DataFrame:
    """The parts that OCR reads: insets off, then splits, one of them empty, one beyond the page."""
    split = lambda suffix, order, left, right, bottom: F.struct(F.lit(suffix).alias("suffix"), F.lit(order).alias("reading_order"), *(F.lit(x).cast("int").alias(n) for n, x in (("L", left), ("R", right), ("T", None), ("B", bottom))))
    splits = F.array(split("b", 1, -2, 3, None), split("a", 0, 3, None, 20), split("none", 2, 5, 5, None))
    n = F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0)
    rows = _pixels(spark, d).withColumn("splits", F.when(F.col("vec_id") % 3 > 0, splits)).withColumn("insets", F.struct(*(n.alias(s) for s in ("top", "bottom", "left", "right"))))
    return P.ocr_crops(rows, "vec_id").select("vec_id", "suffix", "reading_order", "height", "width", F.lower(F.hex("data")).alias("pixels"))


@query(f"""WITH v AS ({_PIX}), s AS (SELECT *, 4 AS index, CAST(vec_id % 5 AS INT) AS lft, 2 AS top, 8 AS rgt, 5 AS bottom FROM v WHERE vec_id % 4 = 0
  UNION ALL SELECT *, 5, 6, 0, 6, 8 FROM v WHERE vec_id % 4 = 0 UNION ALL SELECT *, 1, 0, 0, 8, 8 FROM v WHERE vec_id % 4 = 1)
SELECT vec_id, index, lft = rgt AS empty, CASE WHEN lft < rgt THEN {_HEX} END AS pixels FROM s""")
def region_image_crops(spark: SparkSession, d: str) -> DataFrame:
    """Regions of pages, an empty one among them, and the whole page of plates without any."""
    region = lambda index, left, top, right, bottom: F.struct(F.lit(index).alias("index"), left.cast("int").alias("L"), F.lit(top).alias("T"), F.lit(right).alias("R"), F.lit(bottom).alias("B"), F.lit(False).alias("gray"), F.lit("png").alias("output_format"))
    regions = F.array(region(4, F.col("vec_id") % 5, 2, 99, 5), region(5, F.lit(6), -3, 6, 0))
    kind = F.col("vec_id") % 4
    rows = _pixels(spark, d).withColumn("page_type", F.when(kind == 1, "plate_p").otherwise("normal")).withColumn("regions", F.when(kind == 0, regions))
    return P.region_crops(rows, "vec_id").select("vec_id", "index", F.coalesce(F.col("error").startswith("empty region"), F.lit(False)).alias("empty"), F.lower(F.hex("data")).alias("pixels"))
