"""Package queries: archives are written to the shared folder, read back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as X
from quire.registry import query
from quire.sources import packages, zipfiles
from quire.tables import shared_folder, stored, table

BUILT = "2024-01-01T00:00:00"
_PREFIX = "printf('%05dp', idx0)"
_CROPS = "doc_id % 5"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their text, its bytes as image, and crops; skipped pages have no prefix."""
    rows = X.pages(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    crops = F.when(F.col("doc_id") % 5 > 0, F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 5).cast("int")), lambda k: F.struct(F.format_string("crop%d.png", k).alias("name"), F.concat(k.cast("string"), F.lit(" of "), F.col("doc_id").cast("string")).cast("binary").alias("content"))))
    return rows.select(
        "project_id", F.col("idx0").alias("pos"), F.when(F.col("page_type") != "skip", F.format_string("%05dp", "idx0")).alias("prefix"), F.when(F.col("page_type") != "blank", F.col("text").cast("binary")).alias("image"), "text",
        crops.cast("array<struct<name:string,content:binary>>").alias("crops"),
    )


def _saved(spark: SparkSession, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, the archives' files) of packages written to a folder of their own."""
    folder = f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    saved = stored(packages.save(parts, folder.removeprefix("file:").replace("//", "/")))
    return saved, zipfiles.files(spark, f"{folder}/*.zip")


def _project() -> Column:
    return F.regexp_extract("path", r"([^/]+)\.zip$", 1)


_ENTRIES = f"""WITH fx_pages AS ({X.SQL["fx_pages"]}), p AS (SELECT f.*, d.text FROM fx_pages f JOIN documents d ON d.doc_id = f.doc_id WHERE page_type <> 'skip'),
e AS (SELECT project_id, {_PREFIX} || '.png' AS entry, text AS data FROM p WHERE page_type <> 'blank' AND text IS NOT NULL
  UNION ALL SELECT project_id, {_PREFIX} || '.txt', text FROM p WHERE text IS NOT NULL
  UNION ALL SELECT project_id, 'images/' || {_PREFIX} || printf('_%02d.png', CAST(k AS INT)), CAST(k AS VARCHAR) || ' of ' || CAST(doc_id AS VARCHAR) FROM p, range(1, 5) r(k) WHERE k <= {_CROPS})
"""


@query(_ENTRIES + "SELECT project_id, entry, CAST(strlen(data) AS BIGINT) AS size, md5(data) AS digest FROM e")
def package_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of every submission but the manifest, as it comes back out of the archive."""
    _, found = _saved(spark, packages.archive_parts(packages.submission(_pages(spark, d), "A book", BUILT)))
    back = zipfiles.entries(found, F.col("entry") != "pgdp.json")
    return back.select(_project().alias("project_id"), "entry", "size", F.md5("content").alias("digest"))


@query(
    _ENTRIES
    + f"SELECT project_id AS project, COUNT(*) FILTER (entry LIKE '%p.png') AS pages, 'A book' AS canvas, '{BUILT}' AS built, COUNT(*) + 1 AS files, TRUE AS same FROM e GROUP BY project_id"
)
def package_manifests(spark: SparkSession, d: str) -> DataFrame:
    """What packages say of themselves, and whether what was recorded while they were written is so."""
    records, found = _saved(spark, packages.archive_parts(packages.submission(_pages(spark, d), "A book", BUILT)))
    told = zipfiles.package_manifests(found, _project())
    both = told.join(records.select(F.col("project_id").alias("project"), F.col("sha256").alias("s"), "file_count"), "project")
    return both.select("project", "pages", "canvas", "built", "files", ((F.col("sha256") == F.col("s")) & (F.col("files") == F.col("file_count"))).alias("same"))


_FIRST = f"""WITH fx_pages AS ({X.SQL["fx_pages"]}), p AS (SELECT f.*, d.text FROM fx_pages f JOIN documents d ON d.doc_id = f.doc_id WHERE page_type <> 'skip'),
o AS (SELECT p.*, k, {_PREFIX} || CASE WHEN k = 0 THEN 'a' ELSE 'b' END AS full_prefix FROM p, range(0, 2) r(k) WHERE k <= doc_id % 2)
SELECT project_id, full_prefix || '.png' AS entry, md5(full_prefix) AS digest FROM o
UNION ALL SELECT project_id, 'cover.png', md5(full_prefix) FROM o WHERE page_type = 'cover' AND k = 0
UNION ALL SELECT project_id, full_prefix || '.txt', md5(text) FROM o WHERE k = 0 AND text IS NOT NULL
UNION ALL SELECT project_id, 'images/' || {_PREFIX} || '_03.jpg', md5(CAST(doc_id AS VARCHAR)) FROM p WHERE doc_id % 3 = 0"""


@query(_FIRST)
def first_package_entries(spark: SparkSession, d: str) -> DataFrame:
    """Packages of the first kind: outputs of split pages, the cover's alias, regions."""
    pages = X.pages(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("prefix", F.format_string("%05dp", "idx0"))
    output = lambda k, name: F.struct(F.lit(k).alias("reading_order"), F.concat("prefix", F.lit(name)).alias("full_prefix"), F.concat("prefix", F.lit(name)).cast("binary").alias("image"), (F.col("text") if k == 0 else F.lit(None).cast("string")).alias("text"))
    region = F.array(F.struct(F.lit(3).alias("index"), F.lit("jpg").alias("output_format"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string").cast("binary")).alias("content")))
    rows = pages.select(
        "project_id", "idx0", "prefix", F.lit("stem").alias("source_stem"), "page_type", (F.col("page_type") == "skip").alias("ignore"), F.array(F.lit("a")).alias("splits"),
        F.when(F.col("doc_id") % 2 == 0, F.array(output(0, "a"))).otherwise(F.array(output(1, "b"), output(0, "a"))).alias("outputs"), region.alias("regions"),
    )
    _, found = _saved(spark, packages.archive_parts(packages.first_package(rows, "A book", BUILT)))
    back = zipfiles.entries(found, F.col("entry") != "pgdp.json")
    return back.select(_project().alias("project_id"), "entry", F.md5("content").alias("digest"))
