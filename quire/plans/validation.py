"""Validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.functions.text import name_errors
from quire.operators import checks as C
from quire.registry import query
from quire.tables import table

_FILES = """SELECT source AS project_id, doc_id AS pos, CASE WHEN doc_id % 19 = 0 THEN 'pgdp.json' WHEN doc_id % 7 = 0 THEN 'images/pic' || doc_id || '.jpg' WHEN doc_id % 5 = 0 THEN 'read' || doc_id || '.PNG' WHEN doc_id % 11 = 0 THEN 'a very long name ' || doc_id || '.gif' WHEN doc_id % 2 = 0 THEN 'p' || doc_id || '.png' ELSE 'p' || (doc_id - 1) || '.txt' END AS name FROM documents"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    m = lambda n: F.col("doc_id") % n == 0
    name = (
        F.when(m(19), "pgdp.json").when(m(7), F.concat(F.lit("images/pic"), i, F.lit(".jpg"))).when(m(5), F.concat(F.lit("read"), i, F.lit(".PNG")))
        .when(m(11), F.concat(F.lit("a very long name "), i, F.lit(".gif"))).when(m(2), F.concat(F.lit("p"), i, F.lit(".png"))).otherwise(F.concat(F.lit("p"), (F.col("doc_id") - 1).cast("string"), F.lit(".txt")))
    )
    return table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("pos"), name.alias("name"))


_PARTS = "SELECT project_id, pos, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '\\.[^.]*$') AS ext FROM files WHERE name <> 'pgdp.json' AND name NOT LIKE 'images/%' AND name LIKE '%.%'"
_NAMED = """SELECT project_id, UNNEST(list_filter([CASE WHEN length(stem) > 8 THEN 'basename_too_long' END, CASE WHEN NOT regexp_full_match(stem, '[A-Za-z0-9_-]+') THEN 'invalid_chars' END, CASE WHEN ext <> lower(ext) THEN 'uppercase_ext' END,
 CASE WHEN lower(ext) NOT IN ('.png', '.txt', '.jpg') THEN 'disallowed_ext' END, CASE WHEN contains(lower(stem), 'ad') THEN 'ad_substring' END], lambda x: x IS NOT NULL)) AS code, stem AS subject FROM parts"""


@query(
    oracle(
        """SELECT * FROM named UNION ALL
SELECT project_id, CASE WHEN BOOL_OR(lower(ext) = '.png') THEN 'missing_txt' ELSE 'missing_png' END, stem FROM parts WHERE lower(ext) IN ('.png', '.txt') GROUP BY project_id, stem HAVING BOOL_OR(lower(ext) = '.png') <> BOOL_OR(lower(ext) = '.txt')
UNION ALL SELECT project_id, 'sort_order', '' FROM (SELECT project_id, stem, LAG(stem) OVER (PARTITION BY project_id ORDER BY pos) AS before FROM parts WHERE lower(ext) = '.png') GROUP BY project_id HAVING COUNT(CASE WHEN before > stem THEN 1 END) > 0""",
        files=_FILES, parts=_PARTS, named=_NAMED,
    )
)
def package_errors(spark: SparkSession, d: str) -> DataFrame:
    return C.package_errors(_files(spark, d))


@query(oracle("SELECT project_id, string_agg(code, ',' ORDER BY code) AS codes, subject FROM named GROUP BY project_id, subject", files=_FILES, parts=_PARTS, named=_NAMED))
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    """Broken naming rules of each file."""
    parts = _files(spark, d).where("name <> 'pgdp.json' and name not like 'images/%' and name like '%.%'")
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"\.[^.]*$", 0)
    found = parts.select("project_id", stem.alias("subject"), F.explode(name_errors(stem, ext)).alias("code"))
    return found.groupBy("project_id", "subject").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("codes"))


_BLOCK = """SELECT p.project_id, p.idx0, CASE WHEN p.doc_id % 6 = 0 THEN 'missing_text_review' WHEN p.doc_id % 4 <> 1 THEN 'unattested_text_review' END AS blocker FROM fx_pages p"""


def _blockers(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(spark, d)
    doc = F.col("doc_id")
    attested = pages.where(doc % 4 != 2).select("project_id", "idx0", F.when(doc % 4 == 1, '{"status": "clean"}').when(doc % 4 == 3, '{"status": "open"}').otherwise("{").alias("attestation"))
    return C.review_blockers(pages, pages.where(doc % 6 != 0), attested)


@query(oracle("SELECT * FROM b WHERE blocker IS NOT NULL", "fx_pages", b=_BLOCK))
def review_blockers(spark: SparkSession, d: str) -> DataFrame:
    return _blockers(spark, d)


@query(oracle("SELECT project_id, CAST(COUNT(blocker) AS BIGINT) AS blockers, CAST(0 AS BIGINT) AS warnings, COUNT(blocker) = 0 AS passed FROM b GROUP BY project_id", "fx_pages", b=_BLOCK))
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return C.report(fx.pages(spark, d), _blockers(spark, d))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'empty_zip,no_pages' WHEN o_orderkey % 3 = 0 THEN 'empty_zip' WHEN o_custkey % 2 = 0 THEN 'no_pages' ELSE '' END AS errors FROM orders")
def submit_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.array_join(C.submit_errors(F.col("o_orderkey") % 3, F.col("o_custkey") % 2), ",").alias("errors"))


@query("SELECT l_orderkey AS archive, CAST(COUNT(*) AS BIGINT) AS n, CAST(MAX(l_quantity) AS BIGINT) AS largest, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CASE WHEN COUNT(*) > 6 THEN 'too-many-entries' WHEN MAX(l_quantity) > 48 THEN 'entry-too-large' WHEN SUM(l_quantity) > 100 THEN 'total-too-large' END AS violation FROM lineitem GROUP BY l_orderkey")
def zip_limits(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.lit(0).cast("bigint").alias("archive_bytes"), F.col("l_quantity").cast("bigint").alias("size"))
    return C.zip_limits(entries, 1, 6, 48, 100)


@query(oracle("SELECT project_id, CASE WHEN project_id LIKE '%1' THEN 'count' WHEN project_id LIKE '%2' THEN 'duplicate' WHEN project_id LIKE '%3' THEN 'unknown' END AS error FROM (SELECT DISTINCT project_id FROM fx_pages)", "fx_pages"))
def reorder_checks(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(spark, d)
    p = F.col("project_id")
    order = pages.where(~(p.like("%1") & (F.col("idx0") == 0))).select("project_id", F.when(p.like("%2") & (F.col("idx0") == 1), 0).when(p.like("%3") & (F.col("idx0") == 1), -5).otherwise(F.col("idx0")).alias("idx0"))
    return C.reorder_errors(pages, order)
