"""Filters, paging, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.operators import listing as L
from quire.registry import query
from quire.tables import table


@query(oracle("SELECT project_id, idx0, page_type, CAST(total AS BIGINT) AS total, CAST(CASE WHEN total > 8 THEN 8 END AS INT) AS next FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY idx0) AS n, COUNT(*) OVER (PARTITION BY project_id) AS total FROM fx_pages WHERE page_type IN ('normal', 'blank')) WHERE n BETWEEN 4 AND 8", "fx_pages"))
def page_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.pages(spark, d).where(F.col("page_type").isin("normal", "blank"))
    return L.page(rows, ["project_id"], ["idx0"], 3, 5).select("project_id", "idx0", "page_type", "total", "next")


@query("SELECT o_orderkey, o_totalprice > 400000 OR (COUNT(l_orderkey) > 0 AND BOOL_OR(COALESCE(l_linestatus <> 'F' OR l_quantity > 49, FALSE))) AS needs_review FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice")
def needs_review(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "F", "complete").otherwise("running")
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(status.alias("status"), F.when(F.col("l_quantity") > 49, "too many").alias("error"))).alias("outputs"))
    joined = table(spark, d, "orders").join(out, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    outputs = F.coalesce("outputs", F.array().cast("array<struct<status:string,error:string>>"))
    return joined.select("o_orderkey", L.needs_review(F.when(F.col("o_totalprice") > 400000, "dear"), outputs).alias("needs_review"))


@query(oracle("SELECT project_id, idx0 FROM fx_pages WHERE page_type IN ('blank', 'plate_b', 'plate_r')", "fx_pages"))
def blank_pages(spark: SparkSession, d: str) -> DataFrame:
    return L.blank_pages(fx.pages(spark, d)).select("project_id", "idx0")


@query(oracle("SELECT project_id, idx0 FROM fx_pages WHERE page_type IN ('blank','plate_p','plate_b','plate_r') OR doc_id % 5 IN (1, 2) OR doc_id % 23 = 0 OR doc_id % 29 = 0 OR doc_id % 31 = 0", "fx_pages"))
def ocr_crop_skips(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    align = F.when(i % 5 == 1, "center").when(i % 5 == 2, "bottom").otherwise("default")
    rows = fx.pages(spark, d).withColumn("alignment", align).withColumn("rotated", i % 23 == 0).withColumn("single_dim", i % 29 == 0).withColumn("n_splits", F.when(i % 31 == 0, 2).otherwise(0))
    return L.skips_ocr_crop(rows).select("project_id", "idx0")


@query("SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY event_id LIMIT 50)")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 50 notifications, last one first: a top-k report."""
    return L.oldest_reversed(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", 50)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patched_rows(spark: SparkSession, d: str) -> DataFrame:
    """A field that is named is written, a null too; one that isn't stays."""
    rows, key = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey")
    changes = rows.where((key % 3 == 0) | (key % 4 == 0)).select(
        "c_custkey", F.lit(None).cast("string").alias("c_name"), (key % 3 == 0).alias("has_c_name"), F.lit("changed").alias("c_mktsegment"), (key % 4 == 0).alias("has_c_mktsegment")
    )
    return L.patch(rows, changes, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("SELECT CAST(event_id // 100 AS BIGINT) AS batch, event_id AS seq, CAST(ROW_NUMBER() OVER (PARTITION BY event_id // 100 ORDER BY user_id % 3, event_id) AS INT) AS position FROM events")
def batch_order(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("batch"), F.col("event_id").alias("seq"), (F.col("user_id") % 3).alias("priority"))
    return L.batch_order(jobs).select("batch", "seq", "position")


@query("SELECT DISTINCT COALESCE(c_mktsegment, 'default') AS owner FROM customer")
def owners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.coalesce("c_mktsegment", F.lit("default")).alias("owner")).distinct()


@query("SELECT o_orderstatus AS owner, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS position FROM orders WHERE o_custkey % 10 <> 0")
def project_listing(spark: SparkSession, d: str) -> DataFrame:
    """Projects of each owner, the last updated first, without archived ones."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").where("o_custkey % 10 <> 0").select(F.col("o_orderstatus").alias("owner"), "o_orderkey", F.row_number().over(order).alias("position"))


@query("SELECT source AS project_id, CAST(SUM(octet_length(encode(text))) AS BIGINT) AS bytes, COUNT(*) AS files FROM documents GROUP BY source")
def disk_cost(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("project_id")).agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.count("*").alias("files"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(oracle("SELECT p.project_id, p.idx0, p.doc_id % 3 <> 0 AS has_image, p.doc_id % 4 <> 0 AS has_text FROM fx_pages p", "fx_pages"))
def proof_pack(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(spark, d)
    has = lambda n, name: pages.where(F.col("doc_id") % n != 0).select("project_id", "idx0", F.lit(True).alias(name))
    out = pages.join(has(3, "i"), ["project_id", "idx0"], "left").join(has(4, "t"), ["project_id", "idx0"], "left")
    return out.select("project_id", "idx0", F.coalesce("i", F.lit(False)).alias("has_image"), F.coalesce("t", F.lit(False)).alias("has_text"))


@query(oracle("SELECT project_id, CAST(SUM(CASE WHEN running OR illustration THEN 0 ELSE n END) AS BIGINT) AS words, ROUND(AVG(CASE WHEN NOT running AND NOT illustration THEN COALESCE(c, 1.0) END), 6) AS mean_confidence FROM (SELECT project_id, doc_id % 7 = 0 AS running, doc_id % 5 = 0 AS illustration, idx0 * 10 AS n, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 100) / 100.0 END AS c FROM fx_pages) GROUP BY project_id", "fx_pages"))
def ocr_totals(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    counted = (i % 7 != 0) & (i % 5 != 0)
    c = F.coalesce(F.when(i % 4 != 0, i % 100 / 100.0), F.lit(1.0))
    return fx.pages(spark, d).groupBy("project_id").agg(F.sum(F.when(counted, F.col("idx0") * 10).otherwise(0)).cast("bigint").alias("words"), F.round(F.avg(F.when(counted, c)), 6).alias("mean_confidence"))


@query(oracle("SELECT project_id, idx0, MIN(CASE WHEN doc_id % 8 = 0 THEN idx0 END) OVER (PARTITION BY project_id ORDER BY idx0 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_flagged FROM fx_pages", "fx_pages"))
def next_flagged(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.listing import next_marked

    return next_marked(fx.pages(spark, d), F.col("doc_id") % 8 == 0).select("project_id", "idx0", "next_flagged")


@query(oracle("SELECT project_id, idx0 AS parent_idx0, CAST(k AS INT) AS split_index, suffix FROM (SELECT project_id, idx0, UNNEST(['a', 'b']) AS suffix, UNNEST([1, 2]) AS k FROM fx_pages WHERE doc_id % 31 = 0)", "fx_pages"))
def split_children(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.stages import split_children as split

    part = lambda s: F.struct(F.lit(s).alias("suffix"))
    return split(fx.pages(spark, d).where("doc_id % 31 = 0").withColumn("splits", F.array(part("a"), part("b"))))


@query(oracle("SELECT p.project_id, p.idx0, p.doc_id FROM fx_pages p WHERE p.doc_id % 5 <> 2 OR p.idx0 % 4 <> 0", "fx_pages"))
def unsplit_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages after the splits of some parents were taken back: their children are gone."""
    from quire.operators import stages

    pages = fx.pages(spark, d).select("project_id", "idx0", "doc_id", F.when(F.col("doc_id") % 5 == 2, F.col("idx0") % 4).alias("parent_idx0"))
    parents = pages.where("parent_idx0 = 0").select("project_id", "parent_idx0")
    left, _ = stages.unsplit(pages, pages.select("project_id", "idx0"), parents)
    return left.select("project_id", "idx0", "doc_id")
