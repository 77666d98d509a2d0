"""Page-preparation tables derived from the driver's tables, as DataFrames and as DuckDB SQL.

Every column is an expression of the driver's columns, so both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.tables import table


def pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id")
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    kind = F.when(F.col("rn") == 1, "cover").when(F.col("doc_id") % 17 == 3, "skip").when(F.col("doc_id") % 13 == 5, "plate_p").when(F.col("doc_id") % 11 == 7, "blank").otherwise("normal")
    return docs.withColumn("rn", rn).select(F.col("source").alias("project_id"), (F.col("rn") - 1).cast("int").alias("idx0"), "doc_id", kind.alias("page_type"))


def leaves(spark: SparkSession, d: str) -> DataFrame:
    kind, doc = F.col("page_type"), F.col("doc_id")
    role = F.when(kind == "normal", "text").when(kind == "plate_p", "plate").otherwise(kind)
    run = F.when(kind.isin("cover", "skip", "plate_p"), None).when((kind == "blank") & (doc % 2 == 0), None).when(F.col("idx0") <= 3, "front").otherwise("body")
    return pages(spark, d).select("project_id", F.col("idx0").alias("scan"), "doc_id", "page_type", role.alias("leaf_role"), run.alias("run_id"), F.when(doc % 9 == 0, F.col("idx0").cast("string")).alias("ocr_folio"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    last = pages(spark, d).groupBy("project_id").agg(F.max("idx0").alias("mx"))
    one = lambda pos, run, style, lo, hi: F.struct(F.lit(pos).alias("run_pos"), F.lit(run).alias("run_id"), F.lit(style).alias("style"), F.lit("set").alias("start_mode"), F.lit(1).alias("start_no"), F.lit(1).alias("step_no"), F.lit(lo).alias("lo"), hi.alias("hi"))
    both = F.array(one(0, "front", "roman-lower", 0, F.lit(3)), one(1, "body", "arabic", 4, F.col("mx")))
    return last.select("project_id", F.inline(both))


def text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    t = F.col("text")
    for a, b in (("tion ", "ti-\non "), (" and ", " — and "), ("The ", "“The” "), (" the ", " tbe ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return pages(spark, d).join(docs, "doc_id").select("project_id", "idx0", "doc_id", t.alias("raw_text"))


def page_stages(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "purchase"), "clean").when(kind == "view", "running").when(kind == "signup", "dirty").otherwise("failed")
    return table(spark, d, "events").select(
        F.concat(F.lit("proj"), (F.col("user_id") % 10).cast("string")).alias("project_id"), (F.col("user_id") % 50).cast("int").alias("page_no"),
        (F.col("event_id") % 16).cast("int").alias("stage_ord"), status.alias("status"), F.col("event_id").alias("seq"), "ts",
    )


def boxes(spark: SparkSession, d: str) -> DataFrame:
    i = lambda e: e.cast("int")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("box_no"), i(F.col("l_partkey") % 400).alias("x"), i(F.col("l_suppkey") * 37 % 900).alias("y"),
        i(10 + F.col("l_partkey") % 90).alias("w"), i(10 + F.col("l_suppkey") % 40).alias("h"),
    )


SQL = {
    "fx_pages": """SELECT d.source AS project_id, CAST(d.rn - 1 AS INT) AS idx0, d.doc_id,
  CASE WHEN d.rn = 1 THEN 'cover' WHEN d.doc_id % 17 = 3 THEN 'skip' WHEN d.doc_id % 13 = 5 THEN 'plate_p'
       WHEN d.doc_id % 11 = 7 THEN 'blank' ELSE 'normal' END AS page_type
FROM (SELECT source, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) d""",
    "fx_leaves": """SELECT project_id, idx0 AS scan, doc_id, page_type,
  CASE page_type WHEN 'normal' THEN 'text' WHEN 'plate_p' THEN 'plate' ELSE page_type END AS leaf_role,
  CASE WHEN page_type IN ('cover','skip','plate_p') THEN NULL WHEN page_type = 'blank' AND doc_id % 2 = 0 THEN NULL
       WHEN idx0 <= 3 THEN 'front' ELSE 'body' END AS run_id,
  CASE WHEN doc_id % 9 = 0 THEN CAST(idx0 AS VARCHAR) ELSE NULL END AS ocr_folio
FROM fx_pages""",
    "fx_runs": """SELECT p.project_id, r.run_pos, r.run_id, r.style, r.start_mode, r.start_no, r.step_no, r.lo,
  CASE WHEN r.run_id = 'front' THEN 3 ELSE p.mx END AS hi
FROM (SELECT project_id, MAX(idx0) AS mx FROM fx_pages GROUP BY project_id) p CROSS JOIN
 (SELECT 0 AS run_pos, 'front' AS run_id, 'roman-lower' AS style, 'set' AS start_mode, 1 AS start_no, 1 AS step_no, 0 AS lo
  UNION ALL SELECT 1, 'body', 'arabic', 'set', 1, 1, 4) r""",
    "fx_text": """SELECT p.project_id, p.idx0, p.doc_id,
  REPLACE(REPLACE(REPLACE(REPLACE(d.text, 'tion ', 'ti-' || CHR(10) || 'on '), ' and ', ' ' || CHR(8212) || ' and '), 'The ', CHR(8220) || 'The' || CHR(8221) || ' '), ' the ', ' tbe ') AS raw_text
FROM fx_pages p JOIN documents d ON p.doc_id = d.doc_id""",
    "fx_page_stages": """SELECT 'proj' || CAST(user_id % 10 AS VARCHAR) AS project_id, CAST(user_id % 50 AS INT) AS page_no, CAST(event_id % 16 AS INT) AS stage_ord,
  CASE event_type WHEN 'click' THEN 'clean' WHEN 'purchase' THEN 'clean' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'dirty' ELSE 'failed' END AS status,
  event_id AS seq, ts FROM events""",
    "fx_boxes": """SELECT l_orderkey AS page_no, l_linenumber AS box_no, CAST(l_partkey % 400 AS INT) AS x, CAST(l_suppkey * 37 % 900 AS INT) AS y,
  CAST(10 + l_partkey % 90 AS INT) AS w, CAST(10 + l_suppkey % 40 AS INT) AS h FROM lineitem""",
    "fx_state": """SELECT project_id, page_no, stage_ord, status, seq FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, page_no, stage_ord ORDER BY seq DESC) AS rn FROM fx_page_stages) WHERE rn = 1""",
}
_NEEDS = {"fx_leaves": ["fx_pages"], "fx_runs": ["fx_pages"], "fx_text": ["fx_pages"], "fx_state": ["fx_page_stages"]}


def oracle(sql: str, *views: str, recursive: bool = False, **more: str) -> str:
    """``sql`` with the views it needs, and ``more`` named steps, in front."""
    names: list[str] = []
    for v in views:
        for n in (*_NEEDS.get(v, []), v):
            if n not in names:
                names.append(n)
    steps = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    return (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(steps) + "\n" if steps else "") + sql
