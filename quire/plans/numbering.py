"""Numbering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.operators import numbering as N
from quire.registry import query
from quire.tables import table

_ORD = """SELECT l.*, r.style, CASE WHEN l.leaf_role <> 'plate' AND r.style IS NOT NULL THEN r.start_no + (COUNT(CASE WHEN l.leaf_role <> 'plate' AND r.style IS NOT NULL THEN 1 END) OVER (PARTITION BY l.project_id, l.run_id ORDER BY l.scan) - 1) * r.step_no END AS ordinal
FROM fx_leaves l LEFT JOIN fx_runs r ON l.project_id = r.project_id AND l.run_id = r.run_id"""
_ROMAN = "list_extract(['','m','mm','mmm'], CAST(n // 1000 + 1 AS INT)) || list_extract(['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'], CAST(n // 100 % 10 + 1 AS INT)) || list_extract(['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'], CAST(n // 10 % 10 + 1 AS INT)) || list_extract(['','i','ii','iii','iv','v','vi','vii','viii','ix'], CAST(n % 10 + 1 AS INT))"
_LAB = f"""SELECT *, CASE WHEN leaf_role = 'plate' THEN '—' WHEN style IS NULL THEN CASE WHEN leaf_role = 'blank' THEN '[Blank Page]' ELSE '' END WHEN style = 'roman-lower' THEN {_ROMAN.replace("n //", "ordinal //").replace("n %", "ordinal %")} ELSE CAST(ordinal AS VARCHAR) END AS label FROM o"""
_PRE = """SELECT o.*, CASE WHEN leaf_role = 'skip' THEN NULL WHEN leaf_role = 'cover' THEN seq || 'e' WHEN leaf_role = 'plate' THEN seq || sec || 'p' WHEN ordinal IS NOT NULL THEN seq || sec || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(3, length(CAST(ordinal AS VARCHAR))) AS INT), '0') END AS prefix
FROM (SELECT o.*, CASE WHEN scan BETWEEN 0 AND 3 THEN 'f' ELSE 'p' END AS sec, lpad(CAST(scan - ps AS VARCHAR), CASE WHEN mx - ps + 1 > 999 THEN 4 ELSE 3 END, '0') AS seq FROM o JOIN
 (SELECT project_id, MIN(CASE WHEN leaf_role IN ('cover','plate','blank') OR run_id IS NOT NULL THEN scan END) AS ps, MAX(scan) AS mx FROM fx_leaves GROUP BY project_id) s USING (project_id)) o"""
_V = ("fx_leaves", "fx_runs")


@query(oracle("SELECT project_id, scan, CAST(ordinal AS INT) AS ordinal FROM o", *_V, o=_ORD))
def folio_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return N.ordinals(fx.leaves(spark, d), fx.runs(spark, d)).select("project_id", "scan", "ordinal")


@query(oracle("SELECT project_id, scan, label FROM l", *_V, o=_ORD, l=_LAB))
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    return N.labels(fx.leaves(spark, d), fx.runs(spark, d)).select("project_id", "scan", "label")


_CONT = """SELECT l.project_id, l.scan, CAST(CASE WHEN l.leaf_role <> 'plate' AND l.run_id = 'front' THEN f WHEN l.leaf_role <> 'plate' AND l.run_id = 'body' THEN COALESCE(MAX(CASE WHEN l.leaf_role <> 'plate' AND l.run_id = 'front' THEN f END) OVER (PARTITION BY l.project_id ORDER BY l.scan), 0) + f END AS INT) AS ordinal
FROM (SELECT *, COUNT(CASE WHEN leaf_role <> 'plate' THEN 1 END) OVER (PARTITION BY project_id, run_id ORDER BY scan) AS f FROM fx_leaves) l"""


@query(oracle("SELECT * FROM c", "fx_leaves", c=_CONT))
def continued_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """The body's run goes on from the front's: the fold over each project's leaves."""
    runs = fx.runs(spark, d).withColumn("start_mode", F.when(F.col("run_id") == "body", "continue").otherwise("set"))
    return N.ordinals_with_continue(fx.leaves(spark, d), runs).select("project_id", "scan", "ordinal")


@query(oracle("SELECT project_id, scan, prefix FROM p", *_V, o=_ORD, p=_PRE))
def file_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return N.prefixes(fx.leaves(spark, d), fx.runs(spark, d)).select("project_id", "scan", "prefix")


@query(
    oracle(
        "SELECT project_id, scan, label, prefix, CASE WHEN prefix IS NOT NULL THEN lpad(CAST(n_at - 1 AS VARCHAR), CASE WHEN total > 999 THEN 4 ELSE 3 END, '0') END AS export_name FROM (SELECT p.*, l.label, COUNT(prefix) OVER (PARTITION BY p.project_id ORDER BY p.scan) AS n_at, COUNT(prefix) OVER (PARTITION BY p.project_id) AS total FROM p JOIN l USING (project_id, scan))",
        *_V, o=_ORD, l=_LAB, p=_PRE,
    )
)
def page_manifest(spark: SparkSession, d: str) -> DataFrame:
    return N.manifest(fx.leaves(spark, d), fx.runs(spark, d)).select("project_id", "scan", "label", "prefix", "export_name")


@query(
    oracle(
        "SELECT project_id, scan, label NOT IN ('', '—', '[Blank Page]') AND ROW_NUMBER() OVER (PARTITION BY project_id, label ORDER BY scan) > 1 AS duplicate, label NOT IN ('', '—', '[Blank Page]') AND ocr_folio IS NOT NULL AND COALESCE(ocr_folio <> label, FALSE) AS out_of_sequence FROM l",
        *_V, o=_ORD, l=_LAB,
    )
)
def label_flags(spark: SparkSession, d: str) -> DataFrame:
    return N.reconcile(N.labels(fx.leaves(spark, d), fx.runs(spark, d))).select("project_id", "scan", "duplicate", "out_of_sequence")


@query(oracle("SELECT project_id, MIN(CASE WHEN leaf_role IN ('cover','plate','blank') OR run_id IS NOT NULL THEN scan END) AS proof_start, MAX(scan) AS max_scan FROM fx_leaves GROUP BY project_id", "fx_leaves"))
def proof_starts(spark: SparkSession, d: str) -> DataFrame:
    return N.proof_start(fx.leaves(spark, d))


@query(oracle("SELECT project_id, idx0, CASE page_type WHEN 'normal' THEN 'text' WHEN 'plate_p' THEN 'plate' ELSE page_type END AS leaf_role, CASE WHEN page_type = 'plate_p' THEN 'recto' END AS side, CASE WHEN page_type IN ('normal','blank') THEN CASE WHEN idx0 BETWEEN 0 AND 3 THEN 'front' WHEN idx0 BETWEEN 4 AND 20 THEN 'body' END END AS run_id FROM fx_pages", "fx_pages"))
def seeded_runs(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(spark, d)
    ranges = pages.select("project_id").distinct().select("project_id", F.lit(0).alias("front_lo"), F.lit(3).alias("front_hi"), F.lit(4).alias("body_lo"), F.lit(20).alias("body_hi"))
    return N.seed_runs(pages, ranges).select("project_id", "idx0", "leaf_role", "side", "run_id")


@query(oracle("SELECT project_id, MIN(scan) AS lo, MAX(scan) AS hi, 'arabic' AS style FROM fx_leaves GROUP BY project_id", "fx_leaves"))
def default_runs(spark: SparkSession, d: str) -> DataFrame:
    return N.default_runs(fx.leaves(spark, d)).select("project_id", "lo", "hi", "style")


@query(oracle("SELECT project_id, CAST(mx - idx0 AS INT) AS idx0, idx0 AS old_idx0, doc_id FROM (SELECT *, MAX(idx0) OVER (PARTITION BY project_id) AS mx FROM fx_pages)", "fx_pages"))
def reordered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every book back to front."""
    pages = fx.pages(spark, d)
    last = pages.groupBy("project_id").agg(F.max("idx0").alias("mx"))
    order = pages.join(last, "project_id").select("project_id", "idx0", (F.col("mx") - F.col("idx0")).alias("position"))
    return N.reorder(pages, order).select("project_id", "idx0", "old_idx0", "doc_id")


@query(oracle("SELECT project_id, CAST(CASE WHEN idx0 >= 2 THEN idx0 + 1 ELSE idx0 END AS INT) AS idx0, doc_id FROM fx_pages UNION ALL SELECT DISTINCT project_id, 2, -1 FROM fx_pages", "fx_pages"))
def inserted_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(spark, d)
    new = pages.select("project_id").distinct().select("project_id", F.lit(2).alias("at_idx0"), F.lit(-1).cast("bigint").alias("doc_id"), F.lit("blank").alias("page_type"))
    return N.insert_page(pages, new).select("project_id", "idx0", "doc_id")


@query(oracle("SELECT project_id, run_id, CAST(CASE WHEN lo > 3 THEN lo + 1 ELSE lo END AS INT) AS lo, CAST(CASE WHEN hi >= 3 THEN hi + 1 ELSE hi END AS INT) AS hi FROM fx_runs", "fx_runs"))
def shifted_spans(spark: SparkSession, d: str) -> DataFrame:
    runs = fx.runs(spark, d)
    return N.shift_spans(runs, runs.select("project_id").distinct().withColumn("at_idx0", F.lit(3))).select("project_id", "run_id", "lo", "hi")


@query("SELECT source, before, doc_id AS after, doc_id - before - 1 AS missing FROM (SELECT source, doc_id, LAG(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) WHERE doc_id - before > 1")
def number_gaps(spark: SparkSession, d: str) -> DataFrame:
    return N.gaps(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query(oracle("SELECT l.project_id, l.scan, r.run_id AS span_run FROM fx_leaves l JOIN fx_runs r ON l.project_id = r.project_id AND l.scan BETWEEN r.lo AND r.hi", *_V))
def scans_in_spans(spark: SparkSession, d: str) -> DataFrame:
    """Range join of scans with the spans of their own project's runs."""
    runs = fx.runs(spark, d).select("project_id", F.col("run_id").alias("span_run"), "lo", "hi")
    return fx.leaves(spark, d).join(runs, "project_id").where(F.col("scan").between(F.col("lo"), F.col("hi"))).select("project_id", "scan", "span_run")
