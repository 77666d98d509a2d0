"""Read models: rows and totals that lists of pages, rules and cases show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.operators import listing as L
from quire.operators import numbering as N
from quire.registry import query
from quire.tables import table

_PARENT = "CASE WHEN idx0 % 4 <> 0 AND doc_id % 3 = 0 THEN idx0 - idx0 % 4 END"


@query(oracle(f"SELECT project_id, CAST({_PARENT} AS INT) AS parent_idx0, idx0 AS child_idx0, CAST(ROW_NUMBER() OVER (PARTITION BY project_id, {_PARENT} ORDER BY idx0) AS INT) AS position FROM fx_pages WHERE {_PARENT} IS NOT NULL", "fx_pages"))
def children_by_parent(spark: SparkSession, d: str) -> DataFrame:
    idx0 = F.col("idx0")
    parent = F.when((idx0 % 4 != 0) & (F.col("doc_id") % 3 == 0), idx0 - idx0 % 4)
    return L.children(fx.pages(spark, d).withColumn("parent_idx0", parent))


@query("SELECT user_id AS owner, event_id AS job_id, CAST(position AS INT) AS position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS position FROM events) WHERE position <= 5")
def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The five newest jobs of each owner."""
    jobs = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("job_id"), "ts")
    return L.newest(jobs, "owner", [F.desc("ts"), F.col("job_id")], 5).select("owner", "job_id", "position")


_ZONES = "SELECT project_id, idx0, CASE doc_id % 7 WHEN 0 THEN 'reviewed' WHEN 4 THEN 'reviewed' WHEN 1 THEN 'flagged' WHEN 2 THEN 'running' WHEN 3 THEN 'failed' ELSE 'clean' END AS state, CASE WHEN doc_id % 7 IN (0, 4) THEN doc_id % 4 END AS zones FROM fx_pages"


def _zones(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(spark, d)
    i = F.col("doc_id") % 7
    status = F.when(i.isin(0, 4), "clean").when(i == 1, "dirty").when(i == 2, "running").otherwise("failed")
    zones = F.to_json(F.transform(F.array_repeat(F.lit("zone"), (F.col("doc_id") % 4).cast("int")), lambda x: x))
    states = pages.where(i < 5).select("project_id", "idx0", status.alias("status"), zones.alias("zones"))
    return L.zone_rows(pages.select("project_id", "idx0"), states)


@query(oracle(_ZONES, "fx_pages"))
def zone_rows(spark: SparkSession, d: str) -> DataFrame:
    return _zones(spark, d)


@query(oracle("SELECT project_id, COUNT(*) AS total, COUNT(*) FILTER (state = 'clean') AS clean, COUNT(*) FILTER (state = 'flagged') AS flagged, COUNT(*) FILTER (state = 'reviewed') AS reviewed, COUNT(*) FILTER (state IN ('reviewed', 'clean')) AS done, COUNT(*) FILTER (state = 'split') AS splits FROM z GROUP BY project_id", "fx_pages", z=_ZONES))
def zone_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.zone_totals(_zones(spark, d))


@query(oracle("SELECT project_id, COUNT(*) AS rules, COUNT(*) FILTER (doc_id % 4 <> 1 AND doc_id % 3 = 0) AS applied, COUNT(*) FILTER (doc_id % 4 <> 1 AND doc_id % 3 = 1) AS review, COUNT(*) FILTER (doc_id % 4 <> 1 AND doc_id % 3 = 2) AS pending, CAST(SUM(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE idx0 END) AS BIGINT) AS matches FROM fx_pages GROUP BY project_id", "fx_pages"))
def regex_counts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rules = fx.pages(spark, d).select(
        "project_id",
        F.when(i % 3 == 0, "applied").when(i % 3 == 1, "review").otherwise("pending").alias("status"),
        F.when(i % 4 == 1, False).when(i % 4 == 2, True).alias("enabled"),
        F.when(i % 5 == 0, "many").otherwise(F.col("idx0").cast("string")).alias("matches"),
    )
    return L.regex_counts(rules)


_CASE = "list_extract(['joined', 'validated', 'undecided', 'flagged', 'crosspage', 'mismatch'], CAST(doc_id % 6 AS INT) + 1)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*[F.lit(c) for c in L.CASES]), (F.col("doc_id") % 6).cast("int"))
    return fx.pages(spark, d).select("project_id", "doc_id", status.alias("status"), F.when(F.col("idx0") % 3 != 0, F.col("idx0") % 3 == 1).alias("validated"))


@query(oracle("SELECT project_id, COUNT(*) AS total, " + ", ".join(f"COUNT(*) FILTER (status = '{c}') AS {c}" for c in L.CASES) + f" , COUNT(*) FILTER (status IN ('joined', 'crosspage') AND idx0 % 3 <> 1) AS unvalidated FROM (SELECT *, {_CASE} AS status FROM fx_pages) GROUP BY project_id", "fx_pages"))
def hyphen_recount(spark: SparkSession, d: str) -> DataFrame:
    return L.hyphen_recount(_cases(spark, d))


@query(oracle(f"SELECT project_id, doc_id, {_CASE} AS status FROM fx_pages WHERE doc_id % 6 IN (2, 3)", "fx_pages"))
def hyphen_queue(spark: SparkSession, d: str) -> DataFrame:
    return L.hyphen_mode(_cases(spark, d), "queue").select("project_id", "doc_id", "status")


@query(oracle("SELECT project_id, COUNT(*) AS total, COUNT(*) FILTER (doc_id % 5 > 1) AS success, COUNT(*) FILTER (doc_id % 5 = 1) AS failed, COUNT(*) FILTER (doc_id % 5 = 0) AS skipped FROM fx_pages GROUP BY project_id", "fx_pages"))
def ocr_summary(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 5
    return L.ocr_summary(fx.pages(spark, d).withColumn("outcome", F.when(i == 0, "skipped").when(i == 1, "failed").otherwise("success")))


@query("SELECT l_returnflag AS project_id, ROUND(AVG(CASE WHEN l_orderkey % 9 <> 0 THEN l_partkey END), 6) AS chroma, ROUND(AVG(CASE WHEN l_orderkey % 9 <> 0 THEN l_suppkey END), 6) AS contrast FROM lineitem GROUP BY l_returnflag")
def signal_means(spark: SparkSession, d: str) -> DataFrame:
    there = F.col("l_orderkey") % 9 != 0
    signals = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("project_id"), F.when(there, F.col("l_partkey")).alias("chroma"), F.when(there, F.col("l_suppkey")).alias("contrast"))
    found = L.signal_means(signals, ["chroma", "contrast"])
    return found.select("project_id", F.round("chroma", 6).alias("chroma"), F.round("contrast", 6).alias("contrast"))


@query(oracle("SELECT project_id, idx0, CASE WHEN doc_id % 3 = 0 THEN 'kept/' || doc_id ELSE 'projects/' || project_id || '/ocr_text/' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 's' || doc_id || '_' END || 'p' || idx0 || 'a.txt' END AS text_key FROM fx_pages", "fx_pages"))
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    out = lambda suffix, key: F.struct(suffix.alias("split_suffix"), key.alias("ocr_text_key"))
    outputs = F.array(out(F.lit(None).cast("string"), F.lit("other")), out(F.lit("a"), F.when(i % 3 == 0, F.concat(F.lit("kept/"), i.cast("string"))).otherwise("")))
    stem = F.when(i % 4 != 0, F.concat(F.lit("s"), i.cast("string")))
    key = L.text_key(F.col("project_id"), outputs, F.lit("a"), stem, F.concat(F.lit("p"), F.col("idx0").cast("string")))
    return fx.pages(spark, d).select("project_id", "idx0", key.alias("text_key"))


@query(oracle("""SELECT project_id, idx0 AS scan, CAST(ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY CASE WHEN doc_id % 5 = 0 THEN CASE WHEN length(project_id) % 2 = 0 THEN COALESCE(t, 2147483647) - 0.5 ELSE COALESCE(t, 2147483647) + 0.5 END ELSE idx0 END, idx0) - 1 AS INT) AS position
FROM fx_pages LEFT JOIN (SELECT project_id, MAX(idx0) AS t FROM fx_pages WHERE idx0 = 7 AND doc_id % 5 <> 0 GROUP BY project_id) USING (project_id)""", "fx_pages"))
def moved_selection(spark: SparkSession, d: str) -> DataFrame:
    """One scan in five is moved before or after scan 7."""
    leaves = fx.pages(spark, d).select("project_id", F.col("idx0").alias("scan"), F.col("idx0").alias("position"), (F.col("doc_id") % 5 == 0).alias("selected"))
    moves = leaves.select("project_id").distinct().select("project_id", F.lit(7).alias("target"), (F.length("project_id") % 2 != 0).alias("after"))
    return N.move_selection(leaves, moves)
