"""Queries over read models of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.operators import listing as L
from quire.operators import numbering as N
from quire.operators import pagemodels as M
from quire.plans.numbering import _LAB, _ORD, _PRE, _V
from quire.registry import query
from quire.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    outputs = F.when(doc % 4 > 0, F.array(F.struct(F.when(doc % 4 == 1, "complete").otherwise("running").alias("status"), F.when(doc % 8 == 1, "broken").alias("error"))))
    return fx.pages(spark, d).select("*", F.when(doc % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("splits"), F.when(doc % 7 == 0, "error").otherwise("complete").alias("processing_status"), outputs.alias("outputs"))


_REVIEW = "(doc_id % 7 = 0 OR doc_id % 4 > 1 OR doc_id % 8 = 1)"


@query(oracle(f"SELECT project_id, idx0, total, CASE WHEN total > 5 THEN 5 END AS next FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY idx0) AS n, COUNT(*) OVER (PARTITION BY project_id) AS total FROM fx_pages WHERE page_type = 'normal' AND doc_id % 3 = 0 AND doc_id % 7 > 0 AND {_REVIEW}) WHERE n <= 5", "fx_pages"))
def filtered_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first five pages of each project that pass four filters, with their number."""
    found = M.filtered(_pages(spark, d), page_type="normal", has_splits=True, status="complete", review_needed=True)
    return L.page(found, ["project_id"], ["idx0"], 0, 5).select("project_id", "idx0", "total", F.col("next").cast("int").alias("next"))


@query(oracle("SELECT project_id, COUNT(*) AS page_count, COUNT(*) FILTER (page_type <> 'skip') AS proof_page_count, COUNT(*) FILTER (doc_id % 3 = 0) AS split_pages FROM fx_pages GROUP BY project_id", "fx_pages"))
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).withColumn("ignore", F.when(F.col("page_type") == "skip", True))
    split = M.split_sources(pages).groupBy("project_id").agg(F.count("*").alias("split_pages"))
    return M.page_counts(pages).join(split, "project_id", "left").withColumn("split_pages", F.coalesce("split_pages", F.lit(0)))


_NAMES = "SELECT project_id, scan AS idx0, prefix FROM p"
_STATES = "SELECT project_id, CASE WHEN idx0 % 3 = 0 THEN printf('%04d', idx0) ELSE coalesce(prefix, printf('%04d', idx0)) END AS page_id, CASE idx0 % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'dirty' ELSE 'clean' END AS status FROM n WHERE idx0 % 5 > 0"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return N.prefixes(fx.leaves(spark, d), fx.runs(spark, d))


@query(
    oracle(
        """SELECT n.project_id, coalesce(prefix, printf('%04d', idx0)) AS page_id, idx0 AS n, '/api/data/projects/' || n.project_id || '/pages/' || coalesce(prefix, printf('%04d', idx0)) || '/stages/crop/thumbnail' AS thumb_url,
CASE coalesce(a.status, b.status) WHEN 'failed' THEN 'error' WHEN 'dirty' THEN 'stale' ELSE '' END AS flags FROM n LEFT JOIN s a ON a.project_id = n.project_id AND a.page_id = coalesce(prefix, printf('%04d', idx0)) LEFT JOIN s b ON b.project_id = n.project_id AND b.page_id = printf('%04d', idx0)""",
        *_V, o=_ORD, p=_PRE, n=_NAMES, s=_STATES,
    )
)
def crop_page_rows(spark: SparkSession, d: str) -> DataFrame:
    """A stage's crop grid of pages as numbering names them; states are kept under the prefix of a page, or under its number."""
    pages = _named(spark, d).select("project_id", F.col("scan").alias("idx0"), "prefix", F.array(F.lit(1)).alias("source_crop_bbox"))
    number = F.format_string("%04d", "idx0")
    states = pages.where("idx0 % 5 > 0").select("project_id", F.when(F.col("idx0") % 3 == 0, number).otherwise(F.coalesce("prefix", number)).alias("page_id"), F.lit("crop").alias("stage"), F.when(F.col("idx0") % 4 == 0, "failed").when(F.col("idx0") % 4 == 1, "dirty").otherwise("clean").alias("status"))
    found = M.crop_rows(pages, states.unionByName(states.withColumn("stage", F.lit("ocr"))), "crop")
    return found.select("project_id", "page_id", "n", "thumb_url", F.array_join("flags", ",").alias("flags"))


_TYPES = [*M.EXTENSIONS, *M.PRIMARY, "unheard"]


@query("SELECT event_id, " + f"[{', '.join(repr(x) for x in [*(f'output.{v}' for v in M.EXTENSIONS.values()), *M.PRIMARY.values()])}, NULL][event_id % {len(_TYPES)} + 1] AS file, CASE WHEN event_id % {len(_TYPES)} = {len(_TYPES) - 1} THEN 'no extension for output type unheard' END AS error, CASE WHEN user_id % 3 = 0 THEN 'key must be under projects/p1/; got: projects/p12/x' END AS key_error FROM events")
def artifact_files(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % len(_TYPES) + 1).cast("int"))
    name, error = M.artifact_file(F.col("kind"))
    key = F.when(F.col("user_id") % 3 == 0, "projects/p12/x").when(F.col("user_id") % 3 == 1, "/projects/p1/x").otherwise("projects/p1/")
    return table(spark, d, "events").withColumn("kind", kind).select("event_id", name.alias("file"), error.alias("error"), M.key_error(F.lit("p1"), key).alias("key_error"))


@query("SELECT l_orderkey AS job_id, CAST(n - 1 AS INT) AS place, l_partkey AS item, l_suppkey AS result, NULL::VARCHAR AS error FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE l_orderkey % 5 > 0 UNION ALL SELECT l_orderkey, NULL, NULL, NULL, COUNT(*) || ' items, ' || (COUNT(*) - 1) || ' results' FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey")
def batch_item_results(spark: SparkSession, d: str) -> DataFrame:
    """Items of each job's batch with the results at their places; some batches are short of one."""
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"))
    whole = F.transform("a", lambda x: x["l_suppkey"])
    short = F.when(F.col("job_id") % 5 == 0, F.slice(whole, F.lit(1), F.size(whole) - 1)).otherwise(whole)
    return M.with_results(lists.select("job_id", F.transform("a", lambda x: x["l_partkey"]).alias("items")), lists.select("job_id", short.alias("results")))


_STEMS = "SELECT source AS project_id, doc_id AS pos, CASE WHEN doc_id % 13 = 0 THEN 'bad name ' || doc_id WHEN doc_id % 7 = 0 THEN 'Ad' || doc_id ELSE printf('p%06d', doc_id) END AS stem FROM documents"
_SAID = """SELECT project_id, pos, e, list_filter([CASE WHEN length(stem) > 8 THEN 'basename_too_long:''' || stem || ''' has ' || length(stem) || ' chars (max 8)' END, CASE WHEN NOT regexp_full_match(stem, '[A-Za-z0-9_-]+') THEN 'invalid_chars:''' || stem || ''' contains characters outside [A-Za-z0-9_-]' END,
CASE WHEN contains(lower(stem), 'ad') THEN 'ad_substring:''' || stem || ''' contains the substring ''ad'' (ad-blocker risk)' END], lambda x: x IS NOT NULL) AS m FROM s, range(2) r(e)"""


@query(
    oracle(
        """SELECT b.project_id, 'PGDP naming violations: ' || array_to_string(CASE WHEN sorted THEN b.m ELSE list_append(b.m, 'sort_order') END, '; ') AS message
FROM (SELECT project_id, flatten(list(m ORDER BY pos, e)) AS m FROM said GROUP BY project_id) b JOIN (SELECT project_id, bool_and(coalesce(before <= stem, TRUE)) AS sorted FROM (SELECT *, LAG(stem) OVER (PARTITION BY project_id ORDER BY pos) AS before FROM s) GROUP BY project_id) o ON o.project_id = b.project_id WHERE len(b.m) > 0 OR NOT sorted""",
        s=_STEMS, said=_SAID,
    )
)
def naming_blockers(spark: SparkSession, d: str) -> DataFrame:
    """What naming rules say of each project's files, in one message."""
    doc = F.col("doc_id")
    stem = F.when(doc % 13 == 0, F.concat(F.lit("bad name "), doc.cast("string"))).when(doc % 7 == 0, F.concat(F.lit("Ad"), doc.cast("string"))).otherwise(F.format_string("p%06d", doc))
    pages = table(spark, d, "documents").select(F.col("source").alias("project_id"), doc.alias("pos"), stem.alias("prefix"))
    return M.naming_blockers(pages).select("project_id", "message")


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of leaves in another order than their scans'."""
    labelled = _named(spark, d).withColumn("label", N.label())
    rows = labelled.withColumn("pos", F.when(F.col("scan") % 2 == 0, F.col("scan") + 1).otherwise(F.col("scan") - 1))
    return M.naming_manifest(rows, numeric=True)


_ROWS = "SELECT p.*, l.label, CASE WHEN p.scan % 2 = 0 THEN p.scan + 1 ELSE p.scan - 1 END AS pos FROM p JOIN l ON l.project_id = p.project_id AND l.scan = p.scan"
_EXPORT = "SELECT *, CASE WHEN prefix IS NOT NULL THEN lpad(CAST(COUNT(prefix) OVER (PARTITION BY project_id ORDER BY pos) - 1 AS VARCHAR), CASE WHEN COUNT(prefix) OVER (PARTITION BY project_id) > 999 THEN 4 ELSE 3 END, '0') END AS export_name FROM r"


@query(oracle("SELECT project_id, CAST(ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY pos) - 1 AS INT) AS place, printf('%04d', scan) AS page_id, scan AS idx0, page_type AS role, prefix, export_name FROM x", *_V, o=_ORD, l=_LAB, p=_PRE, r=_ROWS, x=_EXPORT))
def read_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Naming manifests written as JSON in a given order, read again and taken apart."""
    found = _manifests(spark, d)
    pages = M.parsed_manifests(found, found).select("project_id", F.posexplode("pages").alias("place", "e"))
    return pages.select("project_id", "place", "e.page_id", "e.idx0", "e.role", "e.prefix", "e.export_name")


@query(oracle("SELECT s.project_id, CASE WHEN s.project_id LIKE '%1' THEN 'not found' WHEN s.project_id LIKE '%2' THEN 'unreadable' WHEN s.project_id LIKE '%3' THEN 'version 1 is not supported' END AS error, CASE WHEN NOT regexp_matches(s.project_id, '[123]$') THEN coalesce(k, '') END AS skipped FROM (SELECT DISTINCT project_id FROM fx_pages) s LEFT JOIN (SELECT project_id, string_agg(printf('%04d', scan), ',' ORDER BY CASE WHEN scan % 2 = 0 THEN scan + 1 ELSE scan - 1 END) AS k FROM fx_leaves WHERE leaf_role = 'skip' GROUP BY project_id) k ON k.project_id = s.project_id", "fx_leaves"))
def manifest_errors(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of which some are missing, broken or of another version."""
    found, p = _manifests(spark, d), F.col("project_id")
    spoiled = found.where(~p.like("%1")).select("project_id", F.when(p.like("%2"), F.substring("manifest", 1, 40)).when(p.like("%3"), F.replace("manifest", F.lit('"version":2'), F.lit('"version":1'))).otherwise(F.col("manifest")).alias("manifest"))
    return M.parsed_manifests(spoiled, found).select("project_id", "error", F.array_join("skip_ids", ",").alias("skipped"))


@query(oracle("SELECT project_id, CAST(run_pos AS INT) AS run_pos, run_id, style, 'set' AS start_mode, 1 AS start, 1 AS step, 'text' AS role, lo, hi FROM fx_runs WHERE project_id NOT LIKE '%1' AND project_id NOT LIKE '%2'", "fx_runs"))
def read_runs(spark: SparkSession, d: str) -> DataFrame:
    """Numbering runs written as JSON, some as the bare list of old files, some cut off, and read again."""
    rows = fx.runs(spark, d).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("run_pos", F.struct(F.col("run_id").alias("id"), "style", F.array("lo", "hi").alias("span")).alias("r")))).alias("a"))
    runs, p = F.transform("a", lambda x: x["r"]), F.col("project_id")
    whole = F.to_json(F.struct(F.lit(1).alias("version"), runs.alias("runs")))
    text = F.when(p.like("%1"), F.to_json(runs)).when(p.like("%2"), F.substring(whole, 1, 30)).otherwise(whole)
    return M.parsed_runs(rows.select("project_id", text.alias("runs")), rows).select("project_id", "run_pos", "run_id", "style", "start_mode", "start", "step", "role", "lo", "hi")


_CONFIRMED = "SELECT 'proj' || CAST(user_id % 10 AS VARCHAR) AS project_id, CAST(event_id % 16 AS INT) AS stage, event_id AS seq, user_id AS actor_id, event_type <> 'error' AS confirmed FROM events"


@query(f"SELECT project_id, stage, actor_id, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, stage ORDER BY seq DESC) AS n FROM ({_CONFIRMED})) WHERE n = 1 AND confirmed")
def review_confirmations(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.page_stages(spark, d).select("project_id", F.col("stage_ord").alias("stage"), "seq").join(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor_id"), (F.col("event_type") != "error").alias("confirmed")), "seq")
    return M.confirmations(rows)


@query(oracle("SELECT s.project_id, CAST(s.page_no AS VARCHAR) AS page_id, s.status AS code, coalesce(a.reason, b.reason) AS reason FROM f s LEFT JOIN (SELECT project_id, page_no, arg_max('event ' || seq, seq) AS reason FROM fx_page_stages WHERE status = 'dirty' GROUP BY project_id, page_no) a ON a.project_id = s.project_id AND a.page_no = s.page_no AND s.status = 'failed' LEFT JOIN (SELECT project_id, arg_max('event ' || seq, seq) AS reason FROM fx_page_stages WHERE status = 'running' GROUP BY project_id) b ON b.project_id = s.project_id AND s.status = 'dirty'", "fx_state", f="SELECT project_id, page_no, stage_ord, status FROM fx_state WHERE status IN ('failed', 'dirty')"))
def waived_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Failed and dirty states as blockers, with waivers of single pages and of all pages taken from the log."""
    from quire.operators import stages

    log = fx.page_stages(spark, d)
    blockers = stages.latest(log, ["project_id", "page_no", "stage_ord"], "seq").where("status in ('failed', 'dirty')").select("project_id", F.col("page_no").cast("string").alias("page_id"), F.col("status").alias("code"))
    reason = F.concat(F.lit("event "), F.col("seq").cast("string"))
    own = log.where("status = 'dirty'").select("project_id", F.lit("failed").alias("code"), F.col("page_no").cast("string").alias("page_id"), "seq", reason.alias("reason"))
    general = log.where("status = 'running'").select("project_id", F.lit("dirty").alias("code"), F.lit(None).cast("string").alias("page_id"), "seq", reason.alias("reason"))
    return M.waived(blockers, own.unionByName(general))
