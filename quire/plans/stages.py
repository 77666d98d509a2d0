"""Stage state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.operators import drift as drift_
from quire.operators import stages as S
from quire.registry import query

_NAMES = "[" + ", ".join(f"'{s}'" for s in S.PAGE_STAGES) + "]"
_CLOSURE = "SELECT stage, descendant FROM (VALUES " + ", ".join(f"('{s}', '{n}')" for s, _, needs in S.STAGES for n in needs) + ") e(descendant, stage) UNION SELECT c.stage, e.descendant FROM closure c JOIN (VALUES " + ", ".join(f"('{s}', '{n}')" for s, _, needs in S.STAGES for n in needs) + ") e(descendant, need) ON e.need = c.descendant"
_NAMED = f"SELECT project_id, page_no, list_extract({_NAMES}, stage_ord + 1) AS stage, status FROM fx_state"


def _state(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(fx.page_stages(spark, d), ["project_id", "page_no", "stage_ord"], "seq")


def _named(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in S.PAGE_STAGES])
    return _state(spark, d).select("project_id", "page_no", F.element_at(names, F.col("stage_ord") + 1).alias("stage"), "status")


def _page_stages(spark: SparkSession) -> DataFrame:
    return spark.range(len(S.PAGE_STAGES)).select(F.col("id").cast("int").alias("stage_ord"))


@query(oracle("SELECT project_id, page_no, stage_ord, status, seq FROM fx_state", "fx_state"))
def current_state(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("project_id", "page_no", "stage_ord", "status", "seq")


@query(
    oracle(
        """SELECT p.project_id, s.stage_ord, COALESCE(CASE MAX(CASE x.status WHEN 'failed' THEN 5 WHEN 'dirty' THEN 4 WHEN 'running' THEN 3 WHEN 'clean' THEN 1 END) WHEN 5 THEN 'failed' WHEN 4 THEN 'dirty' WHEN 3 THEN 'running' WHEN 1 THEN 'clean' END, 'not-run') AS status,
 CAST(COUNT(CASE WHEN x.status = 'dirty' THEN 1 END) AS BIGINT) AS stale, CAST(COUNT(x.status) AS BIGINT) AS pages
FROM (SELECT DISTINCT project_id FROM fx_state) p CROSS JOIN (SELECT CAST(UNNEST(range(16)) AS INT) AS stage_ord) s LEFT JOIN fx_state x ON x.project_id = p.project_id AND x.stage_ord = s.stage_ord GROUP BY p.project_id, s.stage_ord""",
        "fx_state",
    )
)
def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(_state(spark, d), _page_stages(spark))


@query(
    oracle(
        "SELECT project_id, stage_ord, CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(*) FILTER (status = 'clean') AS BIGINT) AS clean, CAST(COUNT(*) FILTER (status = 'dirty') AS BIGINT) AS flagged, CAST(COUNT(*) FILTER (status IN ('clean','reviewed')) AS BIGINT) AS done, CAST(COUNT(*) FILTER (status = 'reviewed') AS BIGINT) AS reviewed, CAST(COUNT(*) FILTER (status = 'failed') AS BIGINT) AS errors, CAST(COUNT(*) FILTER (status = 'running') AS BIGINT) AS running FROM fx_state GROUP BY project_id, stage_ord",
        "fx_state",
    )
)
def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.totals(_state(spark, d))


@query(oracle("SELECT project_id, page_no, stage_ord, CASE status WHEN 'dirty' THEN 'flagged' ELSE status END AS row_state FROM fx_state", "fx_state"))
def row_states(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("project_id", "page_no", "stage_ord", S.row_state(F.col("status")).alias("row_state"))


@query("WITH RECURSIVE closure(stage, descendant) AS (" + _CLOSURE + ") SELECT stage, descendant FROM closure")
def stage_descendants(spark: SparkSession, d: str) -> DataFrame:
    return S.closure(spark)


@query(
    oracle(
        "SELECT n.project_id, n.page_no, n.stage, CASE WHEN n.status IN ('clean','failed') AND EXISTS (SELECT 1 FROM n c JOIN closure x ON x.stage = c.stage WHERE c.status = 'dirty' AND c.project_id = n.project_id AND c.page_no = n.page_no AND x.descendant = n.stage) THEN 'dirty' ELSE n.status END AS status FROM n",
        "fx_state", recursive=True, n=_NAMED, closure=_CLOSURE,
    )
)
def dirty_cascade(spark: SparkSession, d: str) -> DataFrame:
    states = _named(spark, d)
    return S.cascade(states, states.where("status = 'dirty'").select("project_id", "page_no", "stage"), S.closure(spark))


@query(
    oracle(
        "SELECT n.project_id, n.page_no, n.stage, CASE WHEN n.status = 'clean' AND EXISTS (SELECT 1 FROM n c JOIN closure x ON x.stage = c.stage WHERE c.status = 'failed' AND c.project_id = n.project_id AND c.page_no = n.page_no AND x.descendant = n.stage) THEN 'dirty' ELSE n.status END AS status FROM n",
        "fx_state", recursive=True, n=_NAMED, closure=_CLOSURE,
    )
)
def heal_cascade(spark: SparkSession, d: str) -> DataFrame:
    states = _named(spark, d)
    return S.cascade(states, states.where("status = 'failed'").select("project_id", "page_no", "stage"), S.closure(spark), hit=("clean",))


_SPLIT = "CASE page_no % 3 WHEN 0 THEN 'crop' WHEN 1 THEN 'ocr' ELSE 'denoise' END"
_CHILDREN = f"SELECT DISTINCT s.project_id, s.page_no FROM (SELECT DISTINCT project_id, page_no, page_no - 1 AS parent_no, {_SPLIT} AS split_stage FROM n WHERE page_no % 5 = 2) s JOIN n c ON c.project_id = s.project_id AND c.page_no = s.parent_no AND c.status = 'dirty' JOIN (SELECT stage, descendant FROM closure UNION SELECT stage, stage FROM n) x ON x.stage = c.stage AND x.descendant = s.split_stage JOIN n r ON r.project_id = s.project_id AND r.page_no = s.page_no AND r.stage = 'grayscale'"


@query(
    oracle(
        "SELECT n.project_id, n.page_no, n.stage, CASE WHEN h.page_no IS NOT NULL AND n.status IN ('clean','failed') AND (n.stage = 'grayscale' OR n.stage IN (SELECT descendant FROM closure WHERE stage = 'grayscale')) THEN 'dirty' ELSE n.status END AS status FROM n LEFT JOIN h ON h.project_id = n.project_id AND h.page_no = n.page_no",
        "fx_state", recursive=True, n=_NAMED, closure=_CLOSURE, h=_CHILDREN,
    )
)
def split_cascade(spark: SparkSession, d: str) -> DataFrame:
    states = _named(spark, d)
    no = F.col("page_no")
    stage = F.when(no % 3 == 0, "crop").when(no % 3 == 1, "ocr").otherwise("denoise")
    splits = states.where("page_no % 5 = 2").select("project_id", "page_no", (no - 1).alias("parent_no"), stage.alias("split_stage")).distinct()
    return S.split_cascade(states, states.where("status = 'dirty'"), splits)


_NEEDS = "(VALUES " + ", ".join(f"('{s}', '{n}')" for s, scope, needs in S.STAGES if scope == "page" for n in needs if n in S.PAGE_STAGES) + ") e(stage, depends_on)"


@query(
    oracle(
        f"SELECT p.project_id, p.page_no, e.stage, string_agg(e.depends_on, ',' ORDER BY e.depends_on) AS missing FROM (SELECT DISTINCT project_id, page_no FROM fx_state) p CROSS JOIN {_NEEDS} LEFT JOIN n ON n.project_id = p.project_id AND n.page_no = p.page_no AND n.stage = e.depends_on AND n.status = 'clean' WHERE n.status IS NULL GROUP BY p.project_id, p.page_no, e.stage",
        "fx_state", n=_NAMED,
    )
)
def missing_dependencies(spark: SparkSession, d: str) -> DataFrame:
    needs = S.edges(spark).where(F.col("stage").isin(S.PAGE_STAGES) & F.col("depends_on").isin(S.PAGE_STAGES))
    return S.missing_dependencies(_named(spark, d), needs)


_PROJECT = "SELECT project_id, CASE page_no WHEN 0 THEN 'page_order' WHEN 1 THEN 'validation' WHEN 2 THEN 'proof_pack' WHEN 3 THEN 'build_package' WHEN 4 THEN 'zip' WHEN 5 THEN 'submit_check' ELSE 'archive' END AS stage, status FROM fx_state WHERE stage_ord = 0 AND page_no <= 6"
_PNEEDS = "(VALUES " + ", ".join(f"('{s}', '{n}')" for s, scope, needs in S.STAGES if scope == "project" for n in needs if n not in S.PAGE_STAGES and n != "source") + ") e(stage, depends_on)"


def _project_states(spark: SparkSession, d: str) -> DataFrame:
    names = ["page_order", "validation", "proof_pack", "build_package", "zip", "submit_check", "archive"]
    rows = _state(spark, d).where("stage_ord = 0 and page_no <= 6")
    return rows.select("project_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("page_no") + 1).alias("stage"), "status")


@query(
    oracle(
        f"SELECT p.project_id, e.stage, BOOL_AND(COALESCE(s.status = 'clean', FALSE)) AS \"open\", MIN(CASE WHEN NOT COALESCE(s.status = 'clean', FALSE) THEN e.depends_on END) AS reason FROM (SELECT DISTINCT project_id FROM ps) p CROSS JOIN {_PNEEDS} LEFT JOIN ps s ON s.project_id = p.project_id AND s.stage = e.depends_on GROUP BY p.project_id, e.stage",
        "fx_state", ps=_PROJECT,
    )
)
def stage_gates(spark: SparkSession, d: str) -> DataFrame:
    needs = S.edges(spark).where(~F.col("stage").isin(S.PAGE_STAGES) & ~F.col("depends_on").isin([*S.PAGE_STAGES, "source"]))
    return S.gate(_project_states(spark, d), needs)


@query(
    oracle(
        "SELECT p.project_id, p.stage, CASE WHEN EXISTS (SELECT 1 FROM ps c JOIN closure x ON x.stage = c.stage WHERE c.status = 'failed' AND c.project_id = p.project_id AND x.descendant = p.stage) THEN 'dirty' ELSE p.status END AS status FROM ps p",
        "fx_state", recursive=True, ps=_PROJECT, closure=_CLOSURE,
    )
)
def project_cascade(spark: SparkSession, d: str) -> DataFrame:
    states = _project_states(spark, d)
    return S.project_cascade(states, states.where("status = 'failed'").select("project_id", "stage"), S.closure(spark))


@query(oracle("SELECT project_id, page_no, stage_ord, CASE WHEN status = 'clean' AND seq % 3 < CASE WHEN stage_ord % 2 = 0 THEN 2 ELSE 1 END THEN 'dirty' ELSE status END AS status FROM fx_state", "fx_state"))
def stale_versions(spark: SparkSession, d: str) -> DataFrame:
    versions = _page_stages(spark).withColumn("current", F.when(F.col("stage_ord") % 2 == 0, 2).otherwise(1))
    return S.stale_versions(_state(spark, d).withColumn("version", F.col("seq") % 3), versions).select("project_id", "page_no", "stage_ord", "status")


@query(
    oracle(
        "SELECT p.project_id, p.page_no, CAST(s.o AS INT) AS stage_ord, 'not-run' AS status FROM (SELECT DISTINCT project_id, page_no FROM fx_page_stages) p CROSS JOIN (SELECT UNNEST(range(16)) AS o) s WHERE NOT EXISTS (SELECT 1 FROM fx_state x WHERE x.project_id = p.project_id AND x.page_no = p.page_no AND x.stage_ord = s.o)",
        "fx_state",
    )
)
def initial_rows(spark: SparkSession, d: str) -> DataFrame:
    states = _state(spark, d)
    return S.init_rows(states, states, _page_stages(spark))


@query(oracle("SELECT project_id, page_no, stage_ord, status, seq FROM fx_state WHERE NOT (page_no % 5 = 0) UNION ALL SELECT project_id, page_no, stage_ord, 'dirty', -1 FROM fx_state WHERE page_no % 5 = 0", "fx_state"))
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    states = _state(spark, d).select("project_id", "page_no", "stage_ord", "status", "seq")
    new = states.where("page_no % 5 = 0").withColumn("status", F.lit("dirty")).withColumn("seq", F.lit(-1).cast("bigint"))
    return S.upsert(states, new, ["project_id", "page_no", "stage_ord"])


@query(oracle("SELECT project_id, page_no, stage_ord, status FROM fx_state WHERE page_no % 4 <> 1", "fx_state"))
def deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    states = _state(spark, d).select("project_id", "page_no", "stage_ord", "status")
    return S.delete_keys(states, states.where("page_no % 4 = 1").select("project_id", "page_no").distinct())


@query(oracle("SELECT project_id, page_no, stage_ord, CASE WHEN status IN ('dirty','failed') THEN status WHEN seq % 2 = 0 THEN 'clean' ELSE 'not-run' END AS status FROM (SELECT project_id, page_no, stage_ord, status, MAX(CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY project_id, page_no, stage_ord) AS seq FROM fx_state WHERE page_no = 0)", "fx_state"))
def inferred_stages(spark: SparkSession, d: str) -> DataFrame:
    states = _state(spark, d).where("page_no = 0")
    return S.infer_project_stages(states, states.where("seq % 2 = 0").select("project_id", "stage_ord")).select("project_id", "page_no", "stage_ord", "status")


@query(oracle("SELECT p.project_id, BOOL_AND(x.status IS NOT NULL) AS all_reviewed FROM (SELECT DISTINCT project_id, page_no FROM fx_state WHERE page_no % 10 <> 3) p LEFT JOIN fx_state x ON x.project_id = p.project_id AND x.page_no = p.page_no AND x.stage_ord = 15 AND x.status = 'clean' GROUP BY p.project_id", "fx_state"))
def all_pages_reviewed(spark: SparkSession, d: str) -> DataFrame:
    states = _state(spark, d)
    return S.all_reviewed(states.where("page_no % 10 <> 3").select("project_id", "page_no").distinct(), states, 15)


@query(oracle("SELECT project_id, page_no, stage_ord, CASE WHEN stage_ord >= 3 AND page_no % 2 = 0 THEN 'dirty' ELSE status END AS status FROM fx_state", "fx_state"))
def rerun_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages from the fourth on are set dirty for a rerun of the even pages."""
    again = (F.col("stage_ord") >= 3) & (F.col("page_no") % 2 == 0)
    return _state(spark, d).select("project_id", "page_no", "stage_ord", F.when(again, "dirty").otherwise(F.col("status")).alias("status"))


_FILES = "SELECT project_id, page_no, stage_ord, CASE WHEN seq % 11 = 0 THEN 'h-changed' ELSE 'h' || CAST(seq AS VARCHAR) END AS content_hash, 'output.a' AS path FROM fx_state WHERE (status = 'clean' AND seq % 7 <> 0) OR (status = 'failed' AND seq % 5 = 0) UNION ALL SELECT project_id, page_no, stage_ord, 'x', 'output.b' FROM fx_state WHERE status = 'clean' AND seq % 13 = 1"
_DRIFT = """SELECT COALESCE(s.project_id, f.project_id) AS project_id, COALESCE(s.page_no, f.page_no) AS page_no, COALESCE(s.stage_ord, f.stage_ord) AS stage_ord, s.status, s.h, f.content_hash, f.n
FROM (SELECT project_id, page_no, stage_ord, status, 'h' || CAST(seq AS VARCHAR) AS h FROM fx_state WHERE seq % 17 <> 0) s FULL JOIN (SELECT project_id, page_no, stage_ord, arg_min(content_hash, path) AS content_hash, COUNT(*) AS n FROM files GROUP BY ALL) f
ON s.project_id = f.project_id AND s.page_no = f.page_no AND s.stage_ord = f.stage_ord"""
_FOUND = """SELECT project_id, page_no, stage_ord, CASE WHEN n IS NOT NULL AND stage_ord > 14 THEN 'unknown-stage' WHEN n IS NOT NULL AND status IS NULL THEN 'no-row' WHEN n IS NOT NULL AND status <> 'clean' THEN 'non-clean-row' WHEN status = 'clean' AND n IS NULL THEN 'missing' WHEN status = 'clean' AND h <> content_hash THEN 'hash-mismatch' END AS finding FROM j
UNION ALL SELECT project_id, page_no, stage_ord, 'extra-file' FROM j WHERE n > 1"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    states = _state(spark, d).select("project_id", "page_no", "stage_ord", "status", "seq")
    seq = F.col("seq")
    files = states.where("(status = 'clean' and seq % 7 <> 0) or (status = 'failed' and seq % 5 = 0)").select(
        "project_id", "page_no", "stage_ord", F.when(seq % 11 == 0, "h-changed").otherwise(F.concat(F.lit("h"), seq.cast("string"))).alias("content_hash"), F.lit("output.a").alias("path")
    )
    extra = states.where("status = 'clean' and seq % 13 = 1").select("project_id", "page_no", "stage_ord", F.lit("x").alias("content_hash"), F.lit("output.b").alias("path"))
    rows = states.where("seq % 17 <> 0").withColumn("input_hash", F.concat(F.lit("h"), seq.cast("string")))
    return drift_.drift(rows, files.union(extra), 15)


@query(oracle("SELECT * FROM f WHERE finding IS NOT NULL", "fx_state", files=_FILES, j=_DRIFT, f=_FOUND))
def file_drift(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)


@query(oracle("SELECT project_id, CAST(COUNT(DISTINCT page_no) AS BIGINT) AS pages, CAST(COUNT(*) FILTER (finding IN ('extra-file','unknown-stage','no-row','non-clean-row')) AS BIGINT) AS orphans, CAST(COUNT(*) FILTER (finding = 'missing') AS BIGINT) AS missing, CAST(COUNT(*) FILTER (finding = 'hash-mismatch') AS BIGINT) AS mismatches FROM f WHERE finding IS NOT NULL GROUP BY project_id", "fx_state", files=_FILES, j=_DRIFT, f=_FOUND))
def drift_counts(spark: SparkSession, d: str) -> DataFrame:
    return drift_.drift_counts(_findings(spark, d))


@query(oracle("SELECT *, CASE finding WHEN 'missing' THEN 'set-failed' WHEN 'hash-mismatch' THEN 'set-dirty' ELSE 'quarantine' END AS action FROM f WHERE finding IS NOT NULL", "fx_state", files=_FILES, j=_DRIFT, f=_FOUND))
def heal_plan(spark: SparkSession, d: str) -> DataFrame:
    return drift_.heal_plan(_findings(spark, d))


@query("SELECT user_id, CAST(COUNT(*) FILTER (event_type <> 'error') AS BIGINT) AS ok, CAST(COUNT(*) FILTER (event_type = 'error') AS BIGINT) AS errors, arg_min(props, event_id) FILTER (event_type = 'error') AS first_error, CASE WHEN COUNT(*) FILTER (event_type = 'error') > 0 AND COUNT(*) FILTER (event_type <> 'error') = 0 THEN 'error' ELSE 'done' END AS status FROM events GROUP BY user_id")
def job_rollup(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.listing import job_rollup as rollup
    from quire.tables import table

    results = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("pos"), (F.col("event_type") != "error").alias("ok"), F.col("props").alias("error"))
    return rollup(results).withColumnRenamed("job_id", "user_id")


@query(oracle("SELECT project_id, page_no, stage_ord, CASE WHEN stage_ord >= 12 THEN 'not-run' WHEN page_no % 2 = 0 THEN 'dirty' ELSE status END AS status, CASE WHEN stage_ord < 12 THEN seq END AS seq FROM fx_state", "fx_state"))
def stage_resets(spark: SparkSession, d: str) -> DataFrame:
    """The last stages as if they had never run, the others of even pages to run again."""
    states = _state(spark, d).select("project_id", "page_no", "stage_ord", "status", "seq")
    return S.reset(S.rerun(states, F.col("page_no") % 2 == 0), F.col("stage_ord") >= 12, ["project_id", "page_no", "stage_ord"])


@query(oracle("SELECT project_id, COUNT(*) AS files, CAST(SUM(seq % 1000) AS BIGINT) AS bytes FROM fx_state WHERE status = 'clean' AND project_id <> 'proj3' AND stage_ord <> 5 GROUP BY project_id", "fx_state"))
def purged_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes that a purge of all projects but one gives back; the sources beside the stages stay."""
    states = _state(spark, d).select("project_id", "page_no", "stage_ord", "status", "seq")
    folder = F.when(F.col("stage_ord") == 5, "source").otherwise(F.concat(F.lit("pages/"), F.col("page_no").cast("string"), F.lit("/stages")))
    files = states.where("status = 'clean'").select("project_id", F.concat_ws("/", F.lit("/projects"), "project_id", folder, F.col("stage_ord").cast("string"), F.lit("output.png")).alias("path"), (F.col("seq") % 1000).alias("size"))
    return S.purge(states, files, states.where("project_id <> 'proj3'"), ["project_id", "page_no", "stage_ord"])[2]


@query(oracle("SELECT project_id, CAST(COUNT(*) FILTER (finding IS NOT NULL) AS BIGINT) AS findings, CAST(COUNT(*) FILTER (finding = 'missing') AS BIGINT) AS failed, CAST(COUNT(*) FILTER (finding = 'hash-mismatch') AS BIGINT) AS dirtied, CAST(COUNT(*) FILTER (finding NOT IN ('missing', 'hash-mismatch')) AS BIGINT) AS quarantined FROM f GROUP BY project_id HAVING COUNT(finding) > 0", "fx_state", files=_FILES, j=_DRIFT, f=_FOUND))
def heal_counts(spark: SparkSession, d: str) -> DataFrame:
    return drift_.heal_counts(drift_.heal_plan(_findings(spark, d)))


@query(
    oracle(
        """SELECT project_id, page_no, stage_ord, finding, 'projects/' || project_id || '/.orphan-stage-artifacts/pages/' || page_no || '/stages/' || stage_ord || '/output.a' || CASE WHEN page_no % 3 = 0 AND stage_ord % 2 = 0 THEN '.2' WHEN page_no % 3 = 0 THEN '.1' ELSE '' END AS moved_to
FROM f WHERE finding IN ('non-clean-row', 'unknown-stage', 'no-row')""",
        "fx_state", files=_FILES, j=_DRIFT, f=_FOUND,
    )
)
def quarantine_entries(spark: SparkSession, d: str) -> DataFrame:
    """Where files without a clean row go; some names are taken there, some with one number too."""
    found = _findings(spark, d).where("finding in ('non-clean-row', 'unknown-stage', 'no-row')")
    place = F.concat(F.lit("pages/"), F.col("page_no").cast("string"), F.lit("/stages/"), F.col("stage_ord").cast("string"), F.lit("/output.a"))
    root = F.concat(F.lit("projects/"), "project_id", F.lit("/"))
    orphans = found.select("project_id", F.col("page_no").cast("string").alias("page_id"), F.col("stage_ord").cast("string").alias("stage_id"), F.col("finding").alias("reason"), F.concat(root, place).alias("path"))
    there = found.where("page_no % 3 = 0").select("project_id", F.concat(root, F.lit(f"{drift_.QUARANTINE}/"), place).alias("path"), "stage_ord")
    taken = there.select("project_id", "path").union(there.where("stage_ord % 2 = 0").select("project_id", F.concat("path", F.lit(".1"))))
    moved = drift_.quarantined(orphans, taken)
    return moved.select("project_id", F.col("page_id").cast("int").alias("page_no"), F.col("stage_id").cast("int").alias("stage_ord"), F.col("reason").alias("finding"), F.get_json_object("line", "$.to").alias("moved_to"))
