"""Stage state over the graph of stages: latest rows, cascades, gates, summaries.

``states``: project_id, page_no, stage, status, ... one row per key.  The graph has 24 nodes, so its closure is
worked out once and joined as a table of a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stage, scope, stages it depends on; in order.
STAGES = (
    ("source", "project", ()),
    ("grayscale", "page", ("source",)),
    ("crop", "page", ("grayscale",)),
    ("threshold", "page", ("crop",)),
    ("deskew", "page", ("threshold",)),
    ("denoise", "page", ("deskew",)),
    ("dewarp", "page", ("denoise",)),
    ("post_transform_crop", "page", ("dewarp",)),
    ("canvas_map", "page", ("post_transform_crop",)),
    ("text_zones", "page", ("post_transform_crop",)),
    ("post_ocr_crop", "page", ("canvas_map",)),
    ("ocr", "page", ("post_ocr_crop",)),
    ("wordcheck", "page", ("ocr",)),
    ("hyphen_join", "page", ("wordcheck",)),
    ("regex", "page", ("hyphen_join",)),
    ("text_review", "page", ("hyphen_join", "regex")),
    ("illustrations", "page", ("source",)),
    ("page_order", "project", ("source", "text_zones")),
    ("validation", "project", ("text_review", "illustrations", "page_order")),
    ("proof_pack", "project", ("validation",)),
    ("build_package", "project", ("proof_pack",)),
    ("zip", "project", ("build_package",)),
    ("submit_check", "project", ("zip",)),
    ("archive", "project", ("submit_check",)),
)
PAGE_STAGES = [s for s, scope, _ in STAGES if scope == "page"]
#: Worst first.
RANKS = {"failed": 5, "dirty": 4, "running": 3, "clean": 1}


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, scope) for k, (s, scope, _) in enumerate(STAGES)], "stage_ord int, stage string, scope string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, d) for s, _, needs in STAGES for d in needs], "stage string, depends_on string")


def descendants(of: Sequence[tuple[str, str, tuple[str, ...]]] = STAGES) -> dict[str, set[str]]:
    """By stage all that depend on it, directly or not."""
    below: dict[str, set[str]] = {s: set() for s, _, _ in of}
    for stage, _, needs in reversed(of):
        for need in needs:
            below[need] |= {stage} | below[stage]
    return below


def closure(spark: SparkSession, of: Sequence[tuple[str, str, tuple[str, ...]]] = STAGES) -> DataFrame:
    """(stage, descendant) for all stages that depend on a stage, directly or not."""
    below = descendants(of)
    return spark.createDataFrame([(s, d) for s, ds in below.items() for d in sorted(ds)], "stage string, descendant string")


def latest(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key: upserts of an append-only table.  A grouped maximum, so that it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return last.select(*key, "_row.*")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, keys.columns, "left_anti")


def init_rows(pages: DataFrame, states: DataFrame, stages: DataFrame) -> DataFrame:
    """Rows ``not-run`` for each page's stages that have no row yet; stages are a table of fixed size."""
    wanted = pages.select("project_id", "page_no").distinct().withColumn("stage_ord", F.explode(F.array(*[F.lit(r["stage_ord"]) for r in stages.collect()])))
    return wanted.join(states.select("project_id", "page_no", "stage_ord"), ["project_id", "page_no", "stage_ord"], "left_anti").withColumn("status", F.lit("not-run"))


def rank(status: Column) -> Column:
    out = F.lit(0)
    for name, n in RANKS.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def summary(states: DataFrame, stages: DataFrame) -> DataFrame:
    """By project and stage: the worst status of its pages, the number of stale ones; ``not-run`` where there is no row."""
    found = states.groupBy("project_id", "stage_ord").agg(
        F.max(F.struct(rank(F.col("status")), F.col("status"))).alias("worst"), F.count_if(F.col("status") == "dirty").alias("stale"), F.count("*").alias("pages")
    )
    projects = states.select("project_id").distinct().withColumn("stage_ord", F.explode(F.array(*[F.lit(r["stage_ord"]) for r in stages.collect()])))
    out = projects.join(found, ["project_id", "stage_ord"], "left")
    return out.select("project_id", "stage_ord", F.coalesce("worst.status", F.lit("not-run")).alias("status"), F.coalesce("stale", F.lit(0)).alias("stale"), F.coalesce("pages", F.lit(0)).alias("pages"))


def totals(states: DataFrame) -> DataFrame:
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    return states.groupBy("project_id", "stage_ord").agg(
        F.count("*").alias("total"), of("clean").alias("clean"), of("dirty").alias("flagged"), of("clean", "reviewed").alias("done"), of("reviewed").alias("reviewed"), of("failed").alias("errors"), of("running").alias("running")
    )


def row_state(status: Column) -> Column:
    return F.when(status == "dirty", "flagged").when(status.isin("failed", "running", "clean"), status).otherwise("clean")


def cascade(states: DataFrame, changed: DataFrame, below: DataFrame, hit: Sequence[str] = ("clean", "failed")) -> DataFrame:
    """States after stages in ``changed`` (project_id, page_no, stage) became stale: descendants in one of ``hit`` turn dirty."""
    stale = changed.join(F.broadcast(below), "stage").select("project_id", "page_no", F.col("descendant").alias("stage")).distinct().withColumn("_stale", F.lit(True))
    out = states.join(stale, ["project_id", "page_no", "stage"], "left")
    return out.withColumn("status", F.when(F.col("_stale") & F.col("status").isin(*hit), "dirty").otherwise(F.col("status"))).drop("_stale")


def split_cascade(states: DataFrame, changed: DataFrame, splits: DataFrame, hit: Sequence[str] = ("clean", "failed"), root: str = "grayscale") -> DataFrame:
    """States after stages in ``changed`` were run again on pages that others were split off.

    ``splits``: project_id, page_no, parent_no, split_stage.  A child whose split comes at or after the changed stage
    starts anew: its root stage and all below it turn dirty where they are in one of ``hit``.  Children without a
    row for the root stage stay as they are.
    """
    below = descendants()
    after = F.create_map(*[x for s, ds in below.items() for x in (F.lit(s), F.array(*[F.lit(d) for d in sorted({s} | ds)]))])
    parents = changed.select("project_id", F.col("page_no").alias("parent_no"), F.col("stage").alias("_stage"))
    children = splits.join(parents, ["project_id", "parent_no"]).where(F.array_contains(after[F.col("_stage")], F.col("split_stage"))).select("project_id", "page_no").distinct()
    rooted = children.join(states.where(F.col("stage") == root), ["project_id", "page_no"], "left_semi").withColumn("_stale", F.lit(True))
    again = F.col("_stale") & F.col("stage").isin(root, *sorted(below[root])) & F.col("status").isin(*hit)
    return states.join(rooted, ["project_id", "page_no"], "left").withColumn("status", F.when(again, "dirty").otherwise(F.col("status"))).drop("_stale")


def project_cascade(states: DataFrame, changed: DataFrame, below: DataFrame) -> DataFrame:
    """Project stages after those in ``changed`` (project_id, stage) were run again: all below turn dirty, whatever their status."""
    stale = changed.join(below, "stage").select("project_id", F.col("descendant").alias("stage")).distinct().withColumn("_stale", F.lit(True))
    out = states.join(stale, ["project_id", "stage"], "left")
    return out.withColumn("status", F.when(F.col("_stale"), "dirty").otherwise(F.col("status"))).drop("_stale")


def missing_dependencies(states: DataFrame, needs: DataFrame) -> DataFrame:
    """By page and stage, the page-scope dependencies that aren't clean, joined in order of name."""
    wanted = states.select("project_id", "page_no").distinct().join(F.broadcast(needs))
    clean = states.where("status = 'clean'").select("project_id", "page_no", F.col("stage").alias("depends_on"))
    missing = wanted.join(clean, ["project_id", "page_no", "depends_on"], "left_anti")
    return missing.groupBy("project_id", "page_no", "stage").agg(F.array_join(F.sort_array(F.collect_list("depends_on")), ",").alias("missing"))


def gate(project_states: DataFrame, needs: DataFrame) -> DataFrame:
    """By project and stage: whether all project-scope dependencies are clean, and the first that isn't."""
    wanted = project_states.select("project_id").distinct().join(F.broadcast(needs))
    state = project_states.select("project_id", F.col("stage").alias("depends_on"), "status")
    joined = wanted.join(state, ["project_id", "depends_on"], "left").withColumn("ok", F.coalesce(F.col("status") == "clean", F.lit(False)))
    return joined.groupBy("project_id", "stage").agg(F.bool_and("ok").alias("open"), F.min(F.when(~F.col("ok"), F.col("depends_on"))).alias("reason"))


def stale_versions(states: DataFrame, versions: DataFrame) -> DataFrame:
    """Clean rows of an older stage version turn dirty; ``versions``: stage_ord, current."""
    out = states.join(F.broadcast(versions), "stage_ord", "left")
    return out.withColumn("status", F.when((F.col("status") == "clean") & (F.col("version") < F.col("current")), "dirty").otherwise(F.col("status"))).drop("current")


def infer_project_stages(states: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Clean if an artifact is there, else not-run; dirty and failed rows stay."""
    out = states.join(artifacts.select("project_id", "stage_ord").distinct().withColumn("_there", F.lit(True)), ["project_id", "stage_ord"], "left")
    inferred = F.when(F.col("_there"), "clean").otherwise("not-run")
    return out.withColumn("status", F.when(F.col("status").isin("dirty", "failed"), F.col("status")).otherwise(inferred)).drop("_there")


def all_reviewed(pages: DataFrame, states: DataFrame, review_ord: int) -> DataFrame:
    """By project: whether every page that isn't ignored has a clean review."""
    clean = states.where((F.col("stage_ord") == review_ord) & (F.col("status") == "clean")).select("project_id", "page_no").distinct().withColumn("_clean", F.lit(True))
    return pages.join(clean, ["project_id", "page_no"], "left").groupBy("project_id").agg(F.bool_and(F.coalesce("_clean", F.lit(False))).alias("all_reviewed"))


def split_children(pages: DataFrame) -> DataFrame:
    """Children of split pages; ``splits``: array of (suffix, l, t, r, b).  Index and reading order from 1."""
    return pages.select("project_id", F.col("idx0").alias("parent_idx0"), F.posexplode("splits").alias("_k", "s")).select("project_id", "parent_idx0", (F.col("_k") + 1).alias("split_index"), "s.*")


def split_is_whole() -> Column:
    """Split fields are all there or none is."""
    n = sum(F.col(c).isNotNull().cast("int") for c in ("parent_idx0", "split_index", "split_stage"))
    return n.isin(0, 3)


def reset(states: DataFrame, chosen: Column, key: Sequence[str]) -> DataFrame:
    """Rows that are ``chosen`` as if they had never run: nothing but their key is kept."""
    cleared = {c: F.when(chosen, F.lit("not-run") if c == "status" else F.lit(None)).otherwise(F.col(c)) for c in states.columns if c not in key}
    return states.withColumns(cleared)


def rerun(states: DataFrame, chosen: Column) -> DataFrame:
    return states.withColumn("status", F.when(chosen, "dirty").otherwise(F.col("status")))


def purge(states: DataFrame, files: DataFrame, projects: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, files left, bytes and files that go, by project) after all artifacts of ``projects`` are deleted and their stages reset.

    ``files``: project_id, path, size; what lies under a project's pages' stages are its artifacts.
    """
    names = projects.select("project_id").distinct()
    artifact = F.col("path").rlike(r"/pages/[^/]+/stages/")
    marked = files.join(names.withColumn("_goes", F.lit(True)), "project_id", "left").withColumn("_goes", F.coalesce(F.col("_goes") & artifact, F.lit(False)))
    gone = marked.where("_goes").groupBy("project_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    after = reset(states.join(names.withColumn("_reset", F.lit(True)), "project_id", "left"), F.coalesce("_reset", F.lit(False)), [*key, "_reset"]).drop("_reset")
    return after.select(*states.columns), marked.where("not _goes").select(*files.columns), gone


def unsplit(pages: DataFrame, states: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and stage rows without the children of ``parents`` (project_id, parent_idx0); a parent and its rows stay as they are."""
    gone = pages.join(parents.distinct(), ["project_id", "parent_idx0"], "left_semi").select("project_id", "idx0")
    return pages.join(gone, ["project_id", "idx0"], "left_anti").select(*pages.columns), states.join(gone, ["project_id", "idx0"], "left_anti").select(*states.columns)
