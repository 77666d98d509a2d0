"""Drift between state rows and stored files, and the plan that heals it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["project_id", "page_no", "stage_ord"]


def drift(states: DataFrame, files: DataFrame, known_stages: int) -> DataFrame:
    """One row per finding: key and ``finding``.

    ``states``: key, status, input_hash; ``files``: key, path, content_hash.  A stage's first file by name is its
    output, further ones are extra.
    """
    grouped = files.groupBy(*KEY).agg(F.min_by("content_hash", "path").alias("content_hash"), F.count("*").alias("n_files"))
    both = states.select(*KEY, "status", "input_hash").join(grouped, KEY, "full_outer")
    there, clean = F.col("n_files").isNotNull(), F.col("status") == "clean"
    finding = (
        F.when(there & ~F.col("stage_ord").between(0, known_stages - 1), "unknown-stage")
        .when(there & F.col("status").isNull(), "no-row")
        .when(there & ~clean, "non-clean-row")
        .when(clean & ~there, "missing")
        .when(clean & (F.col("input_hash") != F.col("content_hash")), "hash-mismatch")
    )
    extra = F.when(F.col("n_files") > 1, "extra-file")
    return both.select(*KEY, F.explode(F.array_compact(F.array(finding, extra))).alias("finding"))


def drift_counts(findings: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("finding").isin(*names))
    pages = F.count_distinct(F.struct("project_id", "page_no"))
    return findings.groupBy("project_id").agg(
        pages.alias("pages"), n("extra-file", "unknown-stage", "no-row", "non-clean-row").alias("orphans"), n("missing").alias("missing"), n("hash-mismatch").alias("mismatches")
    )


def heal_plan(findings: DataFrame) -> DataFrame:
    """Missing output: failed; changed output: dirty; files without clean row: quarantine."""
    action = F.when(F.col("finding") == "missing", "set-failed").when(F.col("finding") == "hash-mismatch", "set-dirty").otherwise("quarantine")
    return findings.select(*KEY, "finding", action.alias("action"))


def heal_counts(plan: DataFrame) -> DataFrame:
    """By project, how many rows and files a heal changes, by action, and the findings that led to it."""
    n = lambda name: F.count_if(F.col("action") == name)
    return plan.groupBy("project_id").agg(F.count("*").alias("findings"), n("set-failed").alias("failed"), n("set-dirty").alias("dirtied"), n("quarantine").alias("quarantined"))


#: The folder of a project for files without a clean row.
QUARANTINE = ".orphan-stage-artifacts"


def quarantined(orphans: DataFrame, taken: DataFrame) -> DataFrame:
    """Where each orphan goes, and the line that the quarantine's manifest gets of it.

    ``orphans``: project_id, page_id, stage_id, reason, path; ``taken``: project_id, path of what lies in quarantine.  A
    name that is taken gets the first number that is free behind it.
    """
    root = F.concat(F.lit("projects/"), "project_id", F.lit("/"))
    inside = F.when(F.startswith("path", root), F.substr("path", F.length(root) + 1)).otherwise(F.col("path"))
    to = F.concat(root, F.lit(f"{QUARANTINE}/"), inside)
    # Numbers that a name has in quarantine already: 0 for the name itself.
    number = F.regexp_extract("path", r"\.(\d+)$", 1)
    both = taken.select("project_id", F.explode(F.array(F.struct(F.col("path").alias("to"), F.lit(0).alias("n")), F.struct(F.regexp_replace("path", r"\.\d+$", "").alias("to"), F.expr(r"try_cast(regexp_extract(path, '\\.(\\d+)$', 1) as int)").alias("n")))).alias("t")).where(F.col("t.n").isNotNull() & ((F.col("t.n") == 0) | (number != "")))
    held = both.groupBy("project_id", F.col("t.to").alias("to")).agg(F.sort_array(F.collect_set("t.n")).alias("held"))
    rows = orphans.withColumn("to", to).join(held, ["project_id", "to"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("held")), F.col("held")))
    place = F.when(free == 0, F.col("to")).otherwise(F.concat("to", F.lit("."), free.cast("string")))
    rows = rows.select("project_id", "page_id", "stage_id", "reason", F.col("path").alias("from"), place.alias("to"))
    return rows.withColumn("line", F.to_json(F.struct("project_id", "page_id", "stage_id", "reason", "from", "to")))
