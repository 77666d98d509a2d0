"""Filters, paging and read models of lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def needs_review(error: Column, outputs: Column) -> Column:
    """An error, or outputs of which one isn't complete or has an error of its own; no outputs need none."""
    return error.isNotNull() | F.exists(outputs, lambda o: (o["status"] != "complete") | o["error"].isNotNull())


def page(rows: DataFrame, by: Sequence[str], order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit-1 of each group with the group's ``total`` and the ``next`` offset, null at the end."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = rows.withColumn("_n", n).withColumn("total", F.count("*").over(Window.partitionBy(*by)))
    out = out.where(F.col("_n").between(offset + 1, offset + limit)).drop("_n")
    return out.withColumn("next", F.when(F.col("total") > offset + limit, offset + limit))


def oldest_reversed(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows, last one first."""
    return rows.orderBy(order).limit(n).orderBy(F.desc(order))


def blank_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_type").isin("blank", "plate_b", "plate_r"))


def skips_ocr_crop(pages: DataFrame) -> DataFrame:
    """Pages that aren't cropped for OCR; page_type, alignment, rotated, single_dim, n_splits."""
    return pages.where(F.col("page_type").isin("blank", "plate_p", "plate_b", "plate_r") | F.col("alignment").isin("center", "bottom") | F.col("rotated") | F.col("single_dim") | (F.col("n_splits") > 0))


def patch(rows: DataFrame, changes: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows with the fields that a change names; ``changes``: key, then field and has_field for each.  A named null is written."""
    renamed = changes.select(*key, *[F.col(f).alias(f"_{f}") for f in fields], *[f"has_{f}" for f in fields])
    out = rows.join(renamed, list(key), "left")
    return out.select(*[F.when(F.col(f"has_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def job_rollup(results: DataFrame) -> DataFrame:
    """By job: results that are ok, errors, the first error, and error as status only if nothing was ok."""
    found = results.groupBy("job_id").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errors"), F.min_by("error", F.when(~F.col("ok"), F.col("pos"))).alias("first_error"))
    return found.withColumn("status", F.when((F.col("errors") > 0) & (F.col("ok") == 0), "error").otherwise("done"))


def regex_match_counts(texts: DataFrame, pattern: str, by: str = "project_id") -> DataFrame:
    """Non-overlapping matches over the first text there is of each page."""
    first = F.coalesce("regex_text", "review_text", "ocr_text", F.lit(""))
    return texts.groupBy(by).agg(F.sum(F.regexp_count(first, F.lit(pattern))).cast("bigint").alias("matches"))


def median_ratio(sizes: DataFrame, default: float = 1.65) -> DataFrame:
    """Median of height by width, of images that have both."""
    ratio = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("height") / F.col("width"))
    return sizes.groupBy("project_id").agg(F.coalesce(F.median(ratio), F.lit(default)).alias("ratio"))


def batch_order(jobs: DataFrame) -> DataFrame:
    """Order in which a collected batch is drained: by priority, then arrival."""
    return jobs.withColumn("position", F.row_number().over(Window.partitionBy("batch").orderBy("priority", "seq")))


def children(pages: DataFrame) -> DataFrame:
    """Pages that were split off another one (``parent_idx0``), by parent in their order."""
    order = Window.partitionBy("project_id", "parent_idx0").orderBy("idx0")
    return pages.where("parent_idx0 is not null").select("project_id", "parent_idx0", F.col("idx0").alias("child_idx0"), F.row_number().over(order).alias("position"))


def newest(rows: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each owner in ``order``, with their ``position``."""
    found = rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return found.where(F.col("position") <= n)


def next_marked(pages: DataFrame, marked: Column) -> DataFrame:
    """Adds ``next_flagged``: the next ``idx0`` of the project with a mark, the page itself not counted.

    Read from the end, so that each page adds itself to what is known of those behind it; a frame that ends with
    the project is summed up anew for every page.
    """
    behind = Window.partitionBy("project_id").orderBy(F.desc("idx0")).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("next_flagged", F.min(F.when(marked, F.col("idx0"))).over(behind))


def zone_rows(pages: DataFrame, states: DataFrame) -> DataFrame:
    """Each page's zone state, and its number of zones where they are found; ``states``: key, status, zones (JSON).

    The artifact is an object with ``zones``; the bare list of older ones counts too.
    """
    out = pages.join(states, ["project_id", "idx0"], "left")
    status = F.col("status")
    state = F.when(status == "clean", "reviewed").when(status == "dirty", "flagged").when(status.isin("running", "failed"), status).otherwise("clean")
    found = F.coalesce(F.from_json("zones", "struct<zones:array<string>>")["zones"], F.from_json("zones", "array<string>"))
    zones = F.when((status == "clean") & found.isNotNull(), F.size(found))
    return out.select("project_id", "idx0", state.alias("state"), zones.alias("zones"))


def zone_totals(rows: DataFrame) -> DataFrame:
    """By project: pages by zone state; reviewed ones and those that never ran are done."""
    of = lambda *names: F.count_if(F.col("state").isin(*names))
    return rows.groupBy("project_id").agg(
        F.count("*").alias("total"), of("clean").alias("clean"), of("flagged").alias("flagged"), of("reviewed").alias("reviewed"), of("reviewed", "clean").alias("done"), of("split").alias("splits")
    )


def regex_counts(rules: DataFrame) -> DataFrame:
    """By project: rules, enabled ones by status, and matches of all; a rule is enabled unless it says no, matches that are no number count 0."""
    enabled = F.coalesce("enabled", F.lit(True))
    of = lambda name: F.count_if(enabled & (F.col("status") == name)).alias(name)
    matches = F.sum(F.coalesce(F.expr("cast(try_cast(matches as double) as bigint)"), F.lit(0))).cast("bigint")
    return rules.groupBy("project_id").agg(F.count("*").alias("rules"), of("applied"), of("review"), of("pending"), matches.alias("matches"))


#: Statuses of a hyphen case that are counted.
CASES = ("joined", "validated", "undecided", "flagged", "crosspage", "mismatch")
#: Statuses that each list of hyphen cases shows.
MODES = {"queue": ("undecided", "flagged"), "joined": ("joined", "crosspage"), "mismatch": ("mismatch",)}


def hyphen_recount(cases: DataFrame) -> DataFrame:
    """By project: cases by status, and joined ones that nobody validated."""
    status = F.col("status")
    open_ = status.isin(*MODES["joined"]) & ~F.coalesce("validated", F.lit(False))
    return cases.groupBy("project_id").agg(F.count("*").alias("total"), *[F.count_if(status == c).alias(c) for c in CASES], F.count_if(open_).alias("unvalidated"))


def hyphen_mode(cases: DataFrame, mode: str) -> DataFrame:
    return cases.where(F.col("status").isin(*MODES[mode]))


def ocr_summary(results: DataFrame) -> DataFrame:
    """By project: pages sent to OCR, and how many went well, failed or were skipped."""
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return results.groupBy("project_id").agg(F.count("*").alias("total"), of("success"), of("failed"), of("skipped"))


def signal_means(signals: DataFrame, names: Sequence[str]) -> DataFrame:
    """By project the mean of each image signal; images that couldn't be read have nulls and don't count."""
    return signals.groupBy("project_id").agg(*[F.avg(n).alias(n) for n in names])


def text_key(project_id: Column, outputs: Column, suffix: Column, source_stem: Column, prefix: Column) -> Column:
    """The recorded key of a page's text for a split suffix, else the one made of its stem, prefix and suffix."""
    recorded = F.get(F.filter(outputs, lambda o: (F.coalesce(o["split_suffix"], F.lit("")) == suffix) & (F.coalesce(o["ocr_text_key"], F.lit("")) != "")), F.lit(0))["ocr_text_key"]
    stem = F.when(F.coalesce(source_stem, F.lit("")) != "", F.concat(source_stem, F.lit("_"))).otherwise("")
    return F.coalesce(recorded, F.concat(F.lit("projects/"), project_id, F.lit("/ocr_text/"), stem, prefix, suffix, F.lit(".txt")))
