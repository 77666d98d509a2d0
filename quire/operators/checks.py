"""Validation of projects and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import name_errors


def review_blockers(pages: DataFrame, texts: DataFrame, attestations: DataFrame) -> DataFrame:
    """Pages without reviewed text, or whose attestation isn't clean."""
    out = pages.join(texts.select("project_id", "idx0").withColumn("_text", F.lit(True)), ["project_id", "idx0"], "left").join(attestations, ["project_id", "idx0"], "left")
    status = F.get_json_object("attestation", "$.status")
    code = F.when(F.col("_text").isNull(), "missing_text_review").when(F.coalesce(status, F.lit("")) != "clean", "unattested_text_review")
    return out.select("project_id", "idx0", code.alias("blocker")).where("blocker is not null")


def report(pages: DataFrame, blockers: DataFrame) -> DataFrame:
    n = blockers.groupBy("project_id").agg(F.count("*").alias("blockers"))
    out = pages.select("project_id").distinct().join(n, "project_id", "left")
    return out.select("project_id", F.coalesce("blockers", F.lit(0)).alias("blockers"), F.lit(0).cast("bigint").alias("warnings"), F.col("blockers").isNull().alias("passed"))


def submit_errors(size: Column, pages: Column) -> Column:
    return F.array_compact(F.array(F.when(size == 0, "empty_zip"), F.when(pages == 0, "no_pages")))


def package_errors(files: DataFrame) -> DataFrame:
    """Findings of a package: naming rules of each file, unpaired files, order.  ``files``: project_id, pos, name.

    The manifest and names without extension are passed over, illustrations need no naming rule and no pair.
    """
    plain = F.translate(F.col("name"), "\\", "/")
    last = F.regexp_extract(plain, r"[^/]*$", 0)
    parts = files.where((F.col("name") != "pgdp.json") & F.contains(last, F.lit("."))).where(~plain.startswith("images/"))
    parts = parts.select("project_id", "pos", F.regexp_replace(last, r"(?s)\.[^.]*$", "").alias("stem"), F.regexp_extract(last, r"(?s)\.[^.]*$", 0).alias("ext"))
    named = parts.select("project_id", F.explode(name_errors(F.col("stem"), F.col("ext"))).alias("code"), F.col("stem").alias("subject"))
    kind = F.lower("ext")
    pairs = parts.where(kind.isin(".png", ".txt")).groupBy("project_id", "stem").agg(F.bool_or(kind == ".png").alias("png"), F.bool_or(kind == ".txt").alias("txt"))
    unpaired = pairs.where("png <> txt").select("project_id", F.when(F.col("png"), "missing_txt").otherwise("missing_png").alias("code"), F.col("stem").alias("subject"))
    before = F.lag("stem").over(Window.partitionBy("project_id").orderBy("pos"))
    order = parts.where(kind == ".png").withColumn("before", before).groupBy("project_id").agg(F.count_if(F.col("before") > F.col("stem")).alias("n"))
    order = order.where("n > 0").select("project_id", F.lit("sort_order").alias("code"), F.lit("").alias("subject"))
    return named.unionByName(unpaired).unionByName(order)


def zip_limits(entries: DataFrame, most_bytes: int = 2 << 30, most_entries: int = 2000, most_entry: int = 100_000_000, most_total: int = 5_000_000_000) -> DataFrame:
    """By archive the first limit that it breaks; ``entries``: archive, archive_bytes, size."""
    found = entries.groupBy("archive").agg(F.max("archive_bytes").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest"), F.sum("size").alias("total"))
    code = F.when(F.col("bytes") > most_bytes, "archive-too-large").when(F.col("n") > most_entries, "too-many-entries").when(F.col("largest") > most_entry, "entry-too-large").when(F.col("total") > most_total, "total-too-large")
    return found.select("archive", "n", "largest", "total", code.alias("violation"))


def reorder_errors(pages: DataFrame, order: DataFrame) -> DataFrame:
    """By project: whether a new order has the right count, no page twice, none that isn't there."""
    have = pages.groupBy("project_id").agg(F.count("*").alias("n"))
    given = order.groupBy("project_id").agg(F.count("*").alias("m"), F.count_distinct("idx0").alias("d"))
    strange = order.join(pages.select("project_id", "idx0"), ["project_id", "idx0"], "left_anti").groupBy("project_id").agg(F.count("*").alias("s"))
    out = have.join(given, "project_id").join(strange, "project_id", "left")
    code = F.when(F.col("m") != F.col("n"), "count").when(F.col("d") != F.col("m"), "duplicate").when(F.col("s") > 0, "unknown")
    return out.select("project_id", code.alias("error"))
