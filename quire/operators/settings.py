"""Tiered settings: the nearest tier that has a key wins, even with a null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("page", "project", "all", "registry")
#: Flat defaults of the registry, as JSON.
DEFAULTS = (
    ("denoise", "min_component_area", "6"),
    ("denoise", "median_kernel_size", "0"),
    ("deskew", "skip_auto_deskew", "true"),
    ("canvas_map", "do_morph", "false"),
    ("canvas_map", "page_h_w_ratio", "1.294"),
    ("post_transform_crop", "post_transform_crop_insets", "[0, 0, 0, 0]"),
    ("post_ocr_crop", "ocr_crop", "[0, 0, 0, 0]"),
    ("crop", "white_space_additional", None),
)


def tier_rank(tier: Column) -> Column:
    out = F.lit(len(TIERS))
    for k, name in enumerate(TIERS):
        out = F.when(tier == name, k).otherwise(out)
    return out


def resolve(settings: DataFrame, by: Sequence[str]) -> DataFrame:
    """``settings``: by..., tier, key, value with a row where a key is present.  Adds value and tier of the nearest."""
    found = settings.groupBy(*by, "key").agg(F.min_by(F.struct("value", "tier"), tier_rank(F.col("tier"))).alias("_s"))
    return found.select(*by, "key", F.col("_s.value").alias("value"), F.col("_s.tier").alias("tier"))


def pick(page: Column, project: Column, system: Column) -> Column:
    """Page over project over system; a project value counts only where the system has one."""
    return F.coalesce(page, F.when(system.isNotNull(), project), system)


def config_hash(fields: Sequence[str]) -> Column:
    """Digest of the named fields in order of name, null for none."""
    if not fields:
        return F.lit(None).cast("string")
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def stages_of_changed_fields(fields: DataFrame, changed: DataFrame) -> DataFrame:
    """``fields``: stage, field; ``changed``: project_id, field.  Stages that read a changed field."""
    return changed.join(F.broadcast(fields), "field").select("project_id", "stage").distinct()
