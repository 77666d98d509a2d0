"""Settings over time: saves, reverts and resets of tiers, what was in force at a moment, and settings applied to configurations.

Settings are maps from key to JSON text.  A tier of a stage holds one map, which a save replaces whole:

========== ============================================ =====================
event      tier                                          effect
========== ============================================ =====================
save_page  the page's                                    replaced
drop_page  the page's                                    removed
save       ``override``, the project's for a run         replaced
default    ``default``, the project's                    replaced
revert     ``override``                                  removed
reset      ``override`` and ``default``                  removed
all        ``all``, that of every project                replaced
drop_all   ``all``                                       removed
========== ============================================ =====================

Events are ordered by ``at``, then ``seq``; both may not be null.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from quire.operators.settings import TIERS

#: Event, the tiers it touches, and whether it leaves settings there.
EFFECTS = (("save_page", ("page",), True), ("drop_page", ("page",), False), ("save", ("override",), True), ("default", ("default",), True), ("revert", ("override",), False), ("reset", ("override", "default"), False), ("all", ("all",), True), ("drop_all", ("all",), False))
#: Settings keys whose configuration field has another name.
FIELDS = {"min_component_area": "denoise_min_component_area", "median_kernel_size": "denoise_median_kernel_size"}
#: Defaults of the grey-scale stage.
GRAYSCALE: dict[str, Any] = {
    "flatten": {"enabled": False, "radius": 64, "strength": 1.0},
    "converter": "luma",
    "channel": "green",
    "color2gray": {"radius": 300, "samples": 4, "iterations": 10, "enhance_shadows": False},
    "clahe": {"enabled": False, "clip_limit": 2.0, "tile_grid": 8},
    "output_range": [0],
}
#: Keys that tell the nested form of grey-scale settings.
NESTED = ("converter", "flatten", "clahe", "color2gray")
SETTINGS = "map<string,string>"


def json_kind(text: Column) -> Column:
    """bool, int, float, str, list, dict or none, of a JSON text."""
    kind = F.when(text.rlike(r"^\s*(true|false)\s*$"), "bool").when(text.rlike(r"^\s*-?\d+\s*$"), "int").when(text.rlike(r"^\s*-?\d"), "float")
    return kind.when(text.rlike(r'^\s*"'), "str").when(text.rlike(r"^\s*\["), "list").when(text.rlike(r"^\s*\{"), "dict").otherwise("none")


def typed_pick(page: Column, project: Column, system: Column) -> Column:
    """Page over project over system, all JSON text; a project value counts only if it is of the system value's type.

    A truth value counts as a whole number too; a whole number isn't a fraction.
    """
    kind, wanted = json_kind(project), json_kind(system)
    same = project.isNotNull() & system.isNotNull() & ((kind == wanted) | ((kind == "bool") & (wanted == "int")))
    return F.coalesce(page, F.when(same, project), system)


def merged(first: Column, second: Column) -> Column:
    """Two maps; the second one's values win, nulls too.  A null map is empty."""
    empty = F.create_map().cast(SETTINGS)
    first, second = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def tier_changes(events: DataFrame) -> DataFrame:
    """project_id, stage, tier, page_id, at, seq, settings (null: removed) of each tier that an event changes."""
    of = F.create_map(*[c for name, tiers, _ in EFFECTS for c in (F.lit(name), F.array(*map(F.lit, tiers)))])
    leaves = F.col("event").isin(*[name for name, _, kept in EFFECTS if kept])
    out = events.withColumn("tier", F.explode(of[F.col("event")]))
    # App-wide settings belong to no project.
    project = F.when(F.col("tier") != "all", F.col("project_id").cast("string"))
    page = F.when(F.col("tier") == "page", F.col("page_id").cast("string"))
    return out.select(project.alias("project_id"), "stage", "tier", page.alias("page_id"), "at", "seq", F.when(leaves, F.coalesce("settings", F.create_map().cast(SETTINGS))).alias("settings"))


_TIER = ("project_id", "stage", "tier", "page_id")


def intervals(events: DataFrame) -> DataFrame:
    """Each version of each tier: settings, and ``at`` to ``until`` (null: still in force) when they were in force."""
    order = Window.partitionBy(*_TIER).orderBy("at", "seq")
    return tier_changes(events).withColumn("until", F.lead("at").over(order)).where(F.col("settings").isNotNull() & ~F.col("at").eqNullSafe(F.col("until"))).drop("seq")


def tiers_at(events: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions`` (question, project_id, stage, page_id, at) with the settings of each tier at that moment, changes of the moment itself included.

    An as-of join by one window over changes and questions together: no question meets more than the change before it.
    """
    changes = tier_changes(events).select(*_TIER, "at", "seq", F.struct("settings").alias("change"), F.lit(None).cast(questions.schema["question"].dataType).alias("question"), F.lit(False).alias("asks"))
    project, page = F.col("project_id").cast("string"), F.col("page_id").cast("string")
    each = questions.select("question", "stage", "at", project.alias("_p"), page.alias("_g"), F.explode(F.array(*map(F.lit, ("page", "override", "default", "all")))).alias("tier"))
    asked = each.select(F.when(F.col("tier") != "all", F.col("_p")).alias("project_id"), "stage", "tier", F.when(F.col("tier") == "page", F.col("_g")).alias("page_id"), "at", F.lit(None).cast("long").alias("seq"), F.lit(None).cast(changes.schema["change"].dataType).alias("change"), "question", F.lit(True).alias("asks"))
    before = Window.partitionBy(*_TIER).orderBy("at", "asks", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = changes.unionByName(asked).withColumn("held", F.last("change", ignorenulls=True).over(before)).where("asks")
    return found.groupBy("question").agg(F.first("stage").alias("stage"), *(F.max_by("held.settings", F.col("tier") == t).alias(f"{t}_settings") for t in ("page", "override", "default", "all")))


def in_force(held: DataFrame, registry: DataFrame) -> DataFrame:
    """question, key, value and source of each key of the stage's ``registry`` (stage, key, value), of a fixed size.

    The page's settings, or without any those for a run, are over the project's, over those of all projects; the
    nearest that has the key counts, with a null too.
    """
    page = F.coalesce("page_settings", "override_settings")
    out = held.join(F.broadcast(registry.withColumnRenamed("value", "given")), "stage")
    value, source = F.col("given"), F.lit(TIERS[3])
    for settings, tier in ((F.col("all_settings"), TIERS[2]), (F.col("default_settings"), TIERS[1]), (page, TIERS[0])):
        has = F.coalesce(F.map_contains_key(settings, F.col("key")), F.lit(False))
        value, source = F.when(has, settings[F.col("key")]).otherwise(value), F.when(has, tier).otherwise(source)
    return out.select("question", "key", value.alias("value"), source.alias("source"))


def change_log(events: DataFrame, registry: DataFrame) -> DataFrame:
    """project_id, stage, at, event, before and after of each event but app-wide ones, as they are recorded.

    ``before`` is what was in force for the project: the override, or the default, or the stage's ``registry``
    (stage, settings), of a fixed size; ``after`` is what a save left, or what is in force again.
    """
    before = Window.partitionBy("project_id", "stage").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.struct(F.coalesce("settings", F.create_map().cast(SETTINGS)).alias("s"))
    none = F.struct(F.lit(None).cast(SETTINGS).alias("s"))
    touched = {"override": F.when(F.col("event") == "save", kept).when(F.col("event").isin("revert", "reset"), none), "default": F.when(F.col("event") == "default", kept).when(F.col("event") == "reset", none)}
    rows = events.where(~F.col("event").isin("all", "drop_all")).withColumns({f"_{t}": F.last(c, ignorenulls=True).over(before)["s"] for t, c in touched.items()})
    rows = rows.join(F.broadcast(registry.withColumnRenamed("settings", "_registry")), "stage", "left")
    was = F.coalesce("_override", "_default", "_registry")
    after = F.when(F.col("event").isin("save", "default", "save_page"), kept["s"]).when(F.col("event") == "revert", F.coalesce("_default", "_registry")).when(F.col("event") == "reset", F.col("_registry")).otherwise(was)
    return rows.select("project_id", "stage", "at", "event", was.alias("before"), after.alias("after"))


def applied(config: Column, settings: Column, known: Column) -> Column:
    """A configuration with a stage's settings put in under their fields' names: of the ``known`` keys those whose field the configuration has."""
    field = F.create_map(*[F.lit(c) for pair in FIELDS.items() for c in pair])
    named = F.map_from_entries(F.transform(F.map_entries(F.map_filter(settings, lambda k, _: F.array_contains(known, k))), lambda e: F.struct(F.coalesce(field[e["key"]], e["key"]), e["value"])))
    return merged(config, F.map_filter(named, lambda k, _: F.map_contains_key(config, k)))


def nested_form(settings: Column) -> Column:
    """Grey-scale settings of the old flat form in the nested one; those that are nested already, or empty, as they are."""
    there = lambda k: F.coalesce(settings[k], F.lit("null")) != "null"
    converter = F.when(settings["mode"] == '"perceptual"', '"luma_bt709"').otherwise('"luma"')
    made = F.create_map(F.lit("converter"), converter)
    ranged = F.create_map(F.lit("converter"), converter, F.lit("output_range"), F.concat(F.lit("["), settings["output_range_min"], F.lit(", "), settings["output_range_max"], F.lit("]")))
    nested = F.exists(F.map_keys(settings), lambda k: k.isin(*NESTED))
    return F.when((F.size(settings) <= 0) | nested, settings).when(there("output_range_min") & there("output_range_max"), ranged).otherwise(made)


def schema_of(defaults: Any) -> DataType:
    """The type of nested defaults."""
    if isinstance(defaults, dict):
        return StructType([StructField(k, schema_of(v)) for k, v in defaults.items()])
    if isinstance(defaults, list):
        return ArrayType(schema_of(defaults[0]))
    return {bool: BooleanType(), int: LongType(), float: DoubleType(), str: StringType()}[type(defaults)]


def with_defaults(found: Column, defaults: dict[str, Any]) -> Column:
    """A struct (of ``schema_of`` the defaults, null: empty) filled up from nested defaults, level by level; lists have no default."""
    fields = []
    for k, v in defaults.items():
        filled = with_defaults(found[k], v) if isinstance(v, dict) else found[k] if isinstance(v, list) else F.coalesce(found[k], F.lit(v))
        fields.append(filled.alias(k))
    return F.struct(*fields)


def parsed(text: Column, defaults: dict[str, Any]) -> Column:
    """A JSON text with nested defaults filled in; unknown keys are passed over, a text that is no object is empty."""
    return with_defaults(F.from_json(text, schema_of(defaults)), defaults)
