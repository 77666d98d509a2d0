"""Settings queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import settings as S
from quire.operators import settingshistory as H
from quire.registry import query
from quire.tables import table

_ROWS = "SELECT event_id % 40 AS page_no, CASE event_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'project' WHEN 2 THEN 'all' ELSE 'registry' END AS tier, 'k' || CAST(user_id % 6 AS VARCHAR) AS key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS value, event_id FROM events"
_ONE = f"SELECT page_no, tier, key, arg_max(struct_pack(v := value), event_id).v AS value FROM ({_ROWS}) GROUP BY page_no, tier, key"


def _settings(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    tier = F.when(e % 5 == 0, "page").when(e % 5 == 1, "project").when(e % 5 == 2, "all").otherwise("registry")
    rows = table(spark, d, "events").select((e % 40).alias("page_no"), tier.alias("tier"), F.concat(F.lit("k"), (u % 6).cast("string")).alias("key"), F.when(e % 4 == 0, None).otherwise(F.col("event_type")).alias("value"), e)
    return rows.groupBy("page_no", "tier", "key").agg(F.max_by(F.struct("value"), "event_id").alias("s")).select("page_no", "tier", "key", "s.value")


@query(f"WITH s AS ({_ONE}) SELECT page_no, key, value, tier FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_no, key ORDER BY CASE tier WHEN 'page' THEN 0 WHEN 'project' THEN 1 WHEN 'all' THEN 2 ELSE 3 END) AS rn FROM s) WHERE rn = 1")
def effective_settings(spark: SparkSession, d: str) -> DataFrame:
    """Four tiers; the nearest with the key wins, a stored null too."""
    return S.resolve(_settings(spark, d), ["page_no"])


@query(f"WITH s AS ({_ONE}) SELECT tier, COUNT(*) AS keys FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_no, key ORDER BY CASE tier WHEN 'page' THEN 0 WHEN 'project' THEN 1 WHEN 'all' THEN 2 ELSE 3 END) AS rn FROM s) WHERE rn = 1 GROUP BY tier")
def settings_provenance(spark: SparkSession, d: str) -> DataFrame:
    return S.resolve(_settings(spark, d), ["page_no"]).groupBy("tier").agg(F.count("*").alias("keys"))


@query("SELECT c_custkey, COALESCE(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN CAST(c_custkey AS BIGINT) END, CASE WHEN c_custkey % 5 <> 0 THEN 165 END) AS value FROM customer")
def three_layer_pick(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    system = F.when(c % 5 != 0, 165)
    return table(spark, d, "customer").select("c_custkey", S.pick(F.when(c % 3 == 0, F.col("c_nationkey")), F.when(c % 2 == 0, c), system).cast("bigint").alias("value"))


@query("SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || CAST(p_size AS VARCHAR) || '}') AS config_hash FROM part")
def config_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.config_hash(["p_size", "p_brand"]).alias("config_hash"))


_FIELDS = [("threshold", "threshold_level"), ("crop", "white_space_additional"), ("crop", "initial_crop"), ("deskew", "skip_auto_deskew"), ("canvas_map", "do_morph"), ("canvas_map", "page_h_w_ratio"), ("ocr", "use_ocr_bbox_edge")]


@query(
    "SELECT DISTINCT user_id AS project_id, f.stage FROM events JOIN (VALUES " + ", ".join(f"('{s}', '{f}', {k})" for k, (s, f) in enumerate(_FIELDS)) + ") f(stage, field, k) ON f.k = event_id % 7 WHERE event_type = 'error'"
)
def stages_of_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(f) for _, f in _FIELDS])
    changed = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("project_id"), F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("field")).distinct()
    return S.stages_of_changed_fields(spark.createDataFrame(_FIELDS, "stage string, field string"), changed)


#: An event's kind by its number; the last one asks what is in force.
_KINDS = ("save_page", "default", "save", "save_page", "drop_page", "revert", "default", "all", "reset", "drop_all", "ask")
_STAGES = {"denoise": (("min_component_area", "6"), ("median_kernel_size", "0")), "canvas_map": (("do_morph", "false"), ("page_h_w_ratio", "1.294"))}
_HISTORY = f"""WITH e AS (SELECT event_id AS moment, user_id % 7 AS project_id, CASE WHEN event_id % 2 = 0 THEN 'denoise' ELSE 'canvas_map' END AS stage, user_id % 5 AS page_id,
  [{", ".join(f"'{k}'" for k in _KINDS)}][event_id % 11 + 1] AS event,
  CASE WHEN event_id % 2 = 0 THEN map(['min_component_area', 'unknown'] || CASE WHEN event_id % 3 = 0 THEN ['median_kernel_size'] ELSE [] END, [CAST(event_id % 9 AS VARCHAR), '1'] || CASE WHEN event_id % 3 = 0 THEN [CAST(NULL AS VARCHAR)] ELSE [] END)
    ELSE map(['do_morph'], ['true']) END AS settings FROM events),
registry(stage, key, value) AS (VALUES {", ".join(f"('{s}', '{k}', '{v}')" for s, pairs in _STAGES.items() for k, v in pairs)})"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (e % 11 + 1).cast("int"))
    area = F.map_concat(F.create_map(F.lit("min_component_area"), (e % 9).cast("string"), F.lit("unknown"), F.lit("1")), F.when(e % 3 == 0, F.create_map(F.lit("median_kernel_size"), F.lit(None).cast("string"))).otherwise(F.create_map().cast(H.SETTINGS)))
    settings = F.when(e % 2 == 0, area).otherwise(F.create_map(F.lit("do_morph"), F.lit("true")))
    stage = F.when(e % 2 == 0, "denoise").otherwise("canvas_map")
    return table(spark, d, "events").select(e.alias("at"), e.alias("seq"), (F.col("user_id") % 7).alias("project_id"), stage.alias("stage"), (F.col("user_id") % 5).alias("page_id"), kind.alias("event"), settings.alias("settings"))


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k, v) for s, pairs in _STAGES.items() for k, v in pairs], "stage string, key string, value string")


def _held(spark: SparkSession, d: str) -> DataFrame:
    rows = _history(spark, d)
    return H.tiers_at(rows.where("event <> 'ask'"), rows.where("event = 'ask'").withColumnRenamed("seq", "question"))


def _tier(name: str, tier: str, where: str) -> str:
    """SQL of one tier of each question: the last change before it."""
    return f"{name} AS (SELECT q.moment AS question, arg_max(struct_pack(v := CASE WHEN c.kept THEN c.settings END), c.moment).v AS m FROM q JOIN c ON c.tier = '{tier}' AND c.stage = q.stage AND c.moment < q.moment AND {where} GROUP BY q.moment)"


_EFFECTS = ", ".join(f"('{n}', '{t}', {str(kept).upper()})" for n, tiers, kept in H.EFFECTS for t in tiers)
_HELD = f"""{_HISTORY}, q AS (SELECT * FROM e WHERE event = 'ask'), effects(event, tier, kept) AS (VALUES {_EFFECTS}), c AS (SELECT e.*, tier, kept FROM e JOIN effects x ON x.event = e.event),
{_tier("pg", "page", "c.project_id = q.project_id AND c.page_id = q.page_id")}, {_tier("ov", "override", "c.project_id = q.project_id")}, {_tier("df", "default", "c.project_id = q.project_id")}, {_tier("al", "all", "TRUE")},
h AS (SELECT q.moment AS question, q.stage, coalesce(pg.m, ov.m) AS p, df.m AS j, al.m AS a FROM q LEFT JOIN pg ON pg.question = q.moment LEFT JOIN ov ON ov.question = q.moment LEFT JOIN df ON df.question = q.moment LEFT JOIN al ON al.question = q.moment),
r AS (SELECT question, h.stage, key, CASE WHEN list_contains(map_keys(p), key) THEN 'page' WHEN list_contains(map_keys(j), key) THEN 'project' WHEN list_contains(map_keys(a), key) THEN 'all' ELSE 'registry' END AS source, p, j, a, value FROM h JOIN registry g ON g.stage = h.stage),
f AS (SELECT question, stage, key, source, CASE source WHEN 'page' THEN p[key] WHEN 'project' THEN j[key] WHEN 'all' THEN a[key] ELSE value END AS value FROM r)
"""


@query(_HELD + "SELECT question, key, value, source FROM f")
def settings_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What was in force for a page at a moment, of every save, drop, revert and reset before it."""
    return H.in_force(_held(spark, d), _registry(spark))


@query(f"{_HISTORY}, effects(event, tier, kept) AS (VALUES {_EFFECTS}), c AS (SELECT e.*, tier, kept, lead(moment) OVER (PARTITION BY CASE WHEN tier = 'all' THEN NULL ELSE project_id END, stage, tier, CASE WHEN tier = 'page' THEN page_id END ORDER BY moment) AS until FROM e JOIN effects x ON x.event = e.event) SELECT stage, tier, COUNT(*) AS versions, COUNT(until) AS replaced, CAST(SUM(until - moment) AS BIGINT) AS held FROM c WHERE kept GROUP BY stage, tier")
def settings_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = H.intervals(_history(spark, d).where("event <> 'ask'"))
    return rows.groupBy("stage", "tier").agg(F.count("*").alias("versions"), F.count("until").alias("replaced"), F.sum(F.col("until") - F.col("at")).alias("held"))


def _told(m: str) -> str:
    return f"array_to_string(list_sort(list_transform(map_entries({m}), lambda x: x.key || '=' || coalesce(x.value, 'null'))), ';')"


def _tell(m: str):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("null"))))), ";")


@query(f"""{_HISTORY}, g AS (SELECT stage, map(list(key ORDER BY key), list(value ORDER BY key)) AS registry FROM registry GROUP BY stage),
w AS (SELECT e.*, last_value(CASE event WHEN 'save' THEN struct_pack(s := settings) WHEN 'revert' THEN struct_pack(s := NULL) WHEN 'reset' THEN struct_pack(s := NULL) END IGNORE NULLS) OVER v AS o,
  last_value(CASE event WHEN 'default' THEN struct_pack(s := settings) WHEN 'reset' THEN struct_pack(s := NULL) END IGNORE NULLS) OVER v AS j
  FROM e WHERE event NOT IN ('all', 'drop_all', 'ask') WINDOW v AS (PARTITION BY project_id, stage ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT w.*, coalesce(o.s, j.s, registry) AS was, CASE WHEN event IN ('save', 'default', 'save_page') THEN settings WHEN event = 'revert' THEN coalesce(j.s, registry) WHEN event = 'reset' THEN registry ELSE coalesce(o.s, j.s, registry) END AS now FROM w JOIN g ON g.stage = w.stage)
SELECT project_id, moment, event, {_told("was")} AS before, {_told("now")} AS after FROM b""")
def settings_change_log(spark: SparkSession, d: str) -> DataFrame:
    registry = _registry(spark).groupBy("stage").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))
    found = H.change_log(_history(spark, d).where("event <> 'ask'"), registry)
    return found.select("project_id", F.col("at").alias("moment"), "event", _tell("before").alias("before"), _tell("after").alias("after"))


@query(_HELD + """, m AS (SELECT question, CASE key WHEN 'min_component_area' THEN 'denoise_min_component_area' WHEN 'median_kernel_size' THEN 'denoise_median_kernel_size' ELSE key END AS field, value FROM f),
base AS (SELECT moment AS question, field, value FROM q, (VALUES ('denoise_min_component_area', '1'), ('do_morph', 'false'), ('ocr_dpi', '300')) v(field, value))
SELECT b.question, b.field, CASE WHEN m.field IS NULL THEN b.value ELSE m.value END AS value FROM base b LEFT JOIN m ON m.question = b.question AND m.field = b.field""")
def applied_settings(spark: SparkSession, d: str) -> DataFrame:
    """Configurations after the settings in force were applied: known keys, under their fields' names, if there is such a field."""
    found = H.in_force(_held(spark, d), _registry(spark)).groupBy("question").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))
    config = F.create_map(*[F.lit(x) for x in ("denoise_min_component_area", "1", "do_morph", "false", "ocr_dpi", "300")])
    known = F.array(*[F.lit(k) for pairs in _STAGES.values() for k, _ in pairs])
    return found.withColumn("config", config).select("question", F.explode(H.applied(F.col("config"), F.col("settings"), known)).alias("field", "value"))


_FLAT = "CASE event_id % 4 WHEN 0 THEN map(['mode', 'gamma', 'output_range_min', 'output_range_max'], ['\"perceptual\"', '1.1', CAST(user_id % 9 AS VARCHAR), '255']) WHEN 1 THEN map(['mode', 'output_range_min'], ['\"standard\"', '3']) WHEN 2 THEN map(['converter', 'mode'], ['\"lab_l\"', '\"perceptual\"']) ELSE map(['gamma', 'output_range_min', 'output_range_max'], ['2', 'null', '9']) END"


@query(f"""WITH e AS (SELECT event_id, event_id % 4 AS k, user_id, {_FLAT} AS m FROM events),
n AS (SELECT event_id, CASE k WHEN 0 THEN map(['converter', 'output_range'], ['"luma_bt709"', '[' || CAST(user_id % 9 AS VARCHAR) || ', 255]']) WHEN 2 THEN m ELSE map(['converter'], ['"luma"']) END AS m FROM e)
SELECT event_id, {_told("m")} AS settings FROM n""")
def nested_settings(spark: SparkSession, d: str) -> DataFrame:
    """Grey-scale settings of the flat form rewritten to the nested one."""
    e, text = F.col("event_id"), lambda *x: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in x])
    flat = F.when(e % 4 == 0, text("mode", '"perceptual"', "gamma", "1.1", "output_range_min", (F.col("user_id") % 9).cast("string"), "output_range_max", "255")).when(e % 4 == 1, text("mode", '"standard"', "output_range_min", "3"))
    flat = flat.when(e % 4 == 2, text("converter", '"lab_l"', "mode", '"perceptual"')).otherwise(text("gamma", "2", "output_range_min", "null", "output_range_max", "9"))
    return table(spark, d, "events").select("event_id", H.nested_form(flat).alias("m")).select("event_id", _tell("m").alias("settings"))


#: Three levels of defaults.
_DEFAULTS = {"name": "luma", "clahe": {"enabled": False, "tile_grid": 8, "limits": {"low": 0.5, "high": 2.0}}}


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'luma' END AS name, event_id % 4 = 1 AS enabled, CASE WHEN event_id % 4 = 2 THEN user_id ELSE 8 END AS tile_grid, CASE WHEN event_id % 4 = 2 AND event_id % 2 = 0 THEN 0.25 ELSE 0.5 END AS low, 2.0 AS high FROM events""")
def nested_defaults(spark: SparkSession, d: str) -> DataFrame:
    """JSON of three levels, with parts missing at each, filled up from defaults."""
    e = F.col("event_id")
    inner = F.when(e % 4 == 1, F.lit('"clahe":{"enabled":true,"limits":null,"unknown":1}')).when(e % 4 == 2, F.concat(F.lit('"clahe":{"tile_grid":'), F.col("user_id").cast("string"), F.lit(',"limits":{"low":0.25}}'))).when(e % 4 == 3, F.lit('"clahe":null'))
    name = F.when(e % 3 == 0, F.concat(F.lit('"name":"'), F.col("event_type"), F.lit('"')))
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("{"), F.concat_ws(",", name, inner), F.lit("}")).alias("json"))
    found = rows.select("event_id", H.parsed(F.col("json"), _DEFAULTS).alias("c"))
    return found.select("event_id", "c.name", "c.clahe.enabled", "c.clahe.tile_grid", "c.clahe.limits.low", "c.clahe.limits.high")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '9' WHEN c_custkey % 5 = 0 THEN '7' WHEN c_custkey % 5 = 1 THEN 'true' ELSE '165' END AS number, CASE WHEN c_custkey % 11 = 0 THEN '9' WHEN c_custkey % 5 = 2 THEN '0.5' ELSE '1.3' END AS fraction,
CASE WHEN c_custkey % 11 = 0 THEN '9' WHEN c_custkey % 5 = 3 THEN '"x"' ELSE '"doctr"' END AS word FROM customer""")
def typed_picks(spark: SparkSession, d: str) -> DataFrame:
    """A project's value counts only if it is of the type of the system's."""
    c = F.col("c_custkey")
    page = F.when(c % 11 == 0, "9")
    project = F.when(c % 5 == 0, "7").when(c % 5 == 1, "true").when(c % 5 == 2, "0.5").when(c % 5 == 3, '"x"').otherwise("null")
    return table(spark, d, "customer").select("c_custkey", *(H.typed_pick(page, project, F.lit(system)).alias(n) for n, system in (("number", "165"), ("fraction", "1.3"), ("word", '"doctr"'))))
