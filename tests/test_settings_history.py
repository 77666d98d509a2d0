from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import settingshistory as H

EVENTS = "project_id string, stage string, page_id string, at int, seq int, event string, settings map<string,string>"
REGISTRY = {"denoise": {"min_component_area": "6", "median_kernel_size": "0"}, "crop": {"white_space_additional": None}}
KINDS = [name for name, _, _ in H.EFFECTS]


class Store:
    """Tiers as they are kept one after the other."""

    def __init__(self):
        self.tiers: dict = {}

    def apply(self, e):
        project, stage, page, _, _, event, settings = e
        keys = {"page": (project, stage, "page", page), "override": (project, stage, "override"), "default": (project, stage, "default"), "all": (stage, "all")}
        for name, tiers, kept in H.EFFECTS:
            if name == event:
                for t in tiers:
                    self.tiers.pop(keys[t], None)
                    if kept:
                        self.tiers[keys[t]] = settings or {}

    def project(self, project, stage):
        return self.tiers.get((project, stage, "override"), self.tiers.get((project, stage, "default"), REGISTRY[stage]))

    def effective(self, project, stage, page):
        own = self.tiers.get((project, stage, "page", page), self.tiers.get((project, stage, "override")))
        layers = [("page", own), ("project", self.tiers.get((project, stage, "default"))), ("all", self.tiers.get((stage, "all"))), ("registry", REGISTRY[stage])]
        return {k: next((layer[k], name) for name, layer in layers if layer is not None and k in layer) for k in REGISTRY[stage]}


def events(n=300):
    r = random.Random(5)
    out = []
    for k in range(n):
        stage = r.choice(list(REGISTRY))
        settings = {key: r.choice(["1", "2", None]) for key in [*REGISTRY[stage], "unknown"] if r.random() < 0.6}
        out.append((r.choice("ab"), stage, r.choice(["p1", "p2"]), k // 2, k, r.choice(KINDS), r.choice([settings, settings, None])))
    return out


def test_as_of_and_the_log_against_a_store(spark):
    rows = events()
    r = random.Random(6)
    questions = [(k, r.choice("ab"), r.choice(list(REGISTRY)), r.choice(["p1", "p2", "p3"]), r.randrange(-1, 152)) for k in range(200)]
    want, log, store, at = {}, {}, Store(), 0
    for q in sorted(questions, key=lambda q: q[4]):
        while at < len(rows) and rows[at][3] <= q[4]:
            store.apply(rows[at])
            at += 1
        want[q[0]] = store.effective(*q[1:4])
    store = Store()
    for e in rows:
        before = store.project(e[0], e[1])
        store.apply(e)
        if e[5] not in ("all", "drop_all"):
            log[e[4]] = (before, (e[6] or {}) if e[5] in ("save", "default", "save_page") else REGISTRY[e[1]] if e[5] == "reset" else store.project(e[0], e[1]))
    frame = spark.createDataFrame(rows, EVENTS)
    held = H.tiers_at(frame, spark.createDataFrame(questions, "question int, project_id string, stage string, page_id string, at int"))
    registry = spark.createDataFrame([(s, k, v) for s, keys in REGISTRY.items() for k, v in keys.items()], "stage string, key string, value string")
    found: dict = {}
    for row in H.in_force(held, registry).collect():
        found.setdefault(row.question, {})[row.key] = (row.value, row.source)
    assert found == want
    told = H.change_log(frame.withColumn("n", F.col("seq")), spark.createDataFrame(list(REGISTRY.items()), "stage string, settings map<string,string>"))
    got = sorted(((r.at, r.event, str(sorted(r.before.items())), str(sorted(r.after.items()))) for r in told.collect()))
    assert got == sorted((rows[k][3], rows[k][5], str(sorted(b.items())), str(sorted(a.items()))) for k, (b, a) in log.items())


def test_intervals(spark):
    rows = [("a", "crop", "p", 1, 1, "save", {"k": "1"}), ("a", "crop", "p", 3, 2, "save", {"k": "2"}), ("a", "crop", "p", 5, 3, "revert", None), ("a", "crop", "p", 6, 4, "default", {"k": "3"}), ("a", "crop", "p", 7, 5, "reset", None), ("b", "crop", None, 8, 6, "all", {"k": "4"})]
    found = {(r.tier, r.at, r.until, r.settings["k"]) for r in H.intervals(spark.createDataFrame(rows, EVENTS)).collect()}
    assert found == {("override", 1, 3, "1"), ("override", 3, 5, "2"), ("default", 6, 7, "3"), ("all", 8, None, "4")}
    assert H.intervals(spark.createDataFrame([], EVENTS)).count() == 0


@pytest.mark.parametrize(
    "page, project, system, want",
    [("1", "2", "3", "1"), (None, "2", "3", "2"), (None, '"x"', "3", "3"), (None, "true", "3", "true"), (None, "3", "1.5", "1.5"), (None, "1e3", "1.5", "1e3"), (None, "1", "true", "true"), (None, "[1]", "[]", "[1]"), (None, "1", None, None), (None, "null", "3", "3"), (None, None, '"a"', '"a"')],
)
def test_typed_pick(spark, page, project, system, want):
    row = spark.createDataFrame([(page, project, system)], "page string, project string, system string")
    assert row.select(H.typed_pick(F.col("page"), F.col("project"), F.col("system"))).first()[0] == want


def test_applied_merged_and_nested(spark):
    row = spark.createDataFrame([({"denoise_min_component_area": "1", "ocr_dpi": "300", "do_morph": None}, {"min_component_area": "9", "do_morph": "true", "unheard": "1", "ocr_dpi": "1", "crop": "2"}, None)], "config map<string,string>, settings map<string,string>, none map<string,string>")
    known = F.array(*map(F.lit, ("min_component_area", "do_morph", "crop")))
    assert row.select(H.applied(F.col("config"), F.col("settings"), known)).first()[0] == {"denoise_min_component_area": "9", "ocr_dpi": "300", "do_morph": "true"}
    assert row.select(H.applied(F.col("config"), F.col("none"), known)).first()[0] == {"denoise_min_component_area": "1", "ocr_dpi": "300", "do_morph": None}
    assert row.select(H.merged(F.col("none"), F.col("none"))).first()[0] == {}
    for given, want in (({}, {}), ({"gamma": "1"}, {"converter": '"luma"'}), ({"flatten": "{}", "mode": '"perceptual"'}, {"flatten": "{}", "mode": '"perceptual"'}), ({"mode": '"perceptual"', "output_range_min": "1", "output_range_max": "2"}, {"converter": '"luma_bt709"', "output_range": "[1, 2]"})):
        frame = spark.createDataFrame([(given,)], "m map<string,string>")
        once = frame.select(H.nested_form(F.col("m")).alias("m"))
        assert once.first()[0] == want and once.select(H.nested_form(F.col("m"))).first()[0] == want


@pytest.mark.parametrize("text, want", [("{}", {}), (None, {}), ("[1]", {}), ('{"flatten":{"radius":3},"extra":1}', {"flatten": {"radius": 3}}), ('{"clahe":null,"channel":"red","output_range":[1,2]}', {"channel": "red", "output_range": [1, 2]})])
def test_grey_scale_defaults(spark, text, want):
    found = spark.createDataFrame([(text,)], "t string").select(H.parsed(F.col("t"), H.GRAYSCALE).alias("c")).first()["c"].asDict(recursive=True)
    full = {k: v | want.get(k, {}) if isinstance(v, dict) else want.get(k, None if isinstance(v, list) else v) for k, v in H.GRAYSCALE.items()}
    assert found == full
