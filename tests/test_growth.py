"""Results of steps whose cost has to grow in proportion to their input, on rows where they would not, and tokens at their edges."""

from __future__ import annotations

import re
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.llm import toxicity
from quire.operators import geometry, listing, textindex
from quire.operators.ranking import Query
from quire.operators.snippets import snippet


def test_next_marked_of_a_long_project(spark):
    n = 60_000
    pages = spark.range(n).select(F.lit("p").alias("project_id"), F.col("id").cast("int").alias("idx0"), (F.col("id") % 1000 == 7).alias("m")).union(spark.createDataFrame([("q", 0, True)], "project_id string, idx0 int, m boolean"))
    found = listing.next_marked(pages, F.col("m"))
    # A frame up to the end of the project reads, for every page, all that follow.
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    want = {("p", k): next((x for x in range(k + 1, min(k + 1001, n)) if x % 1000 == 7), None) for k in range(0, n, 53)} | {("q", 0): None}
    assert {(r.project_id, r.idx0): r.next_flagged for r in found.where("idx0 % 53 = 0").collect()} == want


W = r"[^\W]"
AWKWARD = [
    None, "", "-\n", "a-\nb", "a-\nb-\nc", "a-\nb-\nc-\nd e-\nf-\n-\ng", "ti-\non Ti-\non tI-\nti-\non", "x-\nti-\non ti-\nti-\nti-\non", "xti-\non 𝒜ti-\non ti-\n𝒜", " ti-\non-\nti-\non", "ti-\r\non ti-\n on é_ti-\non",
    "tbe", "tbe-tbe tbe' 'tbe --tbe a-tbe a--tbe tbe- tbe-a tbe's atbe tbea 𝒜tbe tbe𝒜 _tbe (tbe)", "tbes arid arid-zone arid. ar is is's 'is' İs ıs", "x'tbe x''tbe 1tbe 1'tbe ’tbe tbe—tbe", "$1 is \\ is", "𝒜-\nb a𝒜-\n𝒜-\n𝒜 😀-\nx x-\n😀", "ACT-\nOR aC-\nt ac-\n-\nac-\nact",
]


def test_scannos_and_hyphens_at_the_edges_of_tokens(spark):
    scannos = {"tbe": "the", "tbes": "t$1\\s", "arid": "and", "a b": "no token", "": "nothing", "tbe's": "the's"}
    rows = spark.createDataFrame(list(enumerate(AWKWARD)), "k int, t string")
    t = F.col("t")
    found = rows.select("k", T.replace_scannos(t, scannos), T.replace_scannos(t, {"is": "$1\\"}), T.join_hyphens(t, ["ti-", "Ac"]), T.hyphen_candidates(t), T.apply_joins(t, F.transform(F.filter(T.hyphen_candidates(t), lambda c: c["char_offset"] % 2 == 0), lambda c: c["candidate_id"])))
    for k, several, one, joined, candidates, applied in found.collect():
        text = AWKWARD[k]
        if text is None:
            assert (several, one, joined, candidates, applied) == (None, None, None, [], None)
            continue
        matches = list(re.finditer(rf"({W}+)-\n({W}+)", text))
        by = lambda names: re.sub(rf"{W}+(?:[-']{W}+)*", lambda m: names.get(m[0], m[0]), text)  # noqa: B023, E731
        put = lambda when: re.sub(rf"({W}+)-\n({W}+)", lambda m: m[1] + m[2] if when(m) else m[0], text)  # noqa: B023, E731
        assert (several, one) == (by(scannos), by({"is": "$1\\"}))
        assert joined == put(lambda m: m[1].lower() in ("ti", "ac"))
        assert [(c["prefix"], c["suffix"], c["char_offset"], c["match"]) for c in candidates] == [(m[1], m[2], m.start(), m[0]) for m in matches]
        assert applied == put(lambda m: m.start() % 2 == 0)


def test_long_words_and_tokens(spark):
    """A word of 300,000 letters isn't read again from each of its letters, a token of many parts needs no deep stack."""
    rows = spark.createDataFrame([("ti-\non " + "x" * 300_000 + "-\ny",), ("a-" * 100_000 + "tbe tbe ti-\non",)], "t string")
    out = T.replace_scannos(T.join_hyphens(F.col("t"), ["ti"]), {"tbe": "the", "wbich": "which"})
    found = [(r[0], [c["char_offset"] for c in r[1]]) for r in rows.select(out, T.hyphen_candidates(F.col("t"))).collect()]
    assert found == [("tion " + "x" * 300_000 + "-\ny", [0, 7]), ("a-" * 100_000 + "tbe the tion", [200_008])]


def test_snippet_of_a_long_text():
    """The text isn't copied for each word nor all places looked at for each: that would take minutes here."""
    words = [("the fox. " if k % 3 else "in the ") + f"w{k}" for k in range(60_000)]
    began = time.time()
    assert snippet(" ".join(words), Query.of('"in the" AND fox')) == "in the w0 the fox. w1 the fox. w2 in the w3 the fox. w4..."
    assert time.time() - began < 20


def test_an_index_keeps_lists_of_pages(spark, tmp_path):
    pages = spark.range(400).select(F.lit("p").alias("project"), F.col("id").alias("page"), F.concat(F.lit("the fox the "), F.col("id") % 7).alias("text")).coalesce(1)
    index = textindex.build(pages, str(tmp_path / "index"), ["project", "page"], buckets=4)
    after = textindex.upsert(index, pages.where("page % 2 = 0").withColumn("text", F.lit("a fox")), pages.where("page = 1").select("project", "page"))
    rows = lambda i: sorted((r.page, r.length, r.token, tuple(r.positions)) for r in i.postings().collect())
    want = lambda k: [(k, 4, "fox", (1,)), (k, 4, "the", (0, 2)), (k, 4, str(k % 7), (3,))]
    assert rows(index) == sorted(r for k in range(400) for r in want(k))
    assert rows(after) == sorted(r for k in range(400) if k != 1 for r in (want(k) if k % 2 else [(k, 2, "a", (0,)), (k, 2, "fox", (1,))]))
    # A row for each page and token was dealt out, sorted and written before.
    kept = [spark.read.parquet(f"{tmp_path}/index/postings/version={v}").groupBy("token").count().agg(F.max("count")).first()[0] for v in (1, 2)]
    assert kept[0] == 1 and kept[1] <= 4


def test_boxes_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    boxes = spark.range(9000).select((F.col("id") % 300).alias("page_no"), *((F.hash("id", F.lit(c)) % 500 + 500).alias(c) for c in "xywh"))
    want = sorted(map(tuple, geometry.merge_zones(boxes, gap=-300).collect()))
    monkeypatch.setattr(geometry, "ROWS", 500)
    found = geometry.merge_zones(boxes, gap=-300)
    # The number of tasks was that of Spark's setting, whatever the number of boxes.
    assert "REPARTITION_BY_NUM" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(page_no" in plan and ", 19)" in plan
    assert sorted(map(tuple, found.collect())) == want and len(want) > 300


def test_fit_keeps_numbers_of_chosen_terms_only():
    """As many terms as the sample may have: the driver held each of them as several 64-bit numbers, 191 MB here."""
    random = np.random.default_rng(3)
    rows = [(k % 2, np.unique(np.append(random.integers(1000, toxicity.BUCKETS, 700), k % 2)).astype("<u4").tobytes()) for k in range(9000)]
    tracemalloc.start()
    try:
        model = toxicity.fit(rows, terms=64, steps=2)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {0, 1} <= set(model["buckets"].tolist()) and len(model["buckets"]) == 64
    assert most < 80e6, most
