from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import drift, geometry, images, listing, search, settings, stages, words
from quire.operators.ranking import Query
from quire.sources import archives, packages


def test_lines_are_rebuilt(spark):
    rows = [("p", 0, 1, 50, 12, 30, 10, "quick", False), ("p", 0, 2, 10, 10, 30, 12, "the", None), ("p", 0, 3, 10, 80, 30, 10, "fox", False), ("p", 0, 4, 90, 10, 30, 10, "noise", True)]
    frame = spark.createDataFrame(rows, "project_id string, idx0 int, word_id int, left int, top int, width int, height int, text string, deleted boolean")
    assert words.page_text(frame).first()["page_text"] == "the quick\nfox"


def test_zones_against_a_sequential_merge(spark):
    random = np.random.default_rng(1)
    rows = [(int(p), int(x), int(y), int(w), int(h)) for p, x, y, w, h in zip(*(random.integers(0, n, 200) for n in (6, 50, 200, 20, 20)), strict=True)]
    found = geometry.merge_zones(spark.createDataFrame(rows, "page_no int, x int, y int, w int, h int"), gap=3)
    wanted = []
    for p in range(6):
        bottom = None
        for _, x, y, w, h in sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[1], r[3], r[4])):
            if bottom is None or y > bottom + 3:
                wanted.append([p, x, y, x + w, y + h])
            else:
                z = wanted[-1]
                wanted[-1] = [p, min(z[1], x), min(z[2], y), max(z[3], x + w), max(z[4], y + h)]
            bottom = wanted[-1][4]
    assert sorted((r.page_no, r.x, r.y, r.x + r.w, r.y + r.h) for r in found.collect()) == sorted(map(tuple, wanted))


def test_states(spark):
    below = {(r.stage, r.descendant) for r in stages.closure(spark).collect()}
    assert ("source", "archive") in below and ("ocr", "archive") in below and ("archive", "source") not in below and not any(a == b for a, b in below)
    states = spark.createDataFrame([("p", 0, "crop", "dirty"), ("p", 0, "ocr", "clean"), ("p", 0, "regex", "running"), ("p", 1, "ocr", "clean")], "project_id string, page_no int, stage string, status string")
    out = stages.cascade(states, states.where("status = 'dirty'"), stages.closure(spark))
    assert {(r.page_no, r.stage): r.status for r in out.collect()} == {(0, "crop"): "dirty", (0, "ocr"): "dirty", (0, "regex"): "running", (1, "ocr"): "clean"}


def test_settings_presence_beats_null(spark):
    rows = spark.createDataFrame([(1, "registry", "k", "a"), (1, "page", "k", None), (2, "all", "k", "b"), (2, "registry", "k", "a")], "page_no int, tier string, key string, value string")
    assert {r.page_no: (r.value, r.tier) for r in settings.resolve(rows, ["page_no"]).collect()} == {1: (None, "page"), 2: ("b", "all")}


def test_drift(spark):
    key = "project_id string, page_no int, stage_ord int"
    states = spark.createDataFrame([("p", 0, 0, "clean", "a"), ("p", 0, 1, "clean", "b"), ("p", 0, 2, "clean", None), ("p", 0, 3, "dirty", "d")], key + ", status string, input_hash string")
    files = spark.createDataFrame([("p", 0, 1, "output.png", "x"), ("p", 0, 2, "output.png", "c"), ("p", 0, 2, "output.txt", "y"), ("p", 0, 3, "output.a", "d"), ("p", 0, 99, "output.a", "d"), ("p", 1, 4, "o", "e")], key + ", path string, content_hash string")
    found = {(r.page_no, r.stage_ord, r.finding) for r in drift.drift(states, files, 24).collect()}
    assert found == {(0, 0, "missing"), (0, 1, "hash-mismatch"), (0, 2, "extra-file"), (0, 3, "non-clean-row"), (0, 99, "unknown-stage"), (1, 4, "no-row")}


def test_search(spark):
    pages = spark.createDataFrame([("a", 0, "The Café fox"), ("a", 1, "fox fox dog"), ("b", 2, "dog"), ("b", 3, None)], "project_id string, idx0 int, text string")
    assert [r.idx0 for r in search.search(pages, "fox", ["project_id", "idx0"]).orderBy("rank").collect()] == [1, 0]
    assert [r.idx0 for r in search.search(pages, "caf*", ["project_id", "idx0"], project="a").collect()] == [0]
    for query in ("café", "CAFE", "Café*"):
        assert [r.idx0 for r in search.search(pages, query, ["project_id", "idx0"], project="a").collect()] == [0], query
    assert Query.of("ſword co-op* _x").slots == [("sword", False), ("co", False), ("op", True), ("x", False)]
    assert search.search(pages, "cafe dog", ["project_id", "idx0"]).count() == 0
    with pytest.raises(ValueError):
        search.search(pages, " ", ["project_id"])


def test_paging_and_review(spark):
    rows = spark.createDataFrame([("p", k) for k in range(5)], "project_id string, idx0 int")
    got = [(r.idx0, r.total, r.next) for r in listing.page(rows, ["project_id"], ["idx0"], 2, 2).collect()]
    assert got == [(2, 5, 4), (3, 5, 4)]
    out = spark.createDataFrame([(None, []), (None, [("complete", None)]), (None, [("running", None)]), ("e", [])], "error string, outputs array<struct<status:string,error:string>>")
    assert [r[0] for r in out.select(listing.needs_review(F.col("error"), F.col("outputs"))).collect()] == [False, False, True, True]


def test_images(spark):
    page = np.full((40, 30, 3), 250, np.uint8)
    assert images.signals(page)["mean_luma"] >= images.BLANK_LUMA
    page[10:12, 5:9] = 0
    assert images.content_box(page) == (5, 10, 9, 12)
    black = images.threshold(page)
    assert (black == 0).sum() == 8 and (images.threshold(page, 128, invert=True) == 255).sum() == 8
    black[0, 0] = 0
    assert (images.denoise(black) == 0).sum() == 8 and images.zones(images.denoise(black)) == [(5, 10, 4, 2)]
    rows = spark.createDataFrame([(1, 40, 30, 3, page.tobytes()), (2, 40, 30, 3, b"x"), (3, None, None, None, None)], "k int, height int, width int, channels int, data binary")
    found = {r.k: r for r in images.measure(rows, "k").collect()}
    assert found[1].error is None and found[2].error and found[3].error
    done = {r.k: r for r in images.chain(rows, "k", [lambda x: images.crop(x, 5, 10, 9, 12), images.flip]).collect()}
    assert (done[1].height, done[1].width) == (2, 4) and done[2].error


def archive(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, n)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "book.zip").write_bytes(archive(["b/2.png", "a/1.jpg", "a__1.png", "notes.txt", "c/"]))
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    found = archives.entries(archives.files(spark, str(tmp_path)))
    got = [(r.idx0, r.stem, bytes(r.content).decode()) for r in archives.page_images(found).orderBy("idx0").collect()]
    assert got == [(0, "a__1", "a/1.jpg"), (1, "a__1_2", "a__1.png"), (2, "b__2", "b/2.png")]
    assert {(r.entry, r.total) for r in archives.first_names(found, 1).collect()} == {("a/1.jpg", 4)}


def test_packages_are_the_same_bytes_again(spark):
    rows = [("p", 1, "001p001", b"image", "text", [("b.jpg", b"2"), ("a.jpg", b"1")]), ("p", 0, None, b"x", None, None), ("p", 2, "002p002", None, "more", None)]
    frame = spark.createDataFrame(rows, "project_id string, pos int, prefix string, image binary, text string, crops array<struct<name:string,content:binary>>")
    one, two = (packages.build(f, "Book", "2024-01-01").first() for f in (frame, frame.orderBy(F.desc("pos"))))
    assert one.content == two.content and (one.pages, one.crops) == (1, 2)
    with zipfile.ZipFile(io.BytesIO(one.content)) as z:
        assert z.namelist() == ["001p001.png", "001p001.txt", "images/001p001_01.jpg", "images/001p001_02.jpg", "002p002.txt", "pgdp.json"]
        assert z.read("images/001p001_01.jpg") == b"1"


def test_text_of_a_page_takes_time_in_proportion_to_its_words(spark):
    import time

    def page(n):
        # Lines of a thousand words, each word on its own page place.
        return spark.range(n).select(F.lit("p").alias("project_id"), F.lit(None).cast("int").alias("idx0"), F.col("id").alias("word_id"), (F.col("id") % 1000).cast("int").alias("left"), (F.floor(F.col("id") / 1000) * 30).cast("int").alias("top"), F.lit(5).alias("width"), F.lit(18).alias("height"), F.concat(F.lit("w"), F.col("id")).alias("text"), F.lit(False).alias("deleted"))

    words.page_text(page(1000)).collect()
    started = time.monotonic()
    (found,) = words.page_text(page(60_000)).collect()
    assert time.monotonic() - started < 20
    assert (found.project_id, found.idx0) == ("p", None)
    assert found.page_text == "\n".join(" ".join(f"w{k}" for k in range(a, a + 1000)) for a in range(0, 60_000, 1000))


def test_words_without_place_or_text_keep_their_order(spark):
    rows = [("p", 1, 3, 50, 10, 5, 20, "b", False), ("p", 1, 1, None, 10, 5, 20, "a", False), ("p", 1, 2, 60, 10, 5, 20, None, False), ("p", 1, 4, 10, 34, 5, 20, "c", None), ("p", 1, 5, 5, 34, 5, 20, "x", True), ("q", 1, 1, 5, None, 5, 20, "d", False)]
    frame = spark.createDataFrame(rows, "project_id string, idx0 int, word_id long, left int, top int, width int, height int, text string, deleted boolean")
    assert {(r.project_id, r.page_text) for r in words.page_text(frame).collect()} == {("p", "a b\nc"), ("q", "d")}
