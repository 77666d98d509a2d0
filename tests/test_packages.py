from __future__ import annotations

import io
import json
import random
import re
import tracemalloc
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.sources import archives, packages, zipfiles

SUBMISSION = "project_id string, pos int, prefix string, image binary, text string, crops array<struct<name:string,content:binary>>"
FIRST = "project_id string, idx0 int, prefix string, source_stem string, page_type string, ignore boolean, splits array<string>, outputs array<struct<reading_order:int,full_prefix:string,image:binary,text:string>>, regions array<struct<index:int,output_format:string,content:binary>>"


def rows(n: int = 60):
    r = random.Random(4)
    return [(f"p{k % 3}", k, None if k % 7 == 0 else f"{k:03d}p", r.randbytes(200) if k % 5 else None, f"text é {k}" if k % 4 else None, [(f"c{j}.jpg", bytes([j])) for j in range(k % 3, -1, -1)] if k % 2 else None) for k in range(n)]


def opened(content: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    assert z.testzip() is None
    return z


def test_same_bytes_from_any_partitioning(spark, tmp_path):
    frame = spark.createDataFrame(rows(), SUBMISSION)
    want = None
    for n in (1, 8):
        parts = packages.archive_parts(packages.submission(frame.repartition(n, F.rand(n)), "Büch", "2024"))
        saved = {r.project_id: r for r in packages.save(parts, str(tmp_path / str(n))).collect()}
        files = {p.name: p.read_bytes() for p in (tmp_path / str(n)).iterdir()}
        assert want in (None, files) and set(files) == {"p0.zip", "p1.zip", "p2.zip"}
        want = files
    whole = {f"{r.project_id}.zip": bytes(r.content) for r in packages.build(frame, "Büch", "2024").collect()}
    assert whole == want
    for name, content in want.items():
        z = opened(content)
        assert (saved[name[:-4]].size_bytes, saved[name[:-4]].file_count) == (len(content), len(z.namelist()))
        told = json.loads(z.read("pgdp.json"))
        mine = [r for r in rows() if r[0] == name[:-4] and r[2]]
        assert (told["book_name"], told["page_count"], [p["prefix"] for p in told["pages"]]) == ("Büch", sum(r[3] is not None for r in mine), [r[2] for r in mine])
        for r in mine:
            assert r[3] is None or z.read(f"{r[2]}.png") == r[3]
            assert r[4] is None or z.read(f"{r[2]}.txt").decode() == r[4]
            assert [z.read(f"images/{r[2]}_{k:02d}.jpg") for k in range(1, len(r[5] or []) + 1)] == sorted(c for _, c in r[5] or [])


def test_no_group_holds_the_bytes_of_a_project(spark):
    parts = packages.archive_parts(packages.submission(spark.createDataFrame(rows(), SUBMISSION), "b", "2024"))
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "FlatMapGroupsInPandas" not in plan
    # What is gathered are sizes, names and the fields of manifests.
    gathered = [line for line in plan.splitlines() if "collect_list" in line or "Window" in line]
    assert gathered and not any(re.search(r"\b(bytes|image|data)#", line) for line in gathered)


def test_first_package(spark):
    one = [("p", 0, "c000", "s0", "cover", False, ["a", "b"], [(1, "c000b", b"two", None), (0, "c000a", b"one", "first")], [(2, "png", b"r"), (3, "jpg", None)])]
    one += [("p", 1, "", "s1", "cover", False, [], [(0, "x", b"later cover", None)], []), ("p", 2, "p2", "s2", "normal", True, [], [(0, "gone", b"x", "x")], []), ("p", 3, "p3", "s3", "normal", None, [], [(0, "p3", None, "only text")], [])]
    z = opened(packages.content(packages.archive_parts(packages.first_package(spark.createDataFrame(one, FIRST), "b", "2024"))).first().content)
    assert z.namelist() == ["c000a.png", "cover.png", "c000a.txt", "c000b.png", "images/c000_02.png", "x.png", "p3.txt", "pgdp.json"]
    assert z.read("cover.png") == b"one"
    told = json.loads(z.read("pgdp.json"))
    assert (told["cover_prefix"], told["page_count"], told["illustration_count"], [p["idx0"] for p in told["pages"]]) == ("c000", 3, 1, [0, 1, 3])
    two = [("p", 5, "", "stem", "cover", False, [], [(0, "x", b"i", None)], [])]
    z = opened(packages.content(packages.archive_parts(packages.first_package(spark.createDataFrame(two, FIRST), "b", "2024"))).first().content)
    assert json.loads(z.read("pgdp.json"))["cover_prefix"] == "stem"


def test_archives_beyond_32_bits():
    # The directory's forms alone: an archive of 4 GiB isn't made here.
    data = packages._listed("a", 1, 2, 3, 1 << 33)
    assert data[42:46] == b"\xff" * 4 and int.from_bytes(data[-8:], "little") == 1 << 33
    end = packages._end(70_000, 100, 1 << 33)
    assert len(end) == 56 + 20 + 22 and end[-12:-10] == b"\xff\xff" and int.from_bytes(end[48:56], "little") == 1 << 33
    many = spark_free_archive(70_000)
    assert len(zipfile.ZipFile(io.BytesIO(many)).namelist()) == 70_000


def spark_free_archive(n: int) -> bytes:
    body, directory = b"", []
    out = io.BytesIO()
    for k in range(n):
        record, crc, packed = packages._entry(f"{k}.txt", b"x")
        directory.append(packages._listed(f"{k}.txt", crc, packed, 1, out.tell()))
        out.write(record)
    body, told = out.getvalue(), b"".join(directory)
    return body + told + packages._end(n, len(told), len(body))


def test_records_of_good_and_bad_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("folder/", "")
        z.writestr("pgdp.json", json.dumps({"project_id": "q", "page_count": 7, "book_name": "B", "built_at": "then", "other": 1}))
    with zipfile.ZipFile(tmp_path / "odd.zip", "w") as z:
        z.writestr("pgdp.json", "{broken")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    cut = (tmp_path / "good.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(cut[: len(cut) // 2])
    files = archives.files(spark, str(tmp_path)).select("path", "content").union(spark.createDataFrame([("/x/empty.zip", b"")], "path string, content binary"))
    name = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    assert {r.n: r.file_count for r in archives.archive_records(files).select(name.alias("n"), "file_count").collect()} == {"good": 3, "odd": 1, "bad": 0, "empty": 0, "cut": 0}
    assert {(r.pos, r.entry, r.size) for r in archives.listing(files).where("path like '%good%'").collect()} >= {(0, "a.txt", 5), (1, "folder/", 0)}
    told = {r.n: (r.project, r.pages, r.canvas, r.built, r.files) for r in archives.package_manifests(files, name).select(name.alias("n"), "*").collect()}
    assert told["good"] == ("q", 7, "B", "then", 3) and told["odd"] == ("odd", 0, "", "", 1) and told["cut"] == ("cut", 0, "", "", 0)


def test_entries_go_in_batches_of_bounded_size(spark, tmp_path):
    from quire.sources.archives import ROWS, bounded, entries, files

    sizes = [1] * (ROWS + 1) + [10, 3, 3, 50]
    cut = [[n for (n,) in rows] for rows in bounded(((n,) for n in sizes), lambda row: row[0], ROWS + 5)]
    assert [n for rows in cut for n in rows] == sizes and len(cut[0]) == ROWS and all(sum(rows[:-1]) < ROWS + 5 for rows in cut)
    # Many small entries are no batch each, and only what is asked for is unpacked.
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(3000):
            z.writestr(f"{k}.txt", str(k))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    found = entries(files(spark, str(tmp_path)))
    assert sorted((r.pos, r.entry, r.size, r.content) for r in found.collect()) == [(k, f"{k}.txt", len(str(k)), str(k).encode()) for k in range(3000)]
    assert [(r.entry, bytes(r.content)) for r in entries(files(spark, str(tmp_path)), ["7.txt", "none"]).collect()] == [("7.txt", b"7")]


def test_a_manifest_is_made_and_compressed_in_parts(spark, tmp_path, monkeypatch):
    """A row held all pages of a project, and a task all of its archive's bytes."""
    monkeypatch.setattr(packages, "SLICE", 2)
    entries = packages.submission(spark.createDataFrame(rows(), SUBMISSION), "Büch", "2024")
    told = {r.project_id: (r.n, r.most) for r in entries.where("name = 'pgdp.json'").groupBy("project_id").agg(F.count("*").alias("n"), F.max(F.length("data")).alias("most")).collect()}
    assert all(n > 10 and most < 600 for n, most in told.values()) and len(told) == 3
    parts = packages.archive_parts(entries)
    assert parts.where("kind = 0").groupBy("project_id").agg(F.countDistinct("start")).first()[1] > 5
    saved = {r.project_id: r for r in packages.save(parts, str(tmp_path)).collect()}
    assert {p.name for p in tmp_path.iterdir()} == {"p0.zip", "p1.zip", "p2.zip"}
    assert {r.project_id: bytes(r.content) for r in packages.content(parts).collect()} == {p.stem: p.read_bytes() for p in tmp_path.iterdir()}
    for project, r in saved.items():
        z = opened((tmp_path / f"{project}.zip").read_bytes())
        mine = [x for x in rows() if x[0] == project and x[2]]
        pages = [{"prefix": x[2], "has_image": x[3] is not None, "has_text": x[4] is not None, "illustration_count": len(x[5] or [])} for x in mine]
        found = {"book_name": "Büch", "project_id": project, "built_at": "2024", "page_count": sum(p["has_image"] for p in pages), "illustration_count": sum(p["illustration_count"] for p in pages), "pages": pages}
        assert z.read("pgdp.json").decode() == json.dumps(found, indent=2) and z.namelist()[-1] == "pgdp.json" and r.file_count == len(z.namelist())


def test_check_sums_of_parts():
    r = random.Random(1)
    for n, m in ((0, 0), (0, 5), (7, 0), (1, 1), (300, 70_000)):
        a, b = r.randbytes(n), r.randbytes(m)
        assert packages._crc_of_both(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_a_file_counts_as_saved_when_all_its_ranges_are_there(tmp_path):
    data = random.Random(2).randbytes(5000)
    ranges = [{"start": a, "length": b - a, "crc": zlib.crc32(data[a:b])} for a, b in ((0, 2000), (2000, 2001), (2001, 5000))]
    path = tmp_path / "p.zip"
    assert packages._digest(str(path), ranges) is None
    for content, whole in ((data, True), (data[:4000], False), (data + b"x", False), (data[:2000] + b"\0" + data[2001:], data[2000] == 0), (b"\0" * 2001 + data[2001:], False)):
        path.write_bytes(content)
        assert (packages._digest(str(path), ranges) is not None) == whole


def test_archives_are_read_where_they_lie(spark, tmp_path):
    """Over 4 GiB, nearly all of it a hole: no row holds that, and Spark's reader of whole files refuses 2 GiB."""
    at, records, listed = 1 << 32, [], []
    for k in range(5):
        record, crc, packed = packages._entry(f"{k}é.txt", str(k).encode() * 3000)
        listed.append(packages._listed(f"{k}é.txt", crc, packed, 3000, at))
        records.append((at, record))
        at += len(record) + 7
    told = b"".join(listed)
    with open(tmp_path / "far.zip", "wb") as f:
        for place, record in records:
            f.seek(place)
            f.write(record)
        f.seek(at)
        f.write(told + packages._end(5, len(told), at))
    found = zipfiles.files(spark, str(tmp_path))
    assert [(r.pos, r.entry, r.size, r.place) for r in zipfiles.listing(found).orderBy("pos").collect()] == [(k, f"{k}é.txt", 3000, records[k][0]) for k in range(5)]
    assert sorted((r.entry, bytes(r.content)) for r in zipfiles.entries(found, F.col("entry") != "1é.txt").collect()) == [(f"{k}é.txt", str(k).encode() * 3000) for k in (0, 2, 3, 4)]


def test_archives_read_where_they_lie_as_in_rows(spark, tmp_path):
    many = spark_free_archive(3000)
    (tmp_path / "many.zip").write_bytes(many)
    (tmp_path / "before.zip").write_bytes(b"what comes first" + many)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "cut.zip").write_bytes(many[: len(many) // 2])
    big = {"book_name": "B[", "pages": [{"a": "}" * k, "b": ["\\", "]"]} for k in range(500)], "page_count": 9, "built_at": "th\u00e9n", "project_id": 'q"{'}
    for name, told in (("good", json.dumps(big)), ("odd", "{broken"), ("half", json.dumps(big)[:5000])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED if name == "good" else zipfile.ZIP_STORED) as z:
            z.writestr("folder/", "")
            z.writestr("a.txt", "hello" * 1000)
            z.writestr("pgdp.json", told)
            z.comment = b"PK comment"
    whole, there = archives.files(spark, str(tmp_path)).select("path", "content"), zipfiles.files(spark, str(tmp_path))
    name = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    rows_of = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    assert rows_of(zipfiles.archive_records(there).select("path", "sha256", "size_bytes", "file_count")) == rows_of(archives.archive_records(whole).select("path", "sha256", "size_bytes", "file_count"))
    told = rows_of(zipfiles.package_manifests(there, name).drop("path"))
    assert told == rows_of(archives.package_manifests(whole, name).drop("path")) and ('q"{', 9, "B[", "thén", 3) in {r[:5] for r in told}
    columns = ["path", "entry", "pos", "size", "content"]
    assert rows_of(zipfiles.entries(there).select(*columns)) == rows_of(archives.entries(whole).select(*columns))
    # An entry that was changed is neither left out nor given.
    (tmp_path / "many.zip").write_bytes(many.replace(b"1234.txt" + packages._entry("1234.txt", b"x")[0][38:], b"1234.txt" + packages._entry("1234.txt", b"y")[0][38:]))
    with pytest.raises(Exception, match="check sum"):
        zipfiles.entries(there).collect()


def test_a_directory_is_read_entry_by_entry(tmp_path):
    (tmp_path / "a.zip").write_bytes(spark_free_archive(70_000))
    with open(tmp_path / "a.zip", "rb") as f:
        tracemalloc.start()
        try:
            n = sum(1 for _ in zipfiles.directory(f))
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
    assert n == 70_000 and most < 1e6, most


def test_outer_values_of_json_in_blocks():
    told = {"a": 'x"[{\\', "b": [1, {"c": "]}"}, []], "d": {"e": ["\\\""]}, "f": None, "g": 1.5, "é": "ü]", "h": [], "i": True}
    for text in (json.dumps(told, ensure_ascii=False), json.dumps(told, indent=2)):
        raw = text.encode()
        for n in (1, 2, 3, 7, 1000):
            found = zipfiles.outer(raw[k : k + n] for k in range(0, len(raw), n))
            assert json.loads(found) == {k: None if isinstance(v, dict | list) else v for k, v in told.items()}
    assert zipfiles.outer([b'{"a": [1, {']) == b'{"a": '
