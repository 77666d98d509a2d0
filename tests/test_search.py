"""The query language and the kept index, compared with SQLite's full-text search over the same pages."""

from __future__ import annotations

import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import search as S
from quire.operators import textindex as T
from quire.operators.querylang import parse

WORDS = "fox dog cat café ſword sword the The of lazy lazier well known O'Brien x1 10 été zebra".split()
QUERIES = (
    "fox", "FOX", "cafe", "sword", '"the fox"', "fox dog", "fox AND dog", "fox OR dog", "fox NOT dog", "fox NOT dog NOT cat", "laz*", '"the laz" *', "(fox OR dog) AND cat", "fox OR dog AND cat", "fox dog NOT cat OR zebra",
    '"well known" OR ete', "fox AND (dog NOT (cat OR zebra))", '"the" + "fox"', "the the", '"fox" "dog"', "z* OR l*", '"" fox', "nothingatall", "fox OR nothingatall", '"of the" NOT laz*', "(fox)", "x1 OR 10",
)


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice([" ", "  ", ", ", "-", "\n"]).join(r.choice(WORDS) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def by_sqlite(pages: list[tuple[str, int, str]], query: str) -> dict:
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(project UNINDEXED, page UNINDEXED, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", [(p, i, (t or "").replace("ſ", "s")) for p, i, t in pages])
    return {(p, i): round(rank, 6) for p, i, rank in con.execute("SELECT project, page, bm25(f) FROM f WHERE f MATCH ?", (query.replace("ſ", "s"),))}


def result(frame) -> dict:
    return {(r["project"], r["page"]): round(r["rank"], 6) for r in frame.collect()}


def frame(spark, pages):
    return spark.createDataFrame(pages, "project string, page long, text string")


@pytest.fixture(scope="module")
def pages():
    return [("ab"[k % 2], k, t) for k, t in enumerate(texts(1, 120))]


@pytest.fixture(scope="module")
def index(spark, pages, tmp_path_factory):
    return T.build(frame(spark, pages), str(tmp_path_factory.mktemp("index")), ["project", "page"], buckets=8)


@pytest.mark.parametrize("query", QUERIES)
def test_kept_index_and_scan_find_what_sqlite_finds(spark, pages, index, query):
    want = by_sqlite(pages, query)
    for found in (T.search(index, query), S.search(frame(spark, pages), query, ["project", "page"])):
        assert result(found) == want


@pytest.mark.parametrize("query", ["", "  ", '"open', "(fox", "fox)", "AND fox", "fox OR", "NOT fox", "fox AND NOT dog", "*", "fox +"])
def test_what_is_not_a_query(query):
    with pytest.raises(ValueError):
        parse(query)


def test_a_query_of_no_word_matches_nothing(index):
    assert T.search(index, '"--"').count() == 0
    assert T.search(index, '"--" OR fox').count() == T.search(index, "fox").count() > 0


def test_project_and_score(index, pages):
    found = T.search(index, "fox", project="a").collect()
    want = {k: v for k, v in by_sqlite(pages, "fox").items() if k[0] == "a"}
    assert {(r["project"], r["page"]): round(r["rank"], 6) for r in found} == want
    assert all(abs(r["score"] - 1 / (1 + abs(r["rank"]))) < 1e-12 and 0 <= r["score"] <= 1 for r in found)


def test_a_search_reads_the_buckets_of_its_words_only(index):
    plan = T.search(index, "fox")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan and "EqualTo(token,fox)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_updates(spark, pages, tmp_path):
    folder, key = str(tmp_path / "index"), ["project", "page"]
    index = first = T.build(frame(spark, pages), folder, key, buckets=8)
    now = {(p, i): t for p, i, t in pages}
    r = random.Random(3)
    for step in range(3):
        changed = {("ab"[k % 2], k): t for k, t in zip(r.sample(range(130), 6), texts(10 + step, 6), strict=True)}
        gone = r.sample(sorted(set(now) - set(changed)), 4)
        index = T.upsert(index, frame(spark, [(*k, t) for k, t in changed.items()]), spark.createDataFrame(gone, "project string, page long"))
        now = {k: t for k, t in (now | changed).items() if k not in gone}
        rows = [(*k, t) for k, t in now.items()]
        for query in ("fox", '"the fox" OR laz*', "dog NOT cat"):
            assert result(T.search(index, query)) == by_sqlite(rows, query)
    # The index as it was is still there, until it is cleared.
    assert result(T.search(first, "fox")) == by_sqlite(pages, "fox")
    T.vacuum(index)
    assert result(T.search(T.opened(spark, folder), "fox")) == by_sqlite([(*k, t) for k, t in now.items()], "fox")


def test_an_update_writes_few_buckets(spark, pages, tmp_path):
    index = T.build(frame(spark, pages), str(tmp_path / "index"), ["project", "page"], buckets=64)
    after = T.upsert(index, frame(spark, [("c", 500, "quokka")]))
    assert sorted(v for b, v in after.postings_versions.items() if index.postings_versions.get(b) != v) == [2]
    assert (after.n, after.total) == (index.n + 1, index.total + 1)


def test_repair(spark, pages, tmp_path):
    index = T.build(frame(spark, pages), str(tmp_path / "index"), ["project", "page"], buckets=8)
    now = [(p, i, "new words" if i == 7 else t) for p, i, t in pages if i != 9] + [("b", 900, "added page")]
    want = {("b", 7): "changed", ("b", 9): "orphan", ("b", 900): "absent"}
    assert {(r["project"], r["page"]): r["reason"] for r in T.missing(index, frame(spark, now)).collect()} == want
    after = T.repaired(index, frame(spark, now))
    assert T.missing(after, frame(spark, now)).isEmpty()
    assert result(T.search(after, "fox OR added")) == by_sqlite(now, "fox OR added")


def test_null_empty_and_no_pages(spark, tmp_path):
    rows = [("a", 1, None), ("a", 2, ""), ("a", 3, "one fox")]
    index = T.build(frame(spark, rows), str(tmp_path / "some"), ["project", "page"])
    assert result(T.search(index, "fox")) == by_sqlite(rows, "fox")
    none = T.build(frame(spark, []), str(tmp_path / "none"), ["project", "page"])
    assert T.search(none, "fox").count() == 0 and none.pages().count() == 0
    assert result(T.search(T.upsert(none, frame(spark, rows)), "fox")) == by_sqlite(rows, "fox")
    assert index.postings().select(F.max("length")).first()[0] == 2


@pytest.mark.parametrize("query", QUERIES)
def test_snippets_are_those_of_sqlite(spark, query):
    from quire.operators.ranking import Query
    from quire.operators.snippets import snippet, with_snippets

    r = random.Random(11)
    rows = [("a", k, " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", ": ", "\n"]) for _ in range(r.randrange(1, 70))).strip()) for k in range(150)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(project UNINDEXED, page UNINDEXED, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", [(p, i, t.replace("ſ", "s")) for p, i, t in rows])
    want = dict(con.execute("SELECT page, snippet(f, 2, '', '', '...', 15) FROM f WHERE f MATCH ?", (query.replace("ſ", "s"),)))
    text = {i: t.replace("ſ", "s") for _, i, t in rows}
    assert {i: snippet(text[i], Query.of(query)) for i in want} == want
    if query == "fox dog":
        pages = frame(spark, rows)
        found = with_snippets(S.search(pages, query, ["project", "page"]), pages, query, ["project", "page"])
        assert {r["page"]: r["snippet"].replace("ſ", "s") for r in found.collect()} == want


def test_tokens_are_grouped_by_bounded_parts(monkeypatch):
    """Whatever the rows of a batch; a long page goes by itself, and a page without tokens has no rows."""
    monkeypatch.setattr(T, "GROUPED", 10)
    pages = [["a", "b", "a"], [], ["b"] * 4, ["c"] * 25, ["a", "c"], ["d"] * 10, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages, pa.list_(pa.string()))], names=["id", "_t"]).slice(1)
    parts = list(T._parts(batch))
    assert [p.column("id").to_pylist() for p in parts] == [[1, 2], [3], [4], [5, 6]]
    rows = [tuple(r.values()) for part in T._grouped(iter([batch])) for r in part.to_pylist()]
    assert sorted(rows) == sorted((i, len(t), w, [k for k, x in enumerate(t) if x == w]) for i, t in enumerate(pages) if i for w in set(t))
