from __future__ import annotations

import random

import pytest

from quire.llm.lines import line_dedup
from tests.llm.helpers import awkward, documents, words


def brute(rows, min_words):
    """Text of each (doc_id, text) after deleting every longest run that occurs earlier; distinct ids only."""
    corpus = []
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        corpus.append((i, lines, [k for k, x in enumerate(lines) if words(x)]))
    deleted: dict[int, set[int]] = {}
    for d, (i, lines, full) in enumerate(corpus):
        for p in range(len(full)):
            best = 0
            for e, (_, other, places) in enumerate(corpus[: d + 1]):
                for q in range(len(places) if e < d else p):
                    n = 0
                    while p + n < len(full) and q + n < len(places) and lines[full[p + n]] == other[places[q + n]]:
                        n += 1
                    best = max(best, n)
            if best and sum(len(words(lines[k])) for k in full[p : p + best]) >= min_words:
                deleted.setdefault(i, set()).update(range(full[p], full[p + best - 1] + 1))
    return {i: "\n".join(x for k, x in enumerate(lines) if k not in deleted.get(i, ())) for i, lines, _ in corpus}


@pytest.mark.parametrize(("seed", "least"), [(0, 1), (1, 6)])
def test_deletes_what_brute_force_deletes(spark, seed, least):
    r = random.Random(seed)
    lines = ["alpha beta gamma delta", "one two three", "x", "", "long line of seven words here now", "  "]
    rows = [(k, "\n".join(r.choice(lines) if r.random() < 0.8 else f"unique {r.random()}" for _ in range(r.randrange(1, 14)))) for k in range(25)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + "\n" + rows[0][1])]
    found = {x["doc_id"]: x["text"] for x in line_dedup(documents(spark, rows), least).select("doc_id", "text").collect()}
    assert found == brute(rows, least)


def test_short_lines_of_many_documents_go(spark):
    # Twice in the last document, and beside a short line of few documents.
    rows = [(k, f"unique {k}\nshare this page\n" + ("seldom said" if k % 4 == 0 else f"other {k}")) for k in range(60)]
    rows.append((60, "share this page\nseldom said\n\nshare this page"))
    found = {x["doc_id"]: x["text"] for x in line_dedup(documents(spark, rows)).collect()}
    assert found == {k: x if k == 0 else "seldom said\n" if k == 60 else x.replace("share this page\n", "") for k, x in rows}


def test_many_equal_lines_in_one_document(spark):
    # 20,000 equal lines overlap with themselves; alternating ones leave half of the lines.
    line = "a line of words that is said again and again"
    rows = [(1, "\n".join([line] * 20_000)), (2, "\n".join(f"own {k}\n{line}" for k in range(5_000)))]
    found = {x["doc_id"]: x["text"] for x in line_dedup(documents(spark, rows)).collect()}
    assert found == {1: line, 2: "\n".join(f"own {k}" for k in range(5_000))}


def test_ids_of_any_type_and_repeated_rows(spark):
    text = "first line of ten words which is said again below"
    rows = [("b", text), ("a", text + "\n\nx"), ("a", text + "\n\nx"), (None, "x\n" + text)]
    found = sorted((r["doc_id"] or "", r["text"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert found == [("", "x\n" + text), ("a", "\nx"), ("a", "\nx"), ("b", "")]


def test_counts_and_edges(spark):
    rows = awkward() + [(8, "first line of ten words which is said again below\nb\nfirst line of ten words which is said again below")]
    out = line_dedup(documents(spark, rows))
    assert "n" in out.columns and out.columns.count("n_lines") == 1
    found = out.collect()
    assert len(found) == len(rows)
    by = {x["doc_id"]: x for x in found}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0
    assert by[8]["text"].endswith("\nb") and (by[8]["n_lines"], by[8]["n_deleted"]) == (3, 1)
    assert by[6]["text"] == dict(rows)[6]
    assert line_dedup(documents(spark, [])).count() == 0
