from __future__ import annotations

import random
import re

from quire.llm import decontamination
from quire.llm._common import read
from tests.llm.helpers import TESTDATA, awkward, documents, prose


def tokens(text):
    return [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text or "")]


def smith_waterman(a, b):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[j - 1] - 1)
        best, above = max(best, *row), row
    return best / (2 * len(a)) if a else 0.0


def test_against_all_alignments(spark):
    folder = f"{TESTDATA}/sf0.001"
    docs, items = read(spark, folder, "documents").select("doc_id", "text").collect(), read(spark, folder, "benchmark").collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark")).collect()}
    words = {r["item_id"]: tokens(r["text"]) for r in items}
    want = {}
    for r in docs:
        w = tokens(r["text"])
        for i, x in words.items():
            # No alignment reaches the threshold with fewer shared words.
            if sum(t in set(w) for t in x) >= 0.4 * len(x) and (s := smith_waterman(x, w)) >= decontamination.THRESHOLD:
                want[r["doc_id"], i] = s
    assert want and found.keys() == want.keys()
    assert all(abs(found[k] - s) < 0.02 for k, s in want.items())


def test_edited_copies_are_found_and_others_left(spark):
    r = random.Random(2)
    items = [(k, prose(500 + k, 40, 5000)) for k in range(20)]
    rows = [(k, prose(k, 120, 5000)) for k in range(60)]
    for k, text in items:
        w = text.split()
        for _ in range(6):
            at = r.randrange(len(w))
            r.choice([lambda: w.pop(at), lambda: w.insert(at, "more"), lambda: w.__setitem__(at, "other")])()
        rows.append((100 + k, f"{prose(900 + k, 50, 5000)} {' '.join(w).upper()}, {prose(950 + k, 50, 5000)}"))
    bench = spark.createDataFrame([(*x, "junk") for x in items], "item_id long, text string, score string")
    found = {(x["doc_id"], x["item_id"]) for x in decontamination.decontaminate(documents(spark, rows), bench).collect()}
    assert found == {(100 + k, k) for k in range(20)}
    assert found == {(x["doc_id"], x["item_id"]) for x in decontamination.decontaminate(documents(spark, rows), bench, block=50).collect()}


def test_an_edit_every_six_words_against_all_alignments(spark):
    # Each item leaked once or edited only, with and without exact copies beside it.
    items = [(k, prose(700 + k, 16 + k, 5000)) for k in range(24)]
    rows = [(k, prose(k, 120, 5000)) for k in range(20)]
    for k, text in items:
        edited = " ".join("other" if i % 6 == 5 else w for i, w in enumerate(text.split()))
        rows.append((100 + k, f"{prose(900 + k, 50, 5000)} {edited} {prose(950 + k, 50, 5000)}"))
        rows += [(200 + 3 * k + c, f"{text} {prose(990 + k, 30, 5000)}") for c in range(k % 3)]
    want = {(d, k): s for d, text in rows for k, x in items if (s := smith_waterman(tokens(x), tokens(text))) >= decontamination.THRESHOLD}
    assert {(100 + k, k) for k, _ in items} <= want.keys()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in decontamination.decontaminate(documents(spark, rows), bench).collect()} == want


def test_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (4, "two"), (None, "a null id")], "item_id long, text string")
    rows = documents(spark, awkward())
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.decontaminate(rows, bench).collect()}
    assert found[4, 3] == found[5, 3] == found[4, 4] == 1.0
    assert decontamination.decontaminate(rows, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(rows.limit(0), bench).count() == 0
