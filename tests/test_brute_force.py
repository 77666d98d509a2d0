"""Registered queries that SQL can't express, against plain Python over the same rows."""

from __future__ import annotations

import re

import pytest

from quire import fixtures as fx
from quire.plans import texts
from quire.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = r"\w+"
QUOTES = str.maketrans("‘’‚‛“”„‟", "''''\"\"\"\"")


def processed(text: str) -> str:
    text = text.translate(QUOTES).replace("—", "--")
    allowed = {x.rstrip("-").lower() for x in texts.ALLOWED}
    text = re.sub(rf"({WORD})-\n({WORD})", lambda m: m[1] + m[2] if m[1].lower() in allowed else m[0], text)
    for scannos in (texts.SCANNOS, {"is": "was"}):
        text = re.sub(rf"{WORD}(?:[-']{WORD})*", lambda m: scannos.get(m[0], m[0]), text)  # noqa: B023
    return re.sub(" ([:;!?])", r"\1", text)


def test_post_processed(spark):
    want = {(r.project_id, r.idx0): processed(r.raw_text) for r in fx.text(spark, FOLDER).collect()}
    assert {(r.project_id, r.idx0): r.page_text for r in QUERIES["post_processed"](spark, FOLDER).collect()} == want
    assert any(t != r for t, r in zip(want.values(), (x.raw_text for x in fx.text(spark, FOLDER).collect())))


def rebuilt(words: list) -> str:
    """Text of a page's words: a word joins the line before it if its middle is near that of the line's smallest word."""
    lines: list[dict] = []
    for w in sorted(words, key=lambda w: (w.top + w.height / 2, w.left, w.word_id)):
        mid = w.top + w.height / 2
        if lines and abs(mid - lines[-1]["mid"]) <= max(1.0, min(lines[-1]["height"], w.height) / 2):
            line = lines[-1]
            if w.height < line["height"]:
                line["height"], line["mid"] = w.height, mid
            line["words"].append(w)
        else:
            lines.append({"height": w.height, "mid": mid, "words": [w]})
    # Words that start at one place keep the order in which they came.
    return "\n".join(" ".join(w.text for w in sorted(line["words"], key=lambda w: w.left)) for line in lines)


def test_page_text_from_words(spark):
    pages: dict = {}
    for w in texts._words(spark, FOLDER).collect():
        if not w.deleted:
            pages.setdefault((w.project_id, w.idx0), []).append(w)
    want = {k: rebuilt(v) for k, v in pages.items()}
    assert {(r.project_id, r.idx0): r.page_text for r in QUERIES["page_text_from_words"](spark, FOLDER).collect()} == want


@pytest.mark.parametrize("width", [15])
def test_search_snippets(spark, width):
    def around(text: str) -> str | None:
        found = text.split()
        plain = [re.sub(r"[^\w]|_", "", w.lower()) for w in found]
        if "idiot" not in plain:
            at = 0
        else:
            at = max(plain.index("idiot") - width // 2, 0)
        return ("..." if at else "") + " ".join(found[at : at + width]) + ("..." if len(found) > at + width else "")

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: around(r.text) for r in docs if "idiot" in r.text}
    assert {r.doc_id: r.snippet for r in QUERIES["search_snippets"](spark, FOLDER).collect()} == want
