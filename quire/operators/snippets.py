"""Snippets: the few words of each page found that show most of a search's phrases."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.querylang import Node, Phrase, fold
from quire.operators.ranking import Query

WIDTH = 15
#: Worth of a phrase's first occurrence in a window, of a further one, and of a window that starts a text or a sentence.
FIRST, AGAIN, TEXT_START, SENTENCE_START = 1000, 1, 120, 100


@functools.lru_cache(200_000)
def _folded(word: str) -> str:
    """The token of a word; words come again and again."""
    return (fold(word) or [""])[0]


def places(where: dict[str, list[int]], phrase: Phrase) -> list[int]:
    """Where a phrase starts in a text, of which ``where`` has the places of each token."""

    def at(slot: tuple[str, bool]) -> list[int]:
        token, prefix = slot
        return sorted(p for t, found in where.items() if t.startswith(token) for p in found) if prefix else where.get(token, [])

    first, *others = (at(s) for s in phrase.slots)
    follow = [set(o) for o in others]
    return [p for p in first if all(p + j in o for j, o in enumerate(follow, 1))]


def matches(node: Node, found: dict[int, list[int]]) -> bool:
    if node.phrase:
        return bool(found[id(node)])
    inside = [matches(c, found) for c in node.children]
    return {"and": all, "or": any, "not": lambda x: x[0] and not x[1], "nothing": lambda _: False}[node.kind](inside)


def window(hits: list[tuple[int, int, int]], n: int, sentences: list[int], width: int) -> int:
    """The first token of the best window; ``hits`` are (place, phrase, tokens), ``sentences`` the tokens that start one.

    Windows start at a hit, and are then moved so that what they show is in the middle, or at the sentence of a hit; of windows
    that are worth the same the first counts.
    """

    at_token = [h[0] for h in hits]

    def worth(start: int) -> tuple[int, int, int]:
        inside = hits[bisect_left(at_token, start) : bisect_left(at_token, start + width)]
        different = len({phrase for _, phrase, _ in inside})
        return different * FIRST + (len(inside) - different) * AGAIN, inside[0][0] if inside else start, inside[-1][0] + inside[-1][2] if inside else start

    best, at = -1, 0
    for place, _, _ in hits:
        value, first, last = worth(place)
        if value > best:
            # Whole numbers are cut towards zero here.
            best, at = value, max(0, min(first - int((width - (last - first)) / 2), n - width))
        if n > width and sentences:
            start = sentences[max(bisect_right(sentences, place) - 1, 0)]
            if start < place:
                value = worth(start)[0] + (TEXT_START if start == 0 else SENTENCE_START)
                if value > best:
                    best, at = value, start
    return at


def snippet(text: str, query: Query, width: int = WIDTH) -> str:
    """``width`` words of a text, with dots where some are left out."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    where: dict[str, list[int]] = {}
    for k, (a, b) in enumerate(spans):
        where.setdefault(_folded(text[a:b]), []).append(k)
    found = {id(leaf): places(where, leaf.phrase) for leaf, _ in query.leaves}
    shown = [k for k, (_, above) in enumerate(query.leaves) if above is not None and all(matches(a, found) for a in above)]
    hits = sorted((p, k, len(query.leaves[k][0].phrase.tokens)) for k in shown for p in found[id(query.leaves[k][0])])
    # Words hold no white space, so what lies between two tells whether a sentence ends there.
    between = [text[b:a] for (_, b), (a, _) in zip([(0, 0), *spans], spans)]
    starts = [k for k, gap in enumerate(between) if not k and not gap.strip() or gap.rstrip()[-1:] in (".", ":") and gap[-1].isspace()]
    at = window(hits, len(spans), starts, width)
    if not spans:
        return text
    last = at + width - 1
    body = text[spans[at][0] if at else 0 : spans[last][1] if last < len(spans) - 1 else len(text)]
    return ("..." if at else "") + body + ("" if last >= len(spans) - 1 else "...")


def with_snippets(found: DataFrame, pages: DataFrame, query: str, key: list[str], text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows of a search with ``snippet``; only the texts of pages found are read on from the join."""
    wanted = Query.of(query)
    rows = found.join(pages.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_text")), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([snippet(t, wanted, width) for t in batch.column("_text").to_pylist()], pa.string())
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, made], names=[*kept.schema.names, "snippet"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return rows.select(*found.columns, "_text").mapInArrow(run, f"{kinds}, snippet string")
