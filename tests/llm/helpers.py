from __future__ import annotations

import random

TESTDATA = "/root/testdata"
#: Names that operators use inside; input columns of these names must not disturb them.
CLASHING = ("t", "w", "h", "n", "x", "at", "a", "b", "key", "class", "prefix", "runs", "length", "salt", "number", "score", "label", "features", "item_id", "piece", "n_lines", "sequence_id", "component_id", "host", "kept", "base", "_d", "_row")


def documents(spark, rows):
    """(doc_id, text) rows with many more columns."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *["junk"] * len(CLASHING)) for i, t in rows], f"doc_id long, text string, {extra}")


def awkward():
    """Nulls, empty and blank texts, repeated rows and ids, and a very long text."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three"), (None, "a null id"), (None, None), (6, long), (7, "é😀 " * 40), (4, "other text of the same id")]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def words(text: str | None) -> list[str]:
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")
