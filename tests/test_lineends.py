from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import lineends as E

PUNCT, COMMON = r"[,;:!\?\.\"'\-\(\)]", "s|d|r|er|ed|ing|ly"


def texts(n=300):
    r = random.Random(9)
    parts = ["some-\nthing", "to-\nday", "walk-\ning", "Walk-\nED", "half-\nway", "well-\nknown", "re-\nturned", "a", "in", "1n", "IJ", "J", "toa", "[am", "—", " -- ", "--\n", "\n--", " ;", " ?", "\n", ",", ".'", "(", "under-\nstandings"]
    return ["".join(r.choice(parts) + r.choice([" ", "\n", ", ", ".' ", "", "s ", "ly, ", ".x ", ")\n"]) for _ in range(r.randrange(1, 25))) for _ in range(n)]


def passes(rows, *steps):
    for pattern, replacement in steps:
        rows = [re.sub(pattern, replacement, t, flags=re.IGNORECASE) for t in rows]
    return rows


def one_by_one(first: str, second: str, back: str):
    """A rule as six passes, one for each thing that may follow."""
    tail = ["", f"{PUNCT}{{1,4}}", f"{PUNCT}{{1,4}}\\S+", f"(?:{COMMON})", f"(?:{COMMON}){PUNCT}{{1,4}}", f"(?:{COMMON}){PUNCT}{{1,4}}\\S+"]
    return [(f"{first}({second}{t})[\n ]", back) for t in tail]


RULES = {
    "endings": (lambda c: E.join_endings(c, ["thing", "ing", "ed"]), one_by_one("-\n", "(?:thing|ing|ed)", r"\1\n")),
    "beginnings": (lambda c: E.join_beginnings(c, ["re", "under"]), [(r"(?<=[^\w])(re|under)-\n([^\s]+)[\n ]", r"\1\2\n")]),
    "words": (lambda c: E.join_words(c, {"to": ["day", "night"], "some": ["thing"]}), [*one_by_one(r"(?<=[^\w])(to)-\n", "(?:day|night)", r"\1\2\n"), *one_by_one(r"(?<=[^\w])(some)-\n", "thing", r"\1\2\n")]),
    "words by end": (lambda c: E.join_words_by_end(c, {"way": ["half", "any"]}), one_by_one(r"(?<=[^\w])(half|any)-\n", "way", r"\1\2\n")),
    "hyphens": (lambda c: E.keep_hyphens(c, {"well": ["known"]}), one_by_one(r"(?<=[^\w])(well-)\n", "known", r"\1\2\n")),
    "closing": (E.close_up, [(r" ([:;!\?])", r"\1")]),
    "dashes": (E.tidy_dashes, [(" *— *", "--"), (" *--{1,2} *", "--"), ("(?<!\n)--\n *([^\\s]*) ", "--\\1\n"), ("(?<!\n)\n(--[^\\s]*) ", "\\1\n")]),
}


@pytest.mark.parametrize("name", RULES)
def test_rules_against_passes_one_by_one(spark, name):
    rule, steps = RULES[name]
    rows = texts()
    frame = spark.createDataFrame(list(enumerate(rows)), "k int, t string")
    found = [r.t for r in frame.select("k", rule(F.col("t")).alias("t")).orderBy("k").collect()]
    assert found == passes(rows, *steps) and found != rows


def test_scannos_between_spaces_and_punctuation(spark):
    sides = [(r"(?<=\s)", r"(?=\s)"), (r"(?<=\s)", f"(?={PUNCT}{{1,5}})"), (f"(?<={PUNCT})", r"(?=\s)"), (f"(?<={PUNCT})", f"(?={PUNCT}{{1,5}})")]
    steps = [(f"{a}{pattern}{b}", replacement.replace("$1", r"\1")) for pattern, replacement in E.ALONE for a, b in sides]
    rows = texts()
    frame = spark.createDataFrame(list(enumerate(rows)), "k int, t string")
    found = [r.t for r in frame.select("k", E.replace_alone(F.col("t")).alias("t")).orderBy("k").collect()]
    assert found == passes(rows, *steps) and found != rows
    one = spark.createDataFrame([("so 1n a (J) box, toa 1nner x1n.", None)], "t string, n string").select(E.replace_alone(F.col("t")).alias("t"), E.replace_alone(F.col("n")).alias("n")).first()
    assert tuple(one) == ("so in a (I) box, to a 1nner x1n.", None)
