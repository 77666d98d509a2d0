"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at a few counts of a document and votes good (1), votes bad (0) or abstains (null).
Nobody tells the operator which votes are right.  It assumes that rules err independently given the
true class and estimates, by expectation-maximisation, the share of good documents and each rule's
accuracy on either class, from the documents that pass the base rules, since the others are decided.  A
document is kept if its posterior probability of being good is at least ``threshold``.  A rule whose bad votes
don't go with those of others, such as a few repeated lines, turns out to say little, and a document that only
such rules blame is kept.  Votes of a handful of rules have at most ``3 ** len(RULES)`` patterns, so EM runs on a
table of pattern counts whose size does not depend on the corpus; the counts cover every document.

Edge cases: a null or blank text has no words, fails the base rules and is not kept.  Repeated rows and
ties in ``doc_id`` are separate rows.  An empty table gives an empty result.  Only ``doc_id`` and ``text``
are read, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import WORD, materialize, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ITERATIONS = 25
THRESHOLD = 0.5
#: Where EM starts: most documents are good, rules seldom blame those and see some of the others.
SHARE, SPARED, CAUGHT = 0.8, 0.95, 0.4


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


#: Each rule's vote from the counts of ``counts()``: good within usual values, bad beyond wider ones.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _vote(F.col("n_words") >= 100, F.col("n_words") < 50),
    "word_length": lambda: _vote(_ratio("word_chars", "n_words").between(4.5, 6.0), ~_ratio("word_chars", "n_words").between(4.3, 6.5)),
    "symbols": lambda: _vote(F.col("n_symbols") == 0, _ratio("n_symbols", "n_words") > 0.02),
    "dup_lines": lambda: _vote((F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0), _ratio("n_dup_lines", "n_lines") > 0.1),
    "repeats": lambda: _vote((F.col("n_words") >= 2 * WINDOW) & (F.col("n_repeat_words") == 0), _ratio("n_repeat_words", "n_words") > 0.05),
    "capitals": lambda: _vote((_ratio("n_upper", "word_chars") > 0.005) & (_ratio("n_upper", "word_chars") < 0.04), ~_ratio("n_upper", "word_chars").between(0.002, 0.06)),
    "line_ends": lambda: _vote(_ratio("n_ended_lines", "n_lines") >= 0.98, (F.col("n_lines") > 0) & (_ratio("n_ended_lines", "n_lines") < 0.9)),
    "few_line_ends": lambda: _vote(_ratio("n_ended_lines", "n_lines") > 0.6, (F.col("n_lines") > 0) & (_ratio("n_ended_lines", "n_lines") < 0.2)),
}


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each document: words, their characters, symbols, lines, repeated lines and windows."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike(WORD))
    out = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t")).select("doc_id", "t", words(F.col("t")).alias("w"), lines.alias("l"))
    # Hashes of 8 words are built by doubling; each array is used twice in the step after it, so that Spark computes it once.
    out = out.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    pair = lambda step: lambda x, i: F.xxhash64(x, F.get(F.col("h"), i + step))
    for step in (1, 2, 4):
        out = out.withColumn("h", F.transform("h", pair(step)))
    out = out.withColumn("h", F.slice("h", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))
    return out.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), _covered(F.col("h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter("l", lambda x: x.rlike(r"[.!?:;\"'»”][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended_lines"),
    )


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: windows sorted by hash, then the covered stretch of their places."""

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), body)[0]

    def places(s: Column) -> Column:
        same = lambda x, i, step: F.coalesce(F.get(s, i + step)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.when(i > 0, same(x, i, -1)).otherwise(False) | same(x, i, 1)), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: F.aggregate(places(s), start, step)["n"])


def fit(votes: DataFrame, rules: list[str], iterations: int = ITERATIONS) -> dict:
    """Share of good documents and, by rule, the share of right votes on good and on bad documents.

    The driver gets the counts of vote patterns, ``3 ** len(rules)`` rows at most for any corpus.
    """
    patterns = [(r[:-1], r["count"]) for r in votes.groupBy(*rules).count().collect()]
    total = sum(n for _, n in patterns)
    model = {"share": SHARE, "good": [SPARED] * len(rules), "bad": [CAUGHT] * len(rules)}
    for _ in range(iterations if total else 0):
        share = 0.0
        # One vote each way keeps a rule that never errs, or never votes, off 0 and 1.
        right = {"good": [[1.0, 2.0] for _ in rules], "bad": [[1.0, 2.0] for _ in rules]}
        for pattern, n in patterns:
            good = n * _probability(model, pattern)
            share += good / total
            for k, vote in enumerate(pattern):
                if vote is not None:
                    for name, weight, meant in (("good", good, 1), ("bad", n - good, 0)):
                        right[name][k][0] += weight * (vote == meant)
                        right[name][k][1] += weight
        model = {name: [a / b for a, b in found] for name, found in right.items()}
        model["share"] = min(max(share, 1e-6), 1 - 1e-6)
    return model


def _weights(model: dict) -> list[tuple[float, float]]:
    """By rule, what a good and a bad vote add to the log odds."""
    return [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(model["good"], model["bad"], strict=True)]


def _probability(model: dict, pattern: tuple) -> float:
    odds = math.log(model["share"] / (1 - model["share"]))
    odds += sum((bad, good)[v] for v, (good, bad) in zip(pattern, _weights(model), strict=True) if v is not None)
    return 1 / (1 + math.exp(-odds))


def posterior(model: dict, rules: list[str]) -> Column:
    """Probability of a good document, given the votes in the columns ``rules``."""
    odds = F.lit(math.log(model["share"] / (1 - model["share"])))
    for rule, (good, bad) in zip(rules, _weights(model), strict=True):
        odds = odds + F.when(F.col(rule) == 1, good).when(F.col(rule) == 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, iterations: int = ITERATIONS) -> DataFrame:
    """One row per document: counts, ``base_failed``, every rule's vote, ``p_good`` and ``kept``."""
    names = [f"vote_{x}" for x in RULES]
    voted = materialize(counts(docs, doc_id, text).select("*", *(rule().alias(f"vote_{name}") for name, rule in RULES.items())))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    model = fit(voted.where(~failed), names, iterations)
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("p_good", posterior(model, names))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )
