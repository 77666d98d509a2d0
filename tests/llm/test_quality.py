from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import quality
from quire.llm._common import read
from quire.llm.queries import QUERIES
from tests.llm.helpers import TESTDATA, awkward, documents, prose, words


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    repeated = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def same(found, texts):
    for r in found:
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_base_against_brute_force(spark):
    folder = f"{TESTDATA}/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in read(spark, folder, "documents").select("doc_id", "text").collect()}
    found = QUERIES["op2_quality_rules"](spark, folder).collect()
    assert len(found) == len(texts)
    same(found, texts)
    assert found[0].asDict().keys() >= {"doc_id", "n_words", "kept"}


@pytest.fixture(scope="module")
def judged(spark):
    folder = f"{TESTDATA}/sf0.01"
    return QUERIES["op2_quality_rules"](spark, folder).toPandas(), {r["doc_id"]: r["quality"] for r in read(spark, folder, "labels").collect()}


def test_rules_agree_with_labels(judged):
    found, labels = judged
    kept = dict(zip(found["doc_id"], found["kept"], strict=True))
    # As many as if all rules of old had to pass; the others fail the base rules or have one bad vote only.
    assert len(labels) == 399 and sum(kept[i] == bool(q) for i, q in labels.items()) >= 391
    passed = set(found["doc_id"][~found["base_failed"]])
    assert sum(kept[i] == bool(q) for i, q in labels.items() if i in passed) / len(passed & labels.keys()) >= 0.99


def test_not_all_rules_must_pass(judged):
    found = judged[0][~judged[0]["base_failed"]]
    blamed = (found[[f"vote_{x}" for x in quality.RULES]] == 0).any(axis=1)
    assert 0 < found["kept"][blamed].sum() < blamed.sum()


def test_posterior_against_brute_force_em(judged):
    # Document by document, in probabilities instead of pattern counts and log odds.
    found = judged[0]
    votes = found[[f"vote_{x}" for x in quality.RULES]].to_numpy(float)
    fitted = votes[~found["base_failed"].to_numpy()]
    share, good, bad = quality.SHARE, np.full(votes.shape[1], quality.SPARED), np.full(votes.shape[1], quality.CAUGHT)

    def probability(v):
        of_good = share * np.prod(np.where(np.isnan(v), 1, np.where(v == 1, good, 1 - good)), axis=1)
        of_bad = (1 - share) * np.prod(np.where(np.isnan(v), 1, np.where(v == 0, bad, 1 - bad)), axis=1)
        return of_good / (of_good + of_bad)

    there = ~np.isnan(fitted)
    for _ in range(quality.ITERATIONS):
        p = probability(fitted)[:, None]
        share = p.mean()
        good, bad = ((w * (fitted == meant)).sum(0) + 1 for w, meant in ((p, 1), (1 - p, 0)))
        good, bad = good / ((p * there).sum(0) + 2), bad / (((1 - p) * there).sum(0) + 2)
    assert np.allclose(probability(votes), found["p_good"], atol=1e-9)


def test_edges(spark):
    rows = [r for r in awkward() if r[0] != 4] + [(10, prose(1, 30) + " " + prose(1, 30)), (11, "a b c d e f g h i " * 3)]
    found = quality.quality_rules(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    same([r for r in found if r["doc_id"] is not None], dict(rows))
    assert quality.quality_rules(documents(spark, [])).count() == 0
