from __future__ import annotations



import corpus_pipeline
from quire.llm import toxicity
from quire.llm._common import materialize, read
from tests.llm.helpers import TESTDATA
from tests.llm.test_decontamination import smith_waterman, tokens
from tests.llm.test_jaccard import brute as components
from tests.llm.test_lines import brute as lines
from tests.llm.test_packing import sound

FOLDER = f"{TESTDATA}/sf0.001"


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_against_brute_force(spark):
    docs = read(spark, FOLDER, "documents")
    columns = docs.columns
    before = texts(docs)
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, read(spark, FOLDER, "labels")).collect()}
    want = [
        lambda given: {i: t for i, t in given.items() if not scores[i]},
        lambda given: {i: t for i, t in lines(list(given.items()), 10).items() if t.strip() or t == given[i]},
        _lowest,
        _not_leaked(spark),
    ]
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = materialize(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        now = texts(docs)
        assert now == brute(before)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    sound(packed, 4096)
    assert {r["doc_id"] for r in packed} == before.keys()


def _lowest(given):
    found = components(list(given.items()))
    return {i: t for i, t in given.items() if found[i][1] == i}


def _not_leaked(spark):
    items = [tokens(r["text"]) for r in read(spark, FOLDER, "benchmark").collect()]

    def leaked(text):
        w = tokens(text)
        return any(sum(t in set(w) for t in x) >= 0.4 * len(x) and smith_waterman(x, w) >= 0.45 for x in items)

    return lambda given: {i: t for i, t in given.items() if not leaked(t)}


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
