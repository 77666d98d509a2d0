from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm._common import read
from quire.llm.queries import QUERIES, tokenizer
from tests.llm.helpers import TESTDATA, awkward, documents


def sound(found, size):
    """No sequence has a gap, an overlap or more than ``size`` tokens; returns the sequences."""
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return bins


def test_pieces_and_bins(spark):
    folder = f"{TESTDATA}/sf0.01"
    docs = read(spark, folder, "documents").select("doc_id", "text").collect()
    found = QUERIES["op3_best_fit_packing"](spark, folder).collect()
    model = Tokenizer.from_file(tokenizer())
    want = set()
    for r in docs:
        ids = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.add((r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
    bins = sound(found, 4096)
    assert len(bins) <= -(-sum(r["length"] for r in found) // 4096) + 2


def test_two_smaller_pieces_replace_the_smallest():
    # Greedy takes 6 and 3; 2 and 2 fill the gap of 4 better.
    assert [sorted(lengths) for _, lengths in packing.plan({6: 1, 3: 1, 2: 2}, 10)][0] == [2, 2, 6]


def test_edges(spark):
    rows = awkward()
    found = packing.best_fit_packing(documents(spark, rows), tokenizer(), size=64).collect()
    sound(found, 64)
    assert sum(r["piece"] == 0 for r in found) == len(rows)
    assert [r["length"] for r in found if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.best_fit_packing(documents(spark, []), tokenizer()).count() == 0


def test_words_are_encoded_alike_together_and_alone(monkeypatch):
    """Also those that hold special tokens; what is remembered is bounded, and words that come again stay."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "_known", {})
    model, alone = Tokenizer.from_file(tokenizer()), lambda t: np.array(model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    for k in range(20):
        texts = [f"often w{k}x{n} Don't 3.5 é" for n in range(30)] + ["<|endoftext|> a<|endoftext|>b c"] * (k % 2) + ["<|startoftext|>x y", "", None, "\x1cx y", "́a b"]
        assert packing.encode(texts, tokenizer()) == [alone(t) for t in texts]
        known, before, _ = packing._known[tokenizer()]
        assert "often" in known and len(known) + len(before) < 200


def test_parts_of_words_are_encoded_alike_and_once(monkeypatch):
    """Words that differ in case, digits and punctuation alone share what is encoded; ids are the tokenizer's own."""
    monkeypatch.setattr(packing, "_known", {})
    seen, really = [], packing._ids_of
    monkeypatch.setattr(packing, "_ids_of", lambda words, model: really(seen.extend(words) or words, model))
    model, alone = Tokenizer.from_file(tokenizer()), lambda t: np.array(model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    texts = ["Letter letter, LETTER. (letter) letter7 Ärger ÄRGER! ärger", "letter.) 77 ärger7"]
    assert packing.encode(texts, tokenizer()) == [alone(t) for t in texts]
    assert len(seen) == len(set(seen)) and {"letter", "ärger"} <= set(seen) and sum("rger" in w or "etter" in w for w in seen) == 2
    rng = np.random.default_rng(7)
    few = ["'", "'", "s", "T", "r", "E", "l", "v", "d", "M", "a", " ", " ", "\n", ".", "5", "é", "É", "ß", "ÿ", "Ÿ", "×", "÷", "İ", "ñ", "ª", "_", "日", "́", "̈", " ", "’", "\x1c", "\x00", "²", "<|endoftext|>"]
    texts = ["".join(rng.choice(few, rng.integers(0, 12))) for _ in range(4000)] + [None, "", " ", "'", "s"]
    assert packing.encode(texts, tokenizer()) == [alone(t) for t in texts]


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    """Whatever the session's own setting, which stays."""
    seen = spark.sparkContext.accumulator(0)
    really = packing.pieces

    def counted(docs, *more):
        def largest(batches):
            for batch in batches:
                seen.add(batch.num_rows > 2_000)
                yield batch

        return really(docs.mapInArrow(largest, docs.schema), *more)

    monkeypatch.setattr(packing, "pieces", counted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(0, 5_000, 1, 1).selectExpr("id as doc_id", "'a b' as text")
    assert packing.best_fit_packing(docs, tokenizer()).count() == 5_000
    assert seen.value == 0 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_tokenizers_of_words_and_parts_have_one_model():
    """A worker held vocabulary and merges twice."""
    models = packing._models(tokenizer())
    assert models.parts.get_added_tokens_decoder() == models.whole.get_added_tokens_decoder()
    assert [e.ids for e in models.parts.encode_batch(["hello", "don", "--", models.own[0]], add_special_tokens=False)] == [e.ids for e in models.whole.encode_batch(["hello", "don", "--", models.own[0]], add_special_tokens=False)]
    models.whole.model.dropout = 0.5
    assert models.parts.model.dropout == 0.5
