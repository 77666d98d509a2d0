from __future__ import annotations

import hashlib
import random

from quire.llm import chat
from quire.llm._common import read
from quire.llm.queries import CONTROL, ORACLES, QUERIES
from tests.llm.helpers import TESTDATA
from tests.oracle import same_rows


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_digests(spark):
    folder = f"{TESTDATA}/sf0.01"
    turns = {}
    for r in sorted(read(spark, folder, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"], r["role"], r["text"] or "")):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", CONTROL), ("assistant", CONTROL)]
    found = {r["conv_id"]: r for r in QUERIES["op6_chat_formatting"](spark, folder).collect()}
    assert found.keys() == turns.keys()
    for key, parts in turns.items():
        loss = "".join(t for role, t in parts if role == "assistant")
        r = found[key]
        assert (r["n_turns"], r["turns_sha256"]) == (len(parts), sha("".join(f"{role}\n{t}\n" for role, t in parts)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_sql(spark):
    same_rows(spark, QUERIES["op6_chat_formatting"], ORACLES["op6_chat_formatting"], f"{TESTDATA}/sf0.01")


def test_round_trip_of_control_strings(spark):
    r = random.Random(5)
    parts = ["<", "|", "\\", "\n", "<|im_end|>", "<|im_start|>", "<\\|", "n", "é😀", "a", ">", "|im_end|>"]
    make = lambda: "".join(r.choice(parts) for _ in range(r.randrange(12)))
    rows = [(k, t, r.choice(["user", "assistant", make(), None]), r.choice([make(), make(), None])) for k in range(120) for t in range(4)]
    table = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, turns string")
    back = {x["conv_id"]: x for x in chat.read_back(chat.format_chat(table)).collect()}
    for k in range(120):
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == k]
        assert [(t["role"], t["text"]) for t in back[k]["turns"]] == own
        assert back[k]["losses"] == [t for role, t in own if role == "assistant"]


def test_expanded_examples_and_empty(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "and"), (1, 3, "assistant", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    found = chat.expand(chat.format_chat(table)).orderBy("turn_index").collect()
    assert [(x["turn_index"], x["text"][x["loss_start"] : x["loss_end"]]) for x in found] == [(1, "yes"), (3, "")]
    assert found[1]["text"].startswith(found[0]["text"])
    assert chat.digest(chat.format_chat(table.limit(0))).count() == 0
