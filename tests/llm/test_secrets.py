from __future__ import annotations

import base64
import hashlib
import random
import re

from quire.llm import secrets
from quire.llm._common import read
from quire.llm.queries import QUERIES
from tests.llm.helpers import TESTDATA, awkward, documents

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    t = text or ""
    found = [(m.start(), 1, "assign", m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 2, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 3, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def same(found, texts):
    for r in found:
        spans = base(texts[r["doc_id"]])
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[2] == kind for s in spans) for kind in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_base_against_brute_force(spark):
    folder = f"{TESTDATA}/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in read(spark, folder, "documents").select("doc_id", "text").collect()}
    found = QUERIES["op7_secret_scan"](spark, folder).collect()
    assert len(found) == len(texts)
    same(found, texts)


def test_random_strings_are_found_and_others_not(spark):
    r = random.Random(3)
    keys = [base64.b64encode(r.randbytes(30)).decode().rstrip("=") for _ in range(40)]
    plain = [f"https/example/articles/{2000 + k}/introduction_to_something_{k}" for k in range(40)]
    plain += ["abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaaaaaaaaaaaaaa1111111111", "1234567890123456789012345678901234567890a"]
    found = secrets.secret_scan(documents(spark, [(k, f"see {x} there") for k, x in enumerate(keys + plain)])).collect()
    hit = {x["doc_id"] for x in found if x["random"]}
    assert sum(k in hit for k in range(len(keys))) >= 36
    assert sum(k in hit for k in range(len(keys), len(keys) + len(plain))) <= 4


def test_values_after_equals_signs_and_keys_of_letters(spark):
    r = random.Random(5)
    key = lambda alphabet: "".join(r.choice(alphabet) for _ in range(40))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    forms = ["AWS_SECRET_ACCESS_KEY={}", "see https://example.org/?sig={} there", "key={}"]
    rows = [(k, forms[k % 3].format(key(letters + "0123456789"))) for k in range(30)] + [(30 + k, f"see {key(letters)} there") for k in range(10)]
    rows += [(40 + k, f"see {'abcdefghijklmnopqrstuvwxyz' * 2} there") for k in range(10)]
    hit = {x["doc_id"] for x in secrets.secret_scan(documents(spark, rows)).collect() if x["random"]}
    assert sum(k < 30 for k in hit) >= 27 and sum(30 <= k < 40 for k in hit) >= 8 and not any(k >= 40 for k in hit)


def test_edges(spark):
    rows = [r for r in awkward() if r[0] not in (4, None)] + [(10, "😀 token=abcdef, TOKEN: 'xyz12345' AKIA" + "A" * 16 + " " + "0f" * 12), (11, "password = short"), (12, "secret=12345 secret=123456")]
    found = secrets.digest(secrets.secret_scan(documents(spark, rows))).collect()
    assert len(found) == len(rows)
    same(found, dict(rows))
    assert secrets.digest(secrets.secret_scan(documents(spark, []))).count() == 0
