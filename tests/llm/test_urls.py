from __future__ import annotations

from quire.llm import urls
from quire.llm._common import read
from quire.llm.queries import QUERIES
from tests.llm.helpers import TESTDATA

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((k for k, c in enumerate(rest) if c in "/?#"), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut : min((k for k, c in enumerate(rest) if k >= cut and c in "?#"), default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def same(found, given):
    for r in found:
        host, path, rule, verdict = judged(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_rules_of_every_page(spark):
    folder = f"{TESTDATA}/sf0.01"
    given = {r["page_id"]: r["url"] for r in read(spark, folder, "pages").select("page_id", "url").collect()}
    found = QUERIES["op8_url_filter"](spark, folder).collect()
    assert len(found) == len(given)
    same(found, given)


def test_trees_learn_the_shape_of_urls(spark):
    good = [f"https://news{chr(97 + k % 26)}.net/story/{k % 7}" for k in range(200)]
    bad = [f"http://x{k}9{k * 7}-q{k}z.net/a?id={k}&r={k * 3}&s=1" for k in range(200)]
    labelled = spark.createDataFrame([(u, int(u in set(bad))) for u in good[::2] + bad[::2]], "url string, label int")
    rows = spark.createDataFrame([(k, u, "q") for k, u in enumerate(good[1::2] + bad[1::2])], "page_id long, url string, host string")
    found = urls.url_filter(rows, labelled).collect()
    right = sum(r["verdict"] == ("allow" if r["page_id"] < 100 else "block") for r in found)
    assert right >= 190


def test_edges(spark):
    given = dict(enumerate([None, "", "no scheme", "://", "HTTP://EXAMPLE.org/es/x", "http://a.example.org/en/12?x://y", "http://x.com?de/", "http://com/de/#/fr/", "a://b\nc.org/d", "https://" + "a" * 50_000 + ".com/fr/"]))
    rows = spark.createDataFrame([(k, u, "z") for k, u in given.items()] + [(4, given[4], "z")], "page_id long, url string, features string")
    none = spark.createDataFrame([], "url string, label int")
    found = urls.url_filter(rows, none).collect()
    assert len(found) == len(given) + 1
    same(found, given)
    assert urls.url_filter(rows.limit(0), none).count() == 0
