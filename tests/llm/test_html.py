from __future__ import annotations

import math
import random
import time

from quire.llm._common import read
from quire.llm.html import SHARE, Page, extract, extract_text
from quire.llm.queries import QUERIES
from tests.llm.helpers import TESTDATA

FLOW = {"p", "h1", "h2", "ul", "li"}
PUNCTUATION = set(".,;:!?…。，；：！？、«»\"“”()-")
LONG = "This is a long sentence of the article, with commas, and it goes on for a while. " * 3


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
    <div class="content"><h1>The &amp; title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}<b>bold</b>&nbsp;end</p><script>var a = "<p>no</p>";</script></div>
    <div class="sidebar"><p>Related: {LONG}</p></div><div id="comments"><p>{LONG}</p></div><footer>Copyright</footer></body></html>"""
    one = LONG.strip()
    assert extract(page) == f"The & title {one} Short one. {one} bold end" or extract(page) == f"The & title {one} Short one. {LONG}bold end"


def test_edges(spark):
    given = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p"), (5, "u", "<div><p>" * 2000 + "deep text, here." + "</p></div>" * 10), (6, "u", "plain text only"), (6, "u", "plain text only"), (7, "u", "<!-- open <p>x"), (8, "u", "<p>" + "word " * 200_000 + "</p>")]
    rows = spark.createDataFrame([(*x, "z") for x in given], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r for r in extract_text(rows).collect()}
    assert [found[k]["text"] for k in (1, 2, 7)] == ["", "", ""] and found[6]["text"] == "plain text only"
    assert found[8]["n_chars"] == 5 * 200_000 - 1 and found[5]["text"] == "deep text, here."
    assert extract_text(rows).count() == len(given) and extract_text(rows.limit(0)).count() == 0


def test_query(spark):
    found = QUERIES["op4_html_extraction"](spark, f"{TESTDATA}/sf0.01").collect()
    assert len(found) == 250 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert sum(bool(r["text"]) for r in found) > 225


def brute(page, share=SHARE):
    """The selection from the definition: every path against the subtrees and the elements above it, one by one."""
    read = Page(page)
    up = lambda p: [] if p < 0 else [p, *up(read.parent[p])]
    every = range(len(read.parent))
    blocks = [(p, len(t), sum(c in PUNCTUATION for c in t), links) for p, t, links in zip(read.path, read.texts, read.linked, strict=True)]
    nodes = [x for x in blocks if read.counts[x[0]]]
    if not nodes:
        return ""

    def smooth(p, k):
        own = [x[k] for x in nodes if x[0] == p]
        values = [sum(own) / len(own)]
        for q in up(read.parent[p]):
            inside = [x[k] for x in nodes if q in up(x[0])]
            values.append(sum(inside) / len(inside))
        weights = [0.5**i for i in range(len(values))]
        return sum(map(float.__mul__, weights, values)) / sum(weights)

    fused = {p: smooth(p, 1) * (1 + math.log1p(smooth(p, 2))) * read.weight[p] for p, _, _, _ in nodes}
    mass = lambda p: sum(fused[x[0]] for x in nodes if p in up(x[0]))
    linked = lambda inside: sum(x[3] for x in inside) > 0.5 * sum(x[1] for x in inside)
    links = lambda p: linked([x for x in blocks if p in up(x[0])])
    text = lambda kept: " ".join(t for t, p in zip(read.texts, read.path, strict=True) if p in kept)
    named = lambda p: read.mark[p] == 2

    holders = [p for p in every if read.tag[p] == "article" and any(p in up(x[0]) for x in nodes)]
    if holders:
        root = max(holders, key=lambda p: (not named(p), not any(map(named, up(p))), mass(p), -p))
        under = [p for p in fused if root in up(p)]
        kept = [p for p in under if not any(named(q) for q in up(p)[: up(p).index(root)])]
        return text(kept or under)

    title = min((p for p in fused if read.tag[p] == "h1"), default=None)
    alive = {p for p in fused if not any(named(q) and not (title is not None and q in up(title)) for q in up(p))} or set(fused)
    title = title if title in alive else None
    here = [x for x in nodes if x[0] in alive]
    mean = sum(fused[x[0]] for x in here) / len(here)
    picked = {p for p in alive if fused[p] >= (min(1.0, 4 * share) if linked([x for x in blocks if x[0] == p]) else share) * mean}
    around = lambda p: next(q for q in up(p) if read.tag[q] not in FLOW)
    body = lambda p: read.tag[p] == ""
    roots = {around(p) for p in picked}
    if title is not None and roots:
        best = max(roots, key=lambda p: (not body(p), mass(p), -p))
        roots.add(next(q for q in up(title) if q in up(best)))

    def rides(p):
        for q in up(p):
            if body(q):
                return p == q and p in picked
            if q in roots:
                return True
            if body(read.parent[q]):
                return read.parent[q] in roots and read.tag[q] in FLOW
            if read.tag[q] not in FLOW and links(q):
                return False
        return False

    return text({p for p in alive if p in picked or rides(p)})


def test_selection_against_brute_force(spark):
    pages = [r["html"] for r in read(spark, f"{TESTDATA}/sf0.001", "pages").select("html").collect()]
    r = random.Random(3)
    for k in range(300):
        tags = [r.choice(["div", "div class=ad", "section", "p", "nav", "ul", "li", "b", "h1", "h2", "a", *["article"] * (k % 2)]) for _ in range(12)]
        pages.append("".join(f"<{t}>{LONG[: r.randrange(1, 90)]}" + (f"</{t.split()[0]}>" if r.random() < 0.6 else "") for t in tags))
    assert [extract(x) for x in pages] == [brute(x) for x in pages]


def test_articles_of_the_query_are_whole(spark):
    # The pages' articles are marked, so the paths chosen can be held against all text inside the mark.
    for r in read(spark, f"{TESTDATA}/sf0.01", "pages").collect():
        inside = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        assert extract(r["html"]) == " ".join(Page(inside).texts), r["page_id"]


def test_the_threshold_decides():
    page = "<div><a>Home</a></div><div><ul><li>One</li><li>Two</li></ul></div>" + f"<section><h2>Title here</h2><p>{LONG}</p><p>{LONG}</p></section>"
    assert extract(page) == f"Title here {LONG.strip()} {LONG.strip()}"
    assert extract(page, 0.0).startswith("Home One Two Title here")


def test_names_weigh_and_tags_exclude():
    assert extract(f'<article><h1>Head</h1><div class="legal"><p>{LONG}</p></div><p>End.</p></article>') == f"Head {LONG.strip()} End."
    assert extract('<div class="content search-result"><p>story</p></div>') == "story"
    assert extract('<p>some text</p><a x="') == "some text" and extract("<nav>no</nav><form>no</form>") == ""


NOISE = "Another part of the page, with commas too, that goes on and on, as long as any. " * 4


def main_text(page):
    return extract(page).replace(LONG.strip(), "L").replace(NOISE.strip(), "N")


def test_lists_tables_quotes_and_bylines_of_an_article_stay():
    rest = "<ul><li>One</li><li>Two</li></ul><table><tr><td>a<td>b</table><blockquote><p>Hi</p></blockquote><div>By me</div><pre>x  y</pre><dl><dt>t<dd>d</dl>"
    whole = "Head L One Two a b Hi By me x y t d L"
    assert main_text(f"<article><h1>Head</h1><p>{LONG}</p>{rest}<p>{LONG}</p></article>") == whole
    assert main_text(f"<div role=main><h1>Head</h1><p>{LONG}</p>{rest}<p>{LONG}</p></div><div>{NOISE}</div>") == whole
    assert main_text(f"<body><div><a>Home</a></div><div class=post><h1>Head</h1><p>{LONG}</p>{rest}<p>{LONG}</p></div></body>") == whole
    assert main_text(f"<body><div class=post><h1>Head</h1><div>By me</div><div class=text><p>{LONG}</p></div></div><div><a>Home</a></div></body>") == "Head By me L"
    assert main_text(f"<main><h1>Head</h1><div>x</div><article><p>{LONG}</p></article></main>") == "Head L"


def test_a_short_article_beats_what_is_outside():
    assert main_text(f"<article><h1>H</h1><p>Yes.</p></article><div><p>{NOISE}</p></div>") == "H Yes."
    assert main_text(f'<article class="legal notice"><h1>Head</h1><p>{LONG}</p></article><div><p>{NOISE}</p></div>') == "Head L"


def test_comments_notices_and_adverts_go():
    assert main_text(f"<article><h1>Head</h1><p>{LONG}</p><section class=comments><div class=comment><p>{NOISE}</p></div></section></article>") == "Head L"
    assert main_text(f"<article><h1>Head</h1><p>Short.</p><div id=comments><p>{NOISE}</p></div></article>") == "Head Short."
    assert main_text(f"<article><p>Short.</p></article><article class=comment><p>{NOISE}</p></article>") == "Short."
    assert main_text(f'<article><p>{LONG}</p><div class="cookie-notice">{NOISE}</div><div class=ad>{NOISE}</div><div role=navigation>{NOISE}</div></article>') == "L"
    assert main_text(f"<article><p>{LONG}</p><div><h3>3 Comments</h3><ol><li>{NOISE}<li>{NOISE}</ol></div><p>End.</p></article>") == "L End."
    assert main_text(f"<article><p>{LONG}</p><h2>Comments on the war</h2><p>{NOISE}</p></article>") == "L Comments on the war N"


def test_names_never_leave_a_page_empty():
    assert main_text(f"<div class=comments><p>{LONG}</p></div>") == "L" and main_text(f"<article><div class=notice>{LONG}</div></article>") == "L"
    assert main_text(f"<div class=with-sidebar><h1>T</h1><p>{LONG}</p><div class=sidebar><p>{NOISE}</p></div></div>") == "T L"


def test_large_and_deep_pages_take_little_time():
    for page in ("<div>" * 100_000 + "text", '<div class="' + "c" * 100_000 + '">' + "<p>one, two.</p>" * 10_000 + "</div>", "<div>" * 6_000 + "</section>" * 6_000 + "text"):
        began = time.process_time()
        assert extract(page)
        assert time.process_time() - began < 5
