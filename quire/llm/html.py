"""HTML extraction by tag-path ratios.

A page is a sequence of text nodes (blocks), each with its path: the open tags above it and their classes.

1. Aggregate: nodes, text length and punctuation by path, and by subtree of paths.
2. Smooth: a path's length and punctuation by node are averaged with those of the subtrees above it, each
   counting half as much as the one below.  A heading gets its share of the paragraphs beside it, a line
   outside the article doesn't.
3. Fuse: smoothed length times one plus the logarithm of smoothed punctuation, weighed by what the page says of itself: more
   inside ``article`` and ``main``, less where a class or id has a word of ``NAMES`` or ``WEAK_NAMES``.
4. Threshold: paths with at least ``SHARE`` of the mean over all nodes are picked, and subtrees follow from them.

   * A page with ``article`` or ``main`` around text has its text there: the one of the largest sum of ratios, an article before the
     ``main`` around it where it has half of that sum.  All of its blocks are content, headings, lists, tables, quotes and bylines among them.
   * Elsewhere paths that are mostly links have to reach four times that share, at most the mean.  A picked path brings what lies beside it: the whole of the nearest element around it that isn't a paragraph, list,
     table, quote or heading, but for parts that are mostly links; directly in ``body`` only such paragraphs, lists and so on.
     The first ``h1`` belongs to the text it stands nearest to.

Tags and roles exclude: menus, headers, footers, sidebars, forms, scripts, styles and what is hidden.  So do words of ``NAMES``
below the chosen element (comments, notices, adverts), and words of ``WEAK_NAMES`` where the part is under the threshold
and mostly links.  A heading that says ``Comments``, or a number of them, cuts off all that follows it in its element.  Names never
leave a page empty: where nothing else has text they don't exclude.

Edge cases: null or empty html gives an empty text.  Markup that breaks off, unclosed and wrongly nested
tags are read as browsers do, roughly: a closing tag closes everything inside its element, and without one
open the closing tag is ignored; an attribute without closing quote runs to the end.  The work is in
proportion to the page, whatever its depth or the length of its attributes.  Repeated rows are separate rows;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_OTHER = frozenset("head nav header footer aside form button select option menu dialog fieldset input datalist".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center".split())
_BODY = frozenset(("", "html", "body"))
_ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())


def _named(names: str) -> re.Pattern[str]:
    return re.compile(rf"(?:^|[^a-z])(?:{names})(?:$|[^a-z])")


#: Words of classes and ids that say that a part is not the main text.
NAMES = _named(
    r"ad|ads|adbox|advert\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|footer|sidebar\w*|aside|widget\w*|related|recommend\w*|share|sharing|social|comment\w*|disqus\w*|respond|replies|"
    r"cookie\w*|consent|notice\w*|notification\w*|popup|modal|newsletter\w*|subscribe\w*|signup|login|paywall|pagination|pager|toolbar"
)
#: Words that say so less surely.
WEAK_NAMES = _named(r"banner\w*|header|masthead|rail|alert|overlay|form|search\w*|skip|copyright|legal")
_HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
_REPLIES = re.compile(r"(?:reader )?comments?(?: ?[(:] ?\d+ ?\)?)?|\d+ (?:comments?|replies|reply|responses?)(?: .{0,80})?|leave a (?:comment|reply)", re.I)
_CONTAINERS = frozenset("article main".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、«»\"“”()-]")
_SPACE = re.compile(r"\s+")
#: A new one of these closes an open one, as their closing tags may be left out.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SHARE = 0.3
#: Share of a part's text in links from which it counts as mostly links.
LINKED = 0.5
#: Weights of a path inside a container, and of one with a word of ``NAMES`` or ``WEAK_NAMES``.
INSIDE, NAMED = 2.0, 0.1


class Page:
    """Blocks of a page, with their paths as numbers; a path's parent has a smaller one."""

    def __init__(self, page: str):
        #: By path: parent, tag, whether its text counts, weight, 2 with a word of NAMES and 1 with one of WEAK_NAMES.
        self.parent, self.tag, self.counts, self.weight, self.mark = [-1], [""], [True], [1.0], [0]
        self.path: list[int] = []
        #: By block the characters in links.
        self.linked: list[int] = []
        self._parts: list[list[str]] = []
        self._numbers: dict[tuple[int, str, str, bool, int], int] = {}
        self._read(page)
        texts = [_text(x) for x in self._parts]
        kept = [k for k, t in enumerate(texts) if t]
        self.path, self.texts, self.linked = [self.path[k] for k in kept], [texts[k] for k in kept], [self.linked[k] for k in kept]

    def _number(self, parent: int, tag: str, classes: str, counts: bool, weight: float, mark: int) -> int:
        found = self._numbers.setdefault((parent, tag, classes, counts, mark), len(self.parent))
        if found == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
            self.counts.append(counts)
            self.weight.append(weight)
            self.mark.append(mark)
        return found

    def _read(self, page: str) -> None:
        # (tag, path, whether inside a container, whether markup inside a block hides it)
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        opened: Counter[str] = Counter()
        fresh, at = True, 0

        def close(down_to: int) -> None:
            opened.subtract(x[0] for x in stack[down_to:])
            del stack[down_to:]

        while True:
            m = _MARKUP.search(page, at)
            piece = page[at : m.start() if m else len(page)]
            if piece and not stack[-1][3]:
                if fresh:
                    self.path.append(stack[-1][1])
                    self._parts.append([])
                    self.linked.append(0)
                    fresh = False
                self._parts[-1].append(piece)
                if opened["a"] > 0:
                    self.linked[-1] += len(piece.strip())
            if m is None:
                return
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag not in _INLINE:
                fresh = True
            if m[1]:
                if tag in _HEADINGS and self.path and stack[-1][0] == tag and self.path[-1] == stack[-1][1] and _REPLIES.fullmatch(_text(self._parts[-1])):
                    close(len(stack) - 1)
                    above, path, inside, hidden = stack[-1]
                    self.path[-1] = cut = self._number(path, "", "", False, self.weight[path], 0)
                    stack[-1] = (above, cut, inside, hidden)
                elif opened[tag] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if stack[k][0] not in _INLINE and tag in _INLINE:
                            break
                continue
            if tag in _VOID or m[3].endswith("/"):
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _CLOSES.get(tag, ()):
                    close(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
            _, path, inside, hidden = stack[-1]
            classes, mark, main, other = _attributes(tag, m[3])
            other |= tag in _OTHER and not (tag == "header" and inside)
            part = "main" if main and tag not in _CONTAINERS else tag
            if tag in _INLINE:
                hidden |= other
            else:
                weight = self.weight[path] * (INSIDE if part in _CONTAINERS and not inside else 1.0)
                path = self._number(path, part, f"{tag}.{classes}", self.counts[path] and not other, weight * NAMED if mark and weight >= 1.0 else weight, mark)
            stack.append((tag, path, inside or part in _CONTAINERS, hidden))
            opened[tag] += 1


def _text(parts: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(parts))).strip()


def _attributes(tag: str, attributes: str) -> tuple[str, int, bool, bool]:
    """A tag's classes, its mark by its names, whether its role is that of the main text, and whether it is hidden or of another role."""
    classes, mark, main, other = "", 0, False, False
    if attributes.strip():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape("".join(values)).lower()
            if name == "class":
                classes = value
            if name in ("class", "id"):
                if tag not in ("html", "body"):
                    mark = max(mark, 2 if NAMES.search(value) else 1 if WEAK_NAMES.search(value) else 0)
            elif name == "role":
                main, other = main or value in ("main", "article"), other or value in _ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                other = True
    return classes, mark, main, other


def _smoothed(total: np.ndarray, nodes: np.ndarray, parent: list[int]) -> np.ndarray:
    """By path the value by node, averaged with those of the subtrees above, each at half the weight of the one below."""
    sums, count = total.copy(), nodes.astype(float)
    for k in range(len(parent) - 1, 0, -1):
        sums[parent[k]] += sums[k]
        count[parent[k]] += count[k]
    subtree = sums / np.maximum(count, 1)
    above, weights, out = np.zeros(len(parent)), np.zeros(len(parent)), total / np.maximum(nodes, 1)
    for k in range(len(parent)):
        if k:
            up = parent[k]
            out[k] = (out[k] + 0.5 * above[up]) / (1 + 0.5 * weights[up])
            above[k], weights[k] = subtree[k] + 0.5 * above[up], 1 + 0.5 * weights[up]
        else:
            above[0], weights[0] = subtree[0], 1.0
    return out


def fused(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """By path the fused ratio, and its nodes with text that counts."""
    path, counts = np.array(page.path, np.int64), np.array(page.counts)
    here = counts[path]
    n = len(page.parent)
    nodes = np.bincount(path[here], minlength=n)
    length = np.bincount(path[here], np.array([len(t) for t in page.texts], float)[here], n)
    points = np.bincount(path[here], np.array([len(_PUNCTUATION.findall(t)) for t in page.texts], float)[here], n)
    return _smoothed(length, nodes, page.parent) * (1 + np.log1p(_smoothed(points, nodes, page.parent))) * np.array(page.weight), nodes


def _sums(values: np.ndarray, parent: list[int]) -> np.ndarray:
    """By path the sum over its subtree."""
    out = values.astype(float)
    for k in range(len(parent) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def _below(parent: list[int], given: np.ndarray) -> np.ndarray:
    """By path whether it or one above it is given."""
    out = given.copy()
    for k in range(1, len(parent)):
        out[k] |= out[parent[k]]
    return out


def _common(parent: list[int], a: int, b: int) -> int:
    """The lowest path above both; a parent has the smaller number."""
    while a != b:
        a, b = (parent[a], b) if a > b else (a, parent[b])
    return a


def _container(page: Page, mass: np.ndarray, inside: np.ndarray) -> int | None:
    """The ``article`` or ``main`` that has the page's text: unnamed ones first, then by their sum of ratios."""
    named = np.array(page.mark) == 2
    above = _below(page.parent, named)
    found = [k for k, tag in enumerate(page.tag) if tag in _CONTAINERS and page.counts[k] and inside[k] > 0]
    best = max(found, key=lambda k: (not named[k], not above[k], mass[k], -k), default=None)
    if best is not None and page.tag[best] == "main":
        under = _below(page.parent, np.arange(len(page.parent)) == best)
        articles = [k for k in found if page.tag[k] == "article" and under[k] and (above[best] or not above[k]) and mass[k] >= 0.5 * mass[best]]
        best = max(articles, key=lambda k: (mass[k], -k), default=best)
    return best


def _of_container(page: Page, root: int, low: np.ndarray) -> np.ndarray:
    """The paths of a container's text; ``low`` tells subtrees that are under the threshold and mostly links."""
    at, parent = np.arange(len(page.parent)), page.parent
    mark = np.array(page.mark)
    under = _below(parent, at == root)
    out = under & ~_below(parent, under & (at != root) & ((mark == 2) | ((mark == 1) & low)))
    titles = [k for k in at if page.tag[k] == "h1"]
    if page.tag[root] == "article" and not any(under[k] for k in titles):
        main = root
        while main > 0 and page.tag[main] != "main":
            main = parent[main]
        if main > 0:
            named = _below(parent, mark == 2)
            around = _below(parent, at == main)
            out[[k for k in titles if around[k] and not named[k]]] = True
    return out


def _beside(page: Page, picked: np.ndarray, mass: np.ndarray, title: int | None, links: np.ndarray) -> np.ndarray:
    """The paths that picked ones bring."""
    parent, tag = page.parent, page.tag
    n = len(parent)
    around = list(range(n))
    for k in range(1, n):
        if tag[k] in _FLOW:
            around[k] = around[parent[k]]
    roots = {around[k] for k in np.flatnonzero(picked)}
    if title is not None and roots:
        roots.add(_common(parent, title, max(roots, key=lambda k: (tag[k] not in _BODY, mass[k], -k))))
    out = np.zeros(n, bool)
    for k in range(n):
        if tag[k] in _BODY and page.counts[k]:
            out[k] = picked[k]
        elif k in roots:
            out[k] = True
        elif tag[parent[k]] in _BODY:
            out[k] = parent[k] in roots and tag[k] in _FLOW
        else:
            out[k] = out[parent[k]] and (tag[k] in _FLOW or not links[k])
    return out | picked


def content(page: Page, share: float = SHARE) -> np.ndarray:
    """By path whether its blocks are the main text."""
    counts, parent = np.array(page.counts), page.parent
    ratio, nodes = fused(page)
    if not nodes.sum():
        return np.zeros(len(parent), bool)
    sizes = np.array([len(t) for t in page.texts], float)
    links = _sums(np.bincount(page.path, page.linked, len(parent)), parent) > LINKED * _sums(np.bincount(page.path, sizes, len(parent)), parent)
    mass, inside = _sums(ratio * nodes, parent), _sums(nodes, parent)
    root = _container(page, mass, inside)
    if root is not None:
        low = links & (mass < share * mass[root] / inside[root] * inside)
        out = _of_container(page, root, low) & counts
        return out if nodes[out].sum() else _below(parent, np.arange(len(parent)) == root) & counts
    titles = [k for k, tag in enumerate(page.tag) if tag == "h1" and nodes[k]]
    title = titles[0] if titles else None
    named = np.array(page.mark) == 2
    if title is not None:
        named &= _sums(np.arange(len(parent)) == title, parent) == 0
    alive = counts & ~_below(parent, named)
    if not nodes[alive].sum():
        alive = counts
    if title is not None and not alive[title]:
        title = None
    mean = (ratio * nodes)[alive].sum() / nodes[alive].sum()
    own = np.bincount(page.path, page.linked, len(parent)) > LINKED * np.bincount(page.path, sizes, len(parent))
    picked = alive & (nodes > 0) & (ratio >= np.where(own, max(share, min(1.0, 4 * share)), share) * mean)
    return _beside(page, picked, mass, title, links) & alive


def extract(page: str | None, share: float = SHARE) -> str:
    """The main text of a page."""
    read = Page(page or "")
    if not read.path:
        return ""
    kept = content(read, share)
    return " ".join(t for t, p in zip(read.texts, read.path, strict=True) if kept[p])


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(page).cast("string").alias("html"))
    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, u string, text string, n_chars long")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
