"""The search language: words, "phrases", prefixes*, + between phrases, AND, OR, NOT and parentheses.

Words in a row all have to be there and bind tightest, then NOT (with a left side), AND, OR; operators are in
capitals.  A word that has marks inside, as ``well-known``, is a phrase of its parts.  A phrase without letters
or digits is passed over among words in a row, and matches nothing elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Letters with marks and their plain letters, as the tokenizer folds them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
_TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"]|"")*")|(?P<mark>[()+*])|(?P<word>[^\s"()+*]+))')
_FOLD = str.maketrans(MARKED, PLAIN)


def fold(text: str) -> list[str]:
    """The tokens of a text, as pages' tokens are folded."""
    return re.findall(r"[^\W_]+", text.replace("ſ", "s").lower().translate(_FOLD))


@dataclass(frozen=True)
class Phrase:
    """Tokens one after the other; with ``prefix`` the last one is the start of a word."""

    tokens: tuple[str, ...]
    prefix: bool = False

    @property
    def slots(self) -> list[tuple[str, bool]]:
        return [(t, self.prefix and k == len(self.tokens) - 1) for k, t in enumerate(self.tokens)]


@dataclass(frozen=True)
class Node:
    """``kind`` is phrase, and, or, not (the first child without the second) or nothing."""

    kind: str
    phrase: Phrase | None = None
    children: tuple[Node, ...] = field(default=())


NOTHING = Node("nothing")


class _Reader:
    def __init__(self, query: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while query[at:].strip():
            m = _TOKEN.match(query, at)
            if not m:
                raise ValueError(f"a quotation mark isn't closed: {query[at:]}")
            self.items.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *wanted: tuple[str, str]) -> bool:
        found = self.peek() in wanted
        self.at += found
        return found

    def chain(self, operator: str, part) -> Node:
        found = [part()]
        while self.take(("word", operator)):
            found.append(part())
        return found[0] if len(found) == 1 else Node(operator.lower(), children=tuple(found))

    def any_of(self) -> Node:
        return self.chain("OR", lambda: self.chain("AND", self.without))

    def without(self) -> Node:
        left = self.row()
        while self.take(("word", "NOT")):
            left = Node("not", children=(left, self.row()))
        return left

    def row(self) -> Node:
        found = [self.one()]
        while self.peek()[0] in ("text", "word") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() == ("mark", "("):
            found.append(self.one())
        kept = [n for n in found if n.kind != "nothing"] if len(found) > 1 else found
        return NOTHING if not kept else kept[0] if len(kept) == 1 else Node("and", children=tuple(kept))

    def one(self) -> Node:
        if self.take(("mark", "(")):
            inside = self.any_of()
            if not self.take(("mark", ")")):
                raise ValueError("a parenthesis isn't closed")
            return inside
        tokens = self.string()
        while self.take(("mark", "+")):
            tokens += self.string()
        prefix = self.take(("mark", "*"))
        return Node("phrase", Phrase(tuple(tokens), prefix)) if tokens else NOTHING

    def string(self) -> list[str]:
        kind, text = self.peek()
        if kind not in ("text", "word") or kind == "word" and text in ("AND", "OR", "NOT"):
            raise ValueError(f"a word is missing before {text!r}" if text else "a word is missing at the end")
        self.at += 1
        return fold(text)


def parse(query: str) -> Node:
    if not query.strip():
        raise ValueError("the query is empty")
    reader = _Reader(query)
    tree = reader.any_of()
    if reader.peek()[0] != "end":
        raise ValueError(f"not understood: {reader.peek()[1]!r}")
    return tree
