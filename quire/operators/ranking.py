"""BM25 over pages' phrases, whatever the hits come from: kept postings, or the texts themselves."""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import fold_long_s
from quire.operators.querylang import MARKED, PLAIN, Node, Phrase, parse

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without marks."""
    folded = F.translate(F.lower(fold_long_s(text)), MARKED, PLAIN)
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def places(found: Column, slot: tuple[str, bool]) -> Column:
    """Where the tokens that fit are in an array of tokens."""
    return F.array_compact(F.transform(found, lambda t, k: F.when(fits(t, slot), k)))


def fits(token: Column, slot: tuple[str, bool]) -> Column:
    return token.startswith(slot[0]) if slot[1] else token == slot[0]


def _leaves(tree: Node, above: tuple[Node, ...] | None = ()) -> list[tuple[Node, tuple[Node, ...] | None]]:
    """Phrase nodes from left to right, each with the nodes that have to match for it to count for the rank: None if it is ruled out."""
    if tree.phrase:
        return [(tree, above)]
    # Where a part of an OR matches the OR does.
    inside = above if above is None or tree.kind == "or" else (*above, tree)
    return [leaf for k, c in enumerate(tree.children) for leaf in _leaves(c, None if tree.kind == "not" and k else inside)]


@dataclass(frozen=True)
class Query:
    """A query with its ``slots``: the different words and prefixes, whose positions on a page are columns ``p0``, ``p1``, ..."""

    tree: Node
    leaves: list[tuple[Node, tuple[Node, ...] | None]]
    slots: list[tuple[str, bool]]

    @classmethod
    def of(cls, text: str) -> Query:
        tree = parse(text)
        leaves = _leaves(tree)
        return cls(tree, leaves, list(dict.fromkeys(s for leaf, _ in leaves for s in leaf.phrase.slots)))

    def _count(self, phrase: Phrase) -> Column:
        """How often a phrase is on a page."""
        starts = lambda at, k: F.transform(at, lambda p: p - F.lit(k))
        first, *others = (starts(f"p{self.slots.index(s)}", k) for k, s in enumerate(phrase.slots))
        return F.size(functools.reduce(F.array_intersect, others, first))

    def counted(self, hits: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and how often each phrase is on the page, ``tf0``, ``tf1``, ..."""
        return hits.select(*keep, *(self._count(leaf.phrase).alias(f"tf{k}") for k, (leaf, _) in enumerate(self.leaves)))

    def frequencies(self) -> list[Column]:
        """Aggregates of counted pages: those that have each phrase, ``df0``, ``df1``, ..."""
        return [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(self.leaves))]

    def matches(self, node: Node | None = None) -> Column:
        """Whether a page matches a node, or the whole query."""
        node = node or self.tree
        if node.phrase:
            return F.col(f"tf{next(k for k, (leaf, _) in enumerate(self.leaves) if leaf is node)}") > 0
        if node.kind == "nothing":
            return F.lit(False)
        found = [self.matches(c) for c in node.children]
        return found[0] & ~found[1] if node.kind == "not" else functools.reduce(operator.or_ if node.kind == "or" else operator.and_, found)

    def ranked(self, counted: DataFrame, key: list[str], n: int, mean: float | None, df) -> DataFrame:
        """key, rank (smaller is better) and score 1 / (1 + abs(rank)) of the pages that match.

        ``n`` pages of ``mean`` length make up the whole index; ``df`` has the frequencies.  A phrase counts where
        the parts of the query that it belongs to match.
        """
        rank = F.lit(0.0)
        for k, (_, above) in enumerate(self.leaves):
            if above is not None:
                idf = max(math.log((n - df[f"df{k}"] + 0.5) / (df[f"df{k}"] + 0.5)), 1e-6)
                tf = F.col(f"tf{k}")
                weight = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1.0))))
                counts = functools.reduce(operator.and_, (self.matches(a) for a in above), F.lit(True))
                rank = rank - F.when(counts, weight).otherwise(0.0)
        return counted.where(self.matches()).select(*key, rank.alias("rank")).withColumn("score", 1 / (1 + F.abs("rank")))
