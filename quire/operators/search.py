"""Full-text search over page text without a kept index, and postings as a table.

A search reads the text of all pages twice, for the statistics and for the matches, and shuffles nothing; where
pages are searched again and again, ``textindex`` keeps postings and reads those of the query's words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ranking import Query, places, tokens


def postings(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, length, token, tf."""
    found = pages.select(*key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    exploded = found.select(*key, F.size("_t").alias("length"), F.explode("_t").alias("token"))
    return exploded.groupBy(*key, "length", "token").agg(F.count("*").alias("tf"))


def reindex(index: DataFrame, pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``index`` (as ``postings`` makes it) with the rows of ``pages`` in place of those it had of them."""
    return index.join(pages.select(*key).distinct(), key, "left_anti").unionByName(postings(pages, key, text))


def unindexed(clean: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Pages with clean text that the index hasn't got."""
    return clean.join(index, key, "left_anti")


def search_page(found: DataFrame, order: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows offset..offset+limit-1 of a search in order, each with the ``total``; at most 200 at a time."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("the limit is 1 to 200, the offset 0 at least")
    # The other side is one row.
    return found.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


def search(pages: DataFrame, query: str, key: list[str], project: str | None = None, text: str = "text") -> DataFrame:
    """Pages that match ``query`` in the language of ``querylang``: key, rank (smaller is better) and score 1 / (1 + |rank|).

    The statistics are those of all ``pages``, whatever the project, which is a value of the first key.
    """
    wanted = Query.of(query)
    found = pages.select(*key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    at = [places(F.col("_t"), s).alias(f"p{k}") for k, s in enumerate(wanted.slots)]
    counted = wanted.counted(found.select(*key, F.size("_t").alias("length"), *at), *key, "length")
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *wanted.frequencies()).first()
    if project is not None:
        counted = counted.where(F.col(key[0]) == project)
    return wanted.ranked(counted, key, stats["n"], stats["mean"], stats)


def phrase_search(pages: DataFrame, phrase: str, key: list[str], text: str = "text") -> DataFrame:
    """Pages that have the words of ``phrase`` one after the other, ranked with the phrase as a term."""
    return search(pages, '"' + phrase.replace('"', " ") + '"', key, text=text)


def snippet(text: Column, term: str, width: int = 15) -> Column:
    """``width`` words around the first one that is ``term``, with dots where text is left out."""
    found = F.array_remove(F.split(text, r"\s+"), "")
    at = F.greatest(F.array_position(F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")), term) - F.lit(width // 2 + 1), F.lit(0)).cast("int")
    body = F.array_join(F.slice(found, at + 1, F.lit(width)), " ")
    return F.concat(F.when(at > 0, "...").otherwise(""), body, F.when(F.size(found) > at + width, "...").otherwise(""))
