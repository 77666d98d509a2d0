"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import search as S
from quire.operators import snippets
from quire.operators import textindex as T
from quire.operators.querylang import MARKED, PLAIN
from quire.registry import query
from quire.tables import exists, kept_folder, table

_MARKS = f"translate(lower(replace(text, 'ſ', 's')), '{MARKED}', '{PLAIN}')"
_TOKENS = f"SELECT doc_id, source, list_filter(string_split_regex({_MARKS}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents"
KEY = ["source", "doc_id"]


def kept_index(spark: SparkSession, d: str) -> T.TextIndex:
    """The index of all documents, made when they are first searched and kept while their files stay the same."""
    folder = kept_folder(spark, d, "documents", "text-index")
    if exists(spark, f"{folder}/manifest/1/_SUCCESS"):
        return T.opened(spark, folder)
    return T.build(table(spark, d, "documents").select("source", "doc_id", "text"), folder, KEY)


_POSTINGS = "SELECT source, doc_id, token, COUNT(*) AS tf, MIN(place) AS first FROM (SELECT source, doc_id, t[i] AS token, i - 1 AS place FROM d, range(1, len(t) + 1) r(i)) GROUP BY source, doc_id, token"


@query(f"WITH d AS ({_TOKENS}), p AS ({_POSTINGS}) SELECT left(token, 2) AS start, COUNT(*) AS postings, CAST(SUM(tf) AS BIGINT) AS occurrences, CAST(SUM(first) AS BIGINT) AS firsts FROM p GROUP BY 1")
def text_index(spark: SparkSession, d: str) -> DataFrame:
    """What the kept index holds, by the first two letters of its tokens."""
    rows = kept_index(spark, d).postings()
    return rows.groupBy(F.substring("token", 1, 2).alias("start")).agg(F.count("*").alias("postings"), F.sum(F.size("positions")).alias("occurrences"), F.sum(F.col("positions")[0]).alias("firsts"))


_BM25 = f"""WITH d AS ({_TOKENS}), s AS (SELECT COUNT(*) AS n, AVG(len(t)) AS mean FROM d),
p AS (SELECT doc_id, source, len(t) AS length, k, len(list_filter(t, lambda x: x = w)) AS tf FROM d, (VALUES (0, 'idiot'), (1, 'the')) q(k, w)),
f AS (SELECT k, COUNT(*) AS df FROM p WHERE tf > 0 GROUP BY k),
r AS (SELECT doc_id, source, -SUM(greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / s.mean))) AS rank, COUNT(*) AS terms FROM p JOIN f USING (k), s WHERE tf > 0 GROUP BY doc_id, source)
"""


@query(_BM25 + "SELECT doc_id, source, ROUND(rank, 6) AS rank, ROUND(1 / (1 + abs(rank)), 6) AS score FROM r WHERE terms = 2")
def page_search(spark: SparkSession, d: str) -> DataFrame:
    """All pages with both words, ranked by BM25 over the whole index."""
    found = T.search(kept_index(spark, d), "idiot the")
    return found.select("doc_id", "source", F.round("rank", 6).alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH d AS ({_TOKENS}) SELECT doc_id, CAST(len(t) AS INT) AS length, tok AS token, COUNT(*) AS tf FROM (SELECT doc_id, t, UNNEST(t) AS tok FROM d) GROUP BY doc_id, len(t), tok")
def search_postings(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@query()
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("idiot")))
    return docs.select("doc_id", S.snippet(F.col("text"), "idiot").alias("snippet"))


_SORTED = f"{_BM25}, t AS (SELECT doc_id, ROUND(rank, 6) AS rank FROM r WHERE terms = 2)"


@query(_SORTED + " SELECT doc_id, rank, (SELECT COUNT(*) FROM t) AS total FROM t ORDER BY rank, doc_id LIMIT 20 OFFSET 10")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten of a search, twenty rows long, with the number of all."""
    found = T.search(kept_index(spark, d), "idiot the")
    return S.search_page(found.select("doc_id", F.round("rank", 6).alias("rank")), ["rank", "doc_id"], 10, 20)


@query(
    f"""WITH d AS ({_TOKENS}), c AS (SELECT doc_id, len(t) AS length, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf FROM d),
s AS (SELECT COUNT(*) AS n, AVG(length) AS mean, COUNT(*) FILTER (tf > 0) AS df FROM c)
SELECT doc_id, ROUND(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS rank FROM c, s WHERE tf > 0"""
)
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    found = T.search(kept_index(spark, d), '"Of the"')
    return found.select("doc_id", F.round("rank", 6).alias("rank"))


_AGAIN = _TOKENS.replace("FROM documents", "FROM (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN text || ' added line' ELSE text END AS text FROM documents)")


@query(f"WITH d AS ({_AGAIN}) SELECT doc_id, CAST(len(t) AS INT) AS length, tok AS token, COUNT(*) AS tf FROM (SELECT doc_id, t, UNNEST(t) AS tok FROM d) GROUP BY doc_id, len(t), tok")
def reindexed_postings(spark: SparkSession, d: str) -> DataFrame:
    """The index after the text of one page in ten was changed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    changed = docs.where("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" added line")))
    return S.reindex(S.postings(docs, ["doc_id"]), changed, ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 7 = 0")
def unindexed_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return S.unindexed(docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 7 <> 0"), ["doc_id"])


def _counts(*phrases: str) -> str:
    """SQL for how often each phrase is in the tokens ``t``; a last * makes a prefix."""
    found = []
    for phrase in phrases:
        words = phrase.split()
        fits = [f"starts_with(t[i + {k}], '{w[:-1]}')" if w.endswith("*") else f"t[i + {k}] = '{w}'" for k, w in enumerate(words)]
        found.append(f"len(list_filter(range(1, len(t) - {len(words) - 2}), lambda i: {' AND '.join(fits)}))")
    return ", ".join(f"{f} AS tf{k}" for k, f in enumerate(found))


def _ranked(phrases: list[str], condition: str, weighed: list[tuple[int, str]] | None = None, where: str = "TRUE") -> str:
    """SQL of a search: ``condition`` over tf0, tf1, ..; ``weighed`` are phrases and when they count for the rank, all by default."""
    weighed = [(k, "TRUE") for k in range(len(phrases))] if weighed is None else weighed
    df = ", ".join(f"COUNT(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(phrases)))
    rank = " + ".join(f"CASE WHEN {when} THEN greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * (tf{k} * 2.2) / (tf{k} + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END" for k, when in weighed)
    return f"""WITH d AS ({_TOKENS}), c AS (SELECT doc_id, source, len(t) AS length, {_counts(*phrases)} FROM d),
s AS (SELECT COUNT(*) AS n, AVG(length) AS mean, {df} FROM c) SELECT source, doc_id, ROUND(-({rank}), 6) AS rank FROM c, s WHERE ({condition}) AND {where}"""


def _search(spark: SparkSession, d: str, text: str, project: str | None = None) -> DataFrame:
    return T.search(kept_index(spark, d), text, project).select("source", "doc_id", F.round("rank", 6).alias("rank"))


@query(_ranked(["idiot", "avec"], "tf0 > 0 OR tf1 > 0"))
def or_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "idiot OR avec")


@query(_ranked(["the", "that", "this"], "tf0 > 0 AND NOT (tf1 > 0 OR tf2 > 0)", [(0, "TRUE")]))
def not_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "the NOT (that OR this)")


@query(_ranked(["in the", "than", "nd*"], "(tf0 > 0 AND tf1 > 0) OR (tf1 > 0 AND tf2 > 0)", [(0, "tf1 > 0"), (1, "tf0 > 0"), (1, "tf2 > 0"), (2, "tf1 > 0")]))
def mixed_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, words, a prefix, AND and OR; a word that the query has twice counts for each part that matches."""
    return _search(spark, d, '"in the" AND than OR than nd*')


@query(_ranked(["t*", "th er*"], "tf0 > 0 AND tf1 > 0"))
def prefix_search(spark: SparkSession, d: str) -> DataFrame:
    """A prefix of one letter, which reads every bucket, and one at the end of a phrase."""
    return _search(spark, d, "t* th + er*")


@query(_ranked(["the", "of"], "tf0 > 0 AND tf1 > 0", where="source = (SELECT MIN(source) FROM documents)"))
def project_search(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one project, ranked by the statistics of all."""
    first = table(spark, d, "documents").agg(F.min("source")).first()[0]
    return _search(spark, d, "of the", first)


_CHANGED = "SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN text || ' added line' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3"


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Documents after one in ten was edited and one in ten taken away."""
    docs = table(spark, d, "documents").select("source", "doc_id", "text").where("doc_id % 10 <> 3")
    return docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" added line"))).otherwise(F.col("text")))


@query("SELECT source, doc_id, CASE WHEN doc_id % 10 = 3 THEN 'orphan' ELSE 'changed' END AS reason FROM documents WHERE doc_id % 10 IN (0, 3)")
def index_repairs(spark: SparkSession, d: str) -> DataFrame:
    """What a repair has to do after pages were edited and taken away: found by the hashes that the index keeps."""
    return T.missing(kept_index(spark, d), _changed(spark, d))


@query(f"WITH d AS ({_TOKENS.replace('FROM documents', f'FROM ({_CHANGED})')}) {_POSTINGS}")
def repaired_index(spark: SparkSession, d: str) -> DataFrame:
    """The index after a repair, which tokenizes nothing but the pages that differ."""
    folder = kept_folder(spark, d, "documents", "repaired-index")
    before = T.build(table(spark, d, "documents").select("source", "doc_id", "text"), folder, KEY)
    after = T.repaired(before, _changed(spark, d))
    return after.postings().select("source", "doc_id", "token", F.size("positions").cast("long").alias("tf"), F.col("positions")[0].cast("long").alias("first"))


@query()
def found_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a search of several phrases finds, with the words that show most of them; compared with another engine's in tests."""
    text = '"in the" AND than OR than nd*'
    return snippets.with_snippets(T.search(kept_index(spark, d), text), table(spark, d, "documents"), text, KEY).select("source", "doc_id", "snippet")
