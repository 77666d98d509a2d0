"""Text operators over page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.fixtures import oracle
from quire.functions import lineends as E
from quire.functions import text as T
from quire.operators import words as words_
from quire.registry import query

_HYPHEN = r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)"
#: One row per candidate: the k-th match and what lies before it.
_CANDIDATES = rf"""SELECT project_id, idx0, doc_id, raw_text, k, m, regexp_extract(m, '{_HYPHEN}', 1) AS prefix, regexp_extract(m, '{_HYPHEN}', 2) AS suffix,
  SUM(length(g)) OVER w + COALESCE(SUM(length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset
FROM (SELECT *, UNNEST(ms) AS m, UNNEST(gs[:len(ms)]) AS g, UNNEST(range(len(ms))) AS k FROM
  (SELECT *, regexp_extract_all(raw_text, '{_HYPHEN}') AS ms, string_split_regex(raw_text, '{_HYPHEN}') AS gs FROM fx_text) WHERE len(ms) > 0)
WINDOW w AS (PARTITION BY doc_id ORDER BY k)"""
_ID = "substr(sha1(prefix || chr(0) || suffix || chr(0) || CAST(CAST(char_offset AS BIGINT) AS VARCHAR)), 1, 16)"


@query(oracle("SELECT project_id, idx0, translate(raw_text, chr(8216)||chr(8217)||chr(8218)||chr(8219)||chr(8220)||chr(8221)||chr(8222)||chr(8223), '''''''''\"\"\"\"') AS page_text FROM fx_text", "fx_text"))
def straight_quotes(spark: SparkSession, d: str) -> DataFrame:
    return fx.text(spark, d).select("project_id", "idx0", T.straight_quotes(F.col("raw_text")).alias("page_text"))


@query(oracle("SELECT project_id, idx0, replace(raw_text, chr(8212), '--') AS page_text FROM fx_text", "fx_text"))
def plain_dashes(spark: SparkSession, d: str) -> DataFrame:
    return fx.text(spark, d).select("project_id", "idx0", T.plain_dashes(F.col("raw_text")).alias("page_text"))


@query(oracle("SELECT project_id, idx0, sha256(replace(translate(raw_text, chr(8216)||chr(8217)||chr(8218)||chr(8219)||chr(8220)||chr(8221)||chr(8222)||chr(8223), '''''''''\"\"\"\"'), chr(8212), '--')) AS text_sha256 FROM fx_text", "fx_text"))
def regex_stage(spark: SparkSession, d: str) -> DataFrame:
    """The default text stage, with the content hash of its output."""
    return fx.text(spark, d).select("project_id", "idx0", F.sha2(T.plain_dashes(T.straight_quotes(F.col("raw_text"))), 256).alias("text_sha256"))


SCANNOS = {"tbe": "the", "tbat": "that", "wbich": "which", "arid": "and"}


@query(
    oracle(
        r"""SELECT t.project_id, t.idx0, COALESCE(j.page_text, t.raw_text) AS page_text FROM fx_text t LEFT JOIN
(SELECT doc_id, string_agg(g || CASE m WHEN 'tbe' THEN 'the' WHEN 'tbat' THEN 'that' WHEN 'wbich' THEN 'which' WHEN 'arid' THEN 'and' ELSE m END, '' ORDER BY k) AS page_text FROM
 (SELECT doc_id, UNNEST(gs) AS g, UNNEST(list_concat(ms, [''])) AS m, UNNEST(range(len(gs))) AS k FROM
  (SELECT doc_id, regexp_extract_all(raw_text, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*') AS ms, string_split_regex(raw_text, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*') AS gs FROM fx_text)) GROUP BY doc_id) j
ON t.doc_id = j.doc_id""",
        "fx_text",
    )
)
def replace_scannos(spark: SparkSession, d: str) -> DataFrame:
    return fx.text(spark, d).select("project_id", "idx0", T.replace_scannos(F.col("raw_text"), SCANNOS).alias("page_text"))


@query(oracle(f"SELECT project_id, idx0, prefix, suffix, CAST(char_offset AS INT) AS char_offset, {_ID} AS candidate_id FROM c", "fx_text", c=_CANDIDATES))
def hyphen_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = fx.text(spark, d).select("project_id", "idx0", F.explode(T.hyphen_candidates(F.col("raw_text"))).alias("c"))
    return found.select("project_id", "idx0", "c.prefix", "c.suffix", "c.char_offset", "c.candidate_id")


@query(oracle("SELECT project_id, COUNT(*) AS total, COUNT(DISTINCT doc_id) AS pages FROM c GROUP BY project_id", "fx_text", c=_CANDIDATES))
def hyphen_totals(spark: SparkSession, d: str) -> DataFrame:
    """Undecided end-of-line hyphens by project: counts per page first, nothing but numbers is shuffled."""
    n = fx.text(spark, d).select("project_id", F.size(T.hyphen_candidates(F.col("raw_text"))).alias("n")).where("n > 0")
    return n.groupBy("project_id").agg(F.sum("n").cast("bigint").alias("total"), F.count("*").alias("pages"))


ALLOWED = ("ti-", "Ac")


@query(
    oracle(
        """SELECT t.project_id, t.idx0, COALESCE(j.page_text, t.raw_text) AS page_text FROM fx_text t LEFT JOIN
(SELECT doc_id, string_agg(g || CASE WHEN m = '' THEN '' WHEN lower(regexp_extract(m, '([\\p{L}\\p{N}_]+)-\\n([\\p{L}\\p{N}_]+)', 1)) IN ('ti', 'ac') THEN regexp_replace(m, '-\\n', '') ELSE m END, '' ORDER BY k) AS page_text FROM
 (SELECT doc_id, UNNEST(gs) AS g, UNNEST(list_concat(ms, [''])) AS m, UNNEST(range(len(gs))) AS k FROM
  (SELECT doc_id, regexp_extract_all(raw_text, '([\\p{L}\\p{N}_]+)-\\n([\\p{L}\\p{N}_]+)') AS ms, string_split_regex(raw_text, '([\\p{L}\\p{N}_]+)-\\n([\\p{L}\\p{N}_]+)') AS gs FROM fx_text)) GROUP BY doc_id) j
ON t.doc_id = j.doc_id""",
        "fx_text",
    )
)
def join_hyphens(spark: SparkSession, d: str) -> DataFrame:
    return fx.text(spark, d).select("project_id", "idx0", T.join_hyphens(F.col("raw_text"), ALLOWED).alias("page_text"))


_GAPS = f"SELECT doc_id, UNNEST(gs) AS g, UNNEST(range(len(gs))) AS k FROM (SELECT doc_id, string_split_regex(raw_text, '{_HYPHEN}') AS gs FROM fx_text)"


@query(
    oracle(
        """SELECT t.project_id, t.idx0, j.page_text FROM fx_text t JOIN
(SELECT g.doc_id, string_agg(g.g || CASE WHEN c.m IS NULL THEN '' WHEN CAST(c.char_offset AS BIGINT) % 2 = 0 THEN c.prefix || c.suffix ELSE c.m END, '' ORDER BY g.k) AS page_text
 FROM g LEFT JOIN c ON g.doc_id = c.doc_id AND g.k = c.k GROUP BY g.doc_id) j ON j.doc_id = t.doc_id""",
        "fx_text",
        c=_CANDIDATES,
        g=_GAPS,
    )
)
def apply_hyphen_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Candidates at even places are decided as joined; decisions come as a table, the last of each id counts."""
    text = fx.text(spark, d)
    found = text.select("doc_id", F.explode(T.hyphen_candidates(F.col("raw_text"))).alias("c"))
    decisions = found.select("doc_id", "c.candidate_id", F.when(F.col("c.char_offset") % 2 == 0, "join").otherwise("keep").alias("decision"), F.lit(1).alias("seq"))
    last = decisions.groupBy("doc_id", "candidate_id").agg(F.max_by("decision", "seq").alias("decision"))
    joined = last.where("decision = 'join'").groupBy("doc_id").agg(F.collect_list("candidate_id").alias("joined"))
    return text.join(joined, "doc_id", "left").select("project_id", "idx0", T.apply_joins(F.col("raw_text"), F.col("joined")).alias("page_text"))


@query(oracle(r"SELECT project_id, idx0, regexp_replace(regexp_replace(raw_text, ' ([:;!?,.])', '\1', 'g'), ' *— *', '--', 'g') AS page_text FROM fx_text", "fx_text"))
def regex_passes(spark: SparkSession, d: str) -> DataFrame:
    return fx.text(spark, d).select("project_id", "idx0", T.regex_passes(F.col("raw_text"), [(" ([:;!?,.])", "$1"), (" *— *", "--")]).alias("page_text"))


def post_processed(spark: SparkSession, d: str) -> DataFrame:
    """The whole post-process."""
    text = T.post_process(F.col("raw_text"), SCANNOS, {"is": "was"}, ALLOWED, [(" ([:;!?])", "$1")])
    return fx.text(spark, d).select("project_id", "idx0", text.alias("page_text"))


query(None)(post_processed)


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words of page text with boxes and confidences from their places."""
    lines = fx.text(spark, d).select("project_id", "idx0", "doc_id", F.posexplode(F.split("raw_text", "\n", -1)).alias("line", "t"))
    w = lines.select("project_id", "idx0", "doc_id", "line", F.posexplode(F.array_remove(F.split("t", " +"), "")).alias("k", "text"))
    n = F.length("text")
    return w.select(
        "project_id", "idx0", "doc_id", "line", "k", "text", (F.col("line") * 100_000 + F.col("k")).alias("word_id"), (10 + 40 * F.col("k")).alias("left"), (10 + 30 * F.col("line") + n % 3).alias("top"),
        (8 * n).alias("width"), (18 + n % 4).alias("height"), ((F.col("doc_id") * 31 + F.col("line") * 17 + F.col("k") * 7) % 100 / 100.0).alias("confidence"), ((F.col("doc_id") + F.col("k")) % 29 == 0).alias("deleted"),
    )


_WORDS = """SELECT project_id, idx0, doc_id, line, k, text, line * 100000 + k AS word_id, 10 + 40 * k AS "left", 10 + 30 * line + length(text) % 3 AS top, 8 * length(text) AS width, 18 + length(text) % 4 AS height,
 ((doc_id * 31 + line * 17 + k * 7) % 100) / 100.0 AS confidence, (doc_id + k) % 29 = 0 AS deleted FROM
 (SELECT project_id, idx0, doc_id, line, UNNEST(ws) AS text, UNNEST(range(len(ws))) AS k FROM
  (SELECT project_id, idx0, doc_id, line, list_filter(string_split_regex(t, ' +'), lambda x: x <> '') AS ws FROM
   (SELECT project_id, idx0, doc_id, UNNEST(ls) AS t, UNNEST(range(len(ls))) AS line FROM (SELECT *, string_split(raw_text, chr(10)) AS ls FROM fx_text))))"""


@query(oracle("SELECT project_id, CAST(COUNT(*) AS BIGINT) AS tokens FROM w WHERE NOT deleted AND confidence < 0.5 GROUP BY project_id", "fx_text", w=_WORDS))
def low_confidence_tokens(spark: SparkSession, d: str) -> DataFrame:
    return words_.low_confidence(_words(spark, d)).groupBy("project_id").agg(F.count("*").alias("tokens"))


_BAD = ", ".join(f"'{w}'" for w in (*words_.BAD_WORDS, "tbe"))


@query(oracle(f"SELECT project_id, idx0, CAST(word_id AS BIGINT) AS word_id, text FROM w WHERE text IN ({_BAD}) AND text <> 'bee'", "fx_text", w=_WORDS))
def wordcheck_flags(spark: SparkSession, d: str) -> DataFrame:
    good = spark.createDataFrame([("bee",)], "word string")
    return words_.flagged(_words(spark, d), (*words_.BAD_WORDS, "tbe"), good).select("project_id", "idx0", F.col("word_id").cast("bigint").alias("word_id"), "text")


@query(oracle(f"SELECT project_id, CAST(COUNT(*) FILTER (text IN ({_BAD})) AS BIGINT) AS flagged, CAST(COUNT(*) AS BIGINT) AS total_words FROM w GROUP BY project_id", "fx_text", w=_WORDS))
def wordcheck_summary(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("text").isin(*words_.BAD_WORDS, "tbe")
    return _words(spark, d).groupBy("project_id").agg(F.count_if(bad).alias("flagged"), F.count("*").alias("total_words"))


@query(
    oracle(
        f"""SELECT project_id, idx0, CAST(w.word_id AS BIGINT) AS word_id, COALESCE(dec.decision, 'open') AS status FROM (SELECT * FROM w WHERE text IN ({_BAD})) w LEFT JOIN
(SELECT word_id, arg_max(decision, seq) AS decision FROM (SELECT event_id AS seq, user_id * 100000 + event_id % 40 AS word_id, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'deferred' END AS decision FROM events) GROUP BY word_id) dec
ON dec.word_id = w.word_id""",
        "fx_text",
        w=_WORDS,
    )
)
def flag_projection(spark: SparkSession, d: str) -> DataFrame:
    """Flags with the last decision on each word."""
    from quire.tables import table

    kind = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("deferred")
    decisions = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 100_000 + F.col("event_id") % 40).alias("word_id"), kind.alias("decision"))
    flags = words_.flagged(_words(spark, d), (*words_.BAD_WORDS, "tbe")).select("project_id", "idx0", F.col("word_id").cast("bigint").alias("word_id"))
    return words_.decided(flags, decisions)


@query()
def page_text_from_words(spark: SparkSession, d: str) -> DataFrame:
    return words_.page_text(_words(spark, d))


@query(oracle("SELECT project_id, CAST(SUM(len(regexp_extract_all(raw_text, 'tbe|[Tt]h'))) AS BIGINT) AS matches FROM fx_text GROUP BY project_id", "fx_text"))
def regex_match_counts(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.listing import regex_match_counts as counts

    texts = fx.text(spark, d).select("project_id", F.lit(None).cast("string").alias("regex_text"), F.lit(None).cast("string").alias("review_text"), F.col("raw_text").alias("ocr_text"))
    return counts(texts, "tbe|[Tt]h")


@query(oracle("SELECT project_id, idx0, replace(raw_text, chr(383), 's') AS page_text FROM fx_text", "fx_text"))
def long_s_fold(spark: SparkSession, d: str) -> DataFrame:
    return fx.text(spark, d).select("project_id", "idx0", T.fold_long_s(F.col("raw_text")).alias("page_text"))


@query(
    """SELECT p_partkey, CASE WHEN trim(regexp_replace(regexp_replace(regexp_replace(p, '[\\\\/]', '_', 'g'), '[^a-zA-Z0-9\\-._() ]', '', 'g'), '\\.{2,}', '.', 'g'), '. _') = '' THEN 'fallback'
 ELSE trim(regexp_replace(regexp_replace(regexp_replace(p, '[\\\\/]', '_', 'g'), '[^a-zA-Z0-9\\-._() ]', '', 'g'), '\\.{2,}', '.', 'g'), '. _') END AS slug
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '../..' || chr(47) || p_name || '.' WHEN p_partkey % 7 = 0 THEN '??' ELSE p_brand || ' / ' || p_name END AS p FROM part)"""
)
def safe_slugs(spark: SparkSession, d: str) -> DataFrame:
    from quire.tables import table

    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("../../"), F.col("p_name"), F.lit("."))).when(F.col("p_partkey") % 7 == 0, "??").otherwise(F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", T.safe_slug(name, F.lit("fallback")).alias("slug"))


@query(
    """SELECT page_id, replace(regexp_replace(p, '\\.[^./]*$', ''), '/', '__') AS flat, regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '') AS stem, lower(regexp_extract(p, '\\.[^.]*$')) IN ('.png','.jpg','.jpeg','.jp2','.tif','.tiff') AS image
FROM (SELECT page_id, replace(regexp_replace(url, '^[a-z]+://', ''), chr(92), '/') || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '' END AS p FROM pages)"""
)
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    from quire.tables import table

    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.col("page_id") % 3 == 0, ".PNG").when(F.col("page_id") % 3 == 1, ".txt").otherwise(""))
    return table(spark, d, "pages").select("page_id", T.flat_stem(path).alias("flat"), T.file_stem(path).alias("stem"), T.is_image(path).alias("image"))


_ENDS = rf"""(?i)-\n((?:on|ing)(?:{"|".join(E.ENDINGS)})?(?:{E.PUNCTUATION.replace("'", "''")}{{1,4}}[^\s]*)?)[\n ]"""


@query(oracle(f"SELECT project_id, idx0, regexp_replace(regexp_replace(raw_text, '{_ENDS}', '\\1' || chr(10), 'g'), ' ([:;!?])', '\\1', 'g') AS page_text FROM fx_text", "fx_text"))
def joined_line_ends(spark: SparkSession, d: str) -> DataFrame:
    """Words broken before common endings put together, spaces before closing signs taken out."""
    text = E.close_up(E.join_endings(F.col("raw_text"), ["on", "ing"]))
    return fx.text(spark, d).select("project_id", "idx0", text.alias("page_text"))


@query(oracle("SELECT project_id, idx0, regexp_replace(regexp_replace(raw_text, ' *— *', '--', 'g'), ' *--{1,2} *', '--', 'g') AS page_text FROM fx_text", "fx_text"))
def tidied_dashes(spark: SparkSession, d: str) -> DataFrame:
    """Dashes of page text; no line of it ends or starts with one, which only lookarounds could say in SQL."""
    return fx.text(spark, d).select("project_id", "idx0", E.tidy_dashes(F.col("raw_text")).alias("page_text"))
