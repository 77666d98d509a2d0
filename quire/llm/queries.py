"""The query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import audit, chat, decontamination, html, jaccard, lines, packing, quality, secrets, simhash, toxicity, urls, vectorcode
from quire.llm._common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"), tokenizer())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digest(chat.format_chat(turns.unionByName(extra)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(read(spark, sf_dir, "documents")))


#: Words of hosts whose urls are labelled as blocked; other urls are labelled as allowed.
BLOCKED_HOSTS = "adult|bets|casino|pills|spam|ads-"


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urls.split_url(F.col("url"))
    return urls.url_filter(pages, pages.select("url", host.rlike(BLOCKED_HOSTS).cast("int").alias("label")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.vector_codes(read(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_best_fit_packing, op4_html_extraction, op5_benchmark_decontamination, op6_chat_formatting, op7_secret_scan, op8_url_filter, op9_toxicity, op10_ngram_jaccard_join, op11_simhash_near_dedup, op12_vector_codes, op13_filter_audit)}
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _lloyd(rounds: int) -> str:
    """Assignments a0, a1, .. of parts p to codebooks b0, b1, .., each made from the assignment before."""
    steps = []
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{k} AS MATERIALIZED (SELECT rn, j, min({{'d': d, 'e': e}}) AS best FROM (SELECT p.rn, p.j, b.e, {distance} AS d FROM p JOIN b{k} b ON b.j = p.j) GROUP BY rn, j)")
        if k < rounds:
            sums = f"SELECT a.j, a.best.e AS e, i, sum(p.x[i]) AS s, count(*) AS n FROM a{k} a JOIN p ON p.rn = a.rn AND p.j = a.j, range(1, len(p.x) + 1) t(i) GROUP BY a.j, a.best.e, i"
            means = f"SELECT j, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM ({sums}) GROUP BY j, e"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN ({means}) m ON m.j = b.j AND m.e = b.e)")
    return ",\n".join(steps)


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

ORACLES = {
    "op6_chat_formatting": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
numbered AS (
  SELECT *, row_number() OVER w AS k, sum(24 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM numbered GROUP BY conv_id""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.shared >= 80 * (x.n + y.n - p.shared)),
reached AS (SELECT doc_id, doc_id AS near FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.near)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.low AS component_id FROM documents d
LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, min(near) AS low FROM reached GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op12_vector_codes": f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id, v) AS rn FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT rn, j, v[j * (len(v) // 8) + 1 : (j + 1) * (len(v) // 8)] AS x FROM k, range(8) t(j)),
b0 AS MATERIALIZED (SELECT j, rn - 1 AS e, x AS c FROM p WHERE rn <= 16),
{_lloyd(6)},
coded AS (SELECT rn, string_agg(format('{{:02x}}', best.e), '' ORDER BY j) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a6 GROUP BY rn)
SELECT k.vec_id, coded.code, coded.error, CAST(sum(coded.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM b6) AS codebooks_sha256
FROM k JOIN coded ON coded.rn = k.rn""",
    "op13_filter_audit": """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
failed AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failed LEFT JOIN marks ON marks.doc_id = failed.doc_id GROUP BY part, mask),
letters AS (SELECT chr(CAST(65 + k AS INT)) AS f, CAST(1 << k AS INT) AS bit FROM range(5) t(k)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, CAST(sum(CASE WHEN instr(filter_order, f) = s THEN bit ELSE 0 END) AS INT) AS here, CAST(sum(CASE WHEN instr(filter_order, f) < s THEN bit ELSE 0 END) AS INT) AS before
  FROM orders, range(1, 6) t(s), letters GROUP BY filter_order, s),
each AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, coalesce(sum(n) FILTER (mask & (here | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & here > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & here > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = here), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & here > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & here > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM each""",
}
