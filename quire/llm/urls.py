"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest.

The trees see no words of the url, only its shape: lengths, depth, digits, entropy, parameters, labels of
the host and how often urls with the same (hashed) suffix were blocked among the labelled ones.  They are
fitted on a bounded sample of labelled urls, ``SAMPLE`` rows with the smallest hashes, the same at any size
of input; every url is judged.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
its shape like any other.  Repeated urls are separate rows.  Without labelled urls of both kinds the method
allows.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import materialize

#: (verdict, host, path); the longest that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SAMPLE = 8_000
SUFFIXES = 64
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "longest_label", "hyphens", "host_digits", "digit_ratio", "entropy", "vowel_ratio", "parameters", "query_length", "fragment", "secure", "suffix_rate")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features (but suffix_rate) and the suffix's bucket to ``url``, ``host`` and ``path``."""
    u = F.coalesce(F.col("url"), F.lit(""))
    share = lambda n, of: n / F.greatest(of, F.lit(1))
    out = urls.withColumn("_chars", F.split("host", "")).withColumn("_labels", F.split("host", r"\."))
    p = lambda c: F.size(F.filter("_chars", lambda x: x == c)) / F.size("_chars")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return out.select(
        *urls.columns,
        F.length(u).alias("url_length"),
        F.length("host").alias("host_length"),
        F.length("path").alias("path_length"),
        F.size(F.array_remove(F.split("path", "/"), "")).alias("depth"),
        F.size("_labels").alias("host_labels"),
        F.array_max(F.transform("_labels", lambda x: F.length(x))).alias("longest_label"),
        F.regexp_count("host", F.lit("-")).alias("hyphens"),
        F.regexp_count("host", F.lit("[0-9]")).alias("host_digits"),
        share(F.regexp_count(u, F.lit("[0-9]")), F.length(u)).alias("digit_ratio"),
        F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda a, c: a - p(c) * F.log2(p(c))).alias("entropy"),
        share(F.regexp_count("host", F.lit("[aeiou]")), F.length("host")).alias("vowel_ratio"),
        F.regexp_count(query, F.lit("=")).alias("parameters"),
        F.length(query).alias("query_length"),
        F.contains(u, F.lit("#")).cast("int").alias("fragment"),
        u.startswith("https").cast("int").alias("secure"),
        F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(SUFFIXES)).cast("int").alias("suffix"),
    )


def url_filter(urls: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per url: key, host, path, rule, verdict and ``p_block``.

    ``labelled`` has the columns url and label (1: block).
    """
    host, path = split_url(F.col("url"))
    known = labelled.select("url", F.col("label").cast("double").alias("label")).where("label is not null").dropDuplicates(["url"])
    known = known.orderBy(F.xxhash64("url"), "url").limit(sample)
    known = materialize(features(known.withColumn("host", host).withColumn("path", path)).coalesce(2))
    rates = {r["suffix"]: (r["n"], r["s"]) for r in known.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect()}
    n, blocked = sum(a for a, _ in rates.values()), sum(b for _, b in rates.values())
    base = blocked / n if n else 0.0
    rate = F.element_at(F.array(*[F.lit(float((s + 20 * base) / (a + 20))) for a, s in (rates.get(k, (0, 0.0)) for k in range(SUFFIXES))]), F.col("suffix") + 1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = urls.select(F.col(key).alias(key), F.col(url).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rows = features(rows).withColumn("suffix_rate", rate)
    if 0 < blocked < n:
        trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.2, seed=7, featuresCol="features", labelCol="label")
        scored = trees.fit(vectors.transform(known.withColumn("suffix_rate", rate)).select("features", "label")).transform(vectors.transform(rows))
        scored = scored.withColumn("p_block", vector_to_array("probability")[1])
    else:
        scored = rows.withColumn("p_block", F.lit(base))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select(key, "host", "path", name.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "p_block")
