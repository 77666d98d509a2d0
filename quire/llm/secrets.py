"""Secret scans: three fixed patterns, and a battery of randomness tests for everything else.

Candidates are maximal runs of 20 or more key characters, also right after an equals sign.  A candidate's encoding
is inferred from its characters (decimal and hex digits, base32, letters and digits, base64).  Under the
hypothesis that it is a uniformly random string of that alphabet, three tests give p-values: chi-squared
uniformity, the runs test about the middle of the alphabet, and lag-one serial correlation; Fisher's method
combines them.  A weighted Benjamini-Hochberg procedure over all candidates of the corpus, with weights in
proportion to length because longer strings test with more power, rejects the strings that are not random;
those it cannot reject are reported as spans of kind ``random``.

All counts cover the whole corpus: the procedure needs the number of p-values up to each of at most
``BINS`` thresholds, a table of fixed size.

Edge cases: a null text is empty and has no span.  Repeated rows are separate rows.  An empty table gives an
empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import materialize

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the pattern's characters passes if it is long enough, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*"
ALPHA = 0.05
BINS = 2000
#: (pattern of the whole string, characters in the order of their values)
ENCODINGS = (
    (r"^[0-9]+$", "0123456789"),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
_SPANS = "array<struct<start:int,order:int,kind:string,end:int,p:double,n:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def find(text: Column, pattern: str, kind: str, order: int, passes: Callable[[Column], Column] | None = None, p: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches with their places: what splitting at the pattern leaves gives the gaps before each match."""

    def step(a: Column, x: Column) -> Column:
        m, start = x["m"], a["at"] + F.length(x["gap"])
        end = start + F.length(m)
        value = p(m) if p else F.lit(None).cast("double")
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("p"), F.length(m).alias("n")))
        more = F.concat(a["spans"], one)
        return F.struct(end.alias("at"), (F.when(passes(m), more).otherwise(a["spans"]) if passes else more).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    made = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), none, step)["spans"]
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(_SPANS))


def _upper_tail(z: Column) -> Column:
    """Of the normal distribution, by a logistic function; its error is below 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * F.pow(z, F.lit(3.0))))


def _tests(x: Column, k: int) -> Column:
    """Fisher's combination of the three tests on the values ``x`` in 0..k-1."""
    n = F.size(x).cast("double")
    middle, mean = (k - 1) / 2, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda w: w == v)).cast("double"), F.lit(2.0)))
    chi, df = squares * k / n - n, k - 1
    uniform = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = F.size(F.filter(x, lambda v: v > middle)).cast("double")
    low = n - high
    runs = 1 + F.size(F.filter(x, lambda v, i: (i > 0) & ((v > middle) != (F.get(x, i - 1) > middle)))).cast("double")
    expected = 2 * high * low / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    of_runs = 2 * _upper_tail(F.abs(runs - expected) / spread)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v - mean, F.lit(2.0)))
    lagged = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("last")), lambda a, v: F.struct((a["s"] + F.coalesce((v - mean) * (a["last"] - mean), F.lit(0.0))).alias("s"), v.cast("double").alias("last")))["s"]
    serial = 2 * _upper_tail(F.abs((lagged / F.greatest(total, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))
    half = -(F.log(F.greatest(uniform, F.lit(1e-30))) + F.log(F.greatest(of_runs, F.lit(1e-30))) + F.log(F.greatest(serial, F.lit(1e-30))))
    return F.least(F.exp(-half) * (1 + half + half * half / 2), F.lit(1.0))


def p_random(token: Column) -> Column:
    """How well a string agrees with being random in its inferred encoding."""
    token = F.rtrim(token, F.lit("="))
    out = None
    for pattern, alphabet in reversed(ENCODINGS):
        p = _let(F.filter(_values(token, alphabet), lambda v: v >= 0), _battery(len(alphabet)))
        out = p if out is None else F.when(token.rlike(pattern), p).otherwise(out)
    return out


def _values(token: Column, alphabet: str) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


def _battery(k: int) -> Callable[[Column], Column]:
    return lambda x: _tests(x, k)


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``random``, arrays of (start, order, kind, end, p, n)."""
    t = F.col("t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = materialize(
        rows.select(
            "doc_id",
            find(t, ASSIGN, "assign", 1, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE).alias("assign"),
            find(t, ACCESS, "access", 2).alias("access"),
            find(t, HEX, "hex", 3).alias("hex"),
            find(t, CANDIDATE, "random", 4, None, p_random).alias("random"),
        )
    )
    limit = threshold(rows.select(F.explode("random").alias("c")).select("c.p", "c.n"), alpha)
    base = F.sort_array(F.concat("assign", "access", "hex"))
    new = F.filter("random", lambda c: (c["p"] > limit * c["n"]) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("doc_id", base.alias("base"), "random").select("doc_id", "base", new.alias("random"))


def threshold(tests: DataFrame, alpha: float = ALPHA) -> float:
    """Weighted Benjamini-Hochberg over (p, n): the largest t with t * N <= alpha * #{p / w <= t}, divided by the mean length."""
    total = tests.agg(F.count("*").alias("m"), F.avg("n").alias("mean")).first()
    if not total["m"]:
        return 0.0
    q = F.greatest(F.col("p") * total["mean"] / F.col("n"), F.lit(1e-20))
    # Bin b holds q in (10 ** -((b + 1) / 100), 10 ** -(b / 100)].
    bins = tests.select(F.least(F.floor(-100 * F.log10(F.least(q, F.lit(1.0)))), F.lit(BINS - 1)).cast("int").alias("b")).groupBy("b").count()
    upto = bins.withColumn("c", F.sum("count").over(Window.orderBy(F.desc("b")))).withColumn("t", F.pow(F.lit(10.0), -F.col("b") / 100))
    found = upto.where(F.col("t") * total["m"] <= alpha * F.col("c")).agg(F.max("t").alias("t")).first()["t"]
    return (found or 0.0) / total["mean"]


def digest(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    every = listed(F.sort_array(F.concat("base", "random")))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed("base"), 256).alias("base_sha256"), every.alias("spans"))
