r"""Line dedup: maximal runs of lines that occur earlier in the corpus are deleted.

The corpus is one sequence of line ids, documents in order of their ids, none crossing into the next.  A
suffix starts at every line that occurs twice or more; lines that occur once part the sequence.

1. Prefix doubling: the name of a suffix's first 2**(k+1) lines is made of the names of 2**k lines there and
   2**k lines further on, one join on the place a level, until no name occurs twice.
2. Suffixes that share their first ``l`` lines are an interval of the suffix array, one with an LCP value of
   ``l`` at least.  The intervals are found from the longest names down.  In a round, the suffixes of each
   interval with the same name of the next 2**k lines form a narrower one.  Its earliest suffix stays in the
   wider one and is a witness in the narrower; the others, which have an earlier copy, move in.
3. After the last round each suffix is in the deepest interval that has an earlier suffix, and ``l`` is the
   longest run starting there that occurs earlier.

The order of suffixes inside an interval is never used, only which of them is earliest, so intervals are
named and not sorted: a round is a grouped minimum, combined before its shuffle, and a join that Spark
splits where a name is frequent.  Every step works on rows of single lines; no document is gathered.

A run is deleted with all its lines if it has at least ``min_words`` words.  In shorter runs the lines that
occur at least ``many`` times in the corpus are deleted.  The earliest copy stays.  Texts that lose no line
are not shuffled.

Edge cases: lines are parted by ``\n`` and compared as they are; blank lines (white space only) are no part
of a run, and those inside a deleted run go with it.  Null texts have no lines and stay null.  Rows with the
same id and text are one document, though each counts for ``many``; same id and different text are two,
ordered by hash.  Null ids come first; ids may be of any type that can be ordered.  An empty table gives an
empty result.  Columns other than id and text are passed on untouched; input columns named ``n_lines`` or
``n_deleted`` give way to the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm._common import SPACE, Tables, marked

MIN_WORDS = 10
#: Times a line occurs in the corpus from which its later copies go however short they are.
MANY = 50
#: A document, by hashes of its id and of its text.
_DOC = ["_g", "_h"]
#: What a suffix carries along: its document's id, the line's number, the words ahead of it and whether the line occurs so often.
_OWN = ["_d", "line", "ahead", "many"]


def _hash(*columns) -> list[Column]:
    """128 bits, as two hashes with different seeds."""
    return [F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b")]


def _key(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(F.col(doc_id), F.lit("id")).alias("_g"), F.xxhash64(F.col(text)).alias("_h")]


def line_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with a word: document (_g, _h, _d), ``seq`` among these lines, ``line``, words ``w`` and the line's name (a, b)."""
    line = lambda x, i: F.struct(i.alias("line"), F.size(F.array_remove(F.split(x, SPACE), "")).alias("w"), *_hash(x))
    full = F.filter(F.transform(F.split(F.col(text), "\n", -1), line), lambda s: s["w"] > 0)
    found = docs.select(*_key(doc_id, text), F.col(doc_id).alias("_d"), F.posexplode(full).alias("seq", "x"))
    return found.select(*_DOC, "_d", "seq", "x.line", "x.w", "x.a", "x.b")


def suffixes(lines: DataFrame, tables: Tables, many: int = MANY) -> DataFrame:
    """Lines that occur twice or more, with the words ahead of them among these lines in their document."""
    # Stored, so that Spark can split the join where a line is frequent.
    often = tables.store(lines.groupBy("a", "b").count().where("count > 1").select("a", "b", (F.col("count") >= many).alias("many")))
    repeated = lines.join(often, ["a", "b"]).dropDuplicates([*_DOC, "seq"])
    upto = F.sum("w").over(Window.partitionBy(*_DOC).orderBy("seq"))
    return repeated.select(*_DOC, "seq", "_d", "line", (upto - F.col("w")).cast("long").alias("ahead"), "many", "w", "a", "b")


def names(first: DataFrame, tables: Tables) -> list[DataFrame]:
    """By level k the suffixes with 2**k lines, and the names of these (a, b)."""
    levels = [first]
    while True:
        half = 1 << (len(levels) - 1)
        last = levels[-1]
        further = last.select(*_DOC, (F.col("seq") - half).alias("seq"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        doubled = last.join(further, [*_DOC, "seq"]).select(*_DOC, "seq", *_OWN, *_hash("a", "b", "a2", "b2"))
        doubled = tables.store(doubled)
        if doubled.groupBy("a", "b").count().where("count > 1").isEmpty():
            tables.drop(doubled)
            return levels
        levels.append(doubled)


def longest_earlier_runs(levels: list[DataFrame], tables: Tables) -> DataFrame:
    """Suffixes whose first ``l`` lines occur earlier, with the largest such ``l``."""
    own = F.struct("_d", "_h", "_g", "seq")
    inside = None
    for k in reversed(range(len(levels))):
        level = levels[k].select(*_DOC, "seq", *_OWN, "a", "b")
        zero = F.lit(0).cast("long")
        fresh = level if inside is None else level.join(inside.where("not witness"), [*_DOC, "seq"], "left_anti")
        narrower = fresh.select(*_DOC, "seq", *_OWN, F.lit(0).alias("l"), F.lit(False).alias("witness"), *_hash(zero, zero, "a", "b"))
        if inside is not None:
            next_name = level.select(*_DOC, F.col("seq").alias("at"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            deeper = inside.withColumn("at", F.col("seq") + F.col("l")).join(next_name, [*_DOC, "at"])
            narrower = narrower.unionByName(deeper.select(*_DOC, "seq", *_OWN, "l", "witness", *_hash("a", "b", "a2", "b2")))
        narrower = tables.store(narrower)
        # Stored, so that the join below is one of two shuffles and can be split where a name is frequent.
        first = tables.store(narrower.groupBy("a", "b").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
        met = narrower.join(first, ["a", "b"]).withColumn("witness", own <= F.col("first")).withColumn("l", (F.col("l") + (1 << k)).cast("int")).drop("first").dropDuplicates([*_DOC, "seq", "l", "witness"])
        now = met
        if inside is not None:
            # A witness stays in the wider interval too.
            now = tables.store(met)
            still = inside.join(now.where("not witness").select(*_DOC, "seq", F.lit(False).alias("witness")), [*_DOC, "seq", "witness"], "left_anti")
            now = now.unionByName(still)
        done, inside = inside, tables.store(now)
        tables.drop(narrower, first, *([done] if done is not None else []))
    return inside.where("not witness").select(*_DOC, "seq", *_OWN, "l")


def repeated_runs(docs: DataFrame, tables: Tables, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", many: int = MANY) -> DataFrame:
    """_g, _h and ``runs``: (first line, last line) of the stretches to delete, in order and apart."""
    lines = tables.store(line_ids(docs, doc_id, text))
    every = tables.store(suffixes(lines, tables, many))
    tables.drop(lines)
    levels = names(every, tables)
    found = longest_earlier_runs(levels, tables)
    ends = every.select(*_DOC, F.col("seq").alias("end"), F.col("line").alias("last"), (F.col("ahead") + F.col("w")).alias("upto"))
    found = found.withColumn("end", F.col("seq") + F.col("l") - 1).join(ends, [*_DOC, "end"])
    enough = F.col("upto") - F.col("ahead") >= min_words
    found = found.where(enough | F.col("many")).select(*_DOC, F.col("line").alias("first"), F.when(enough, F.col("last")).otherwise(F.col("line")).alias("last"))
    before = Window.partitionBy(*_DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.col("first") > F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).cast("int")
    upto = Window.partitionBy(*_DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    stretches = found.withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(upto)).groupBy(*_DOC, "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = tables.store(stretches.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")))
    tables.drop(every, *levels)
    return runs


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", many: int = MANY) -> DataFrame:
    """``docs`` with later copies of repeated runs taken out of ``text``; adds ``n_lines`` and ``n_deleted``."""
    runs = repeated_runs(docs, Tables(docs.sparkSession), min_words, doc_id, text, many)
    # The row travels as one struct, so that no column of its own clashes with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), *_key(doc_id, text))
    rows = marked(rows, runs, *_DOC)
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone), lambda i: F.get(F.col("_lines"), i))
    changed = rows.where("_hit").join(runs, _DOC, "left").withColumn("_lines", F.split("_text", "\n", -1)).withColumn("_kept", F.when(F.col("runs").isNotNull(), kept))
    new = F.when(F.col("_kept").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    changed = changed.select("_row", new.alias("_text"), F.size("_lines").alias("n"), F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).alias("gone"))
    same = rows.where("not _hit").select("_row", "_text", (F.regexp_count("_text", F.lit("\n")) + 1).alias("n"), F.lit(0).alias("gone"))
    return same.union(changed).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in (text, "n_lines", "n_deleted")],
        F.col("_text").alias(text),
        F.when(F.col("_text").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.col("gone").cast("long").alias("n_deleted"),
    )
