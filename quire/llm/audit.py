"""Filter interaction audit: what each of five filters removes, and what of it others would have removed, in every order.

1. Copies by sorting: rows are range-partitioned by fingerprint and doc_id and sorted by fingerprint, full text
   and doc_id, so a group of copies is spread over as many tasks as it needs.  Each row is compared with its
   predecessor; a row fails if its text has a smaller id before it.
2. Boundaries: a group that runs on over the end of a partition has its smaller ids in the partitions before.
   Each partition tells the smallest id of each text under its last fingerprint, as a SHA-256 of the text; that is a row a
   partition (more only where fingerprints of different texts collide), which goes to all tasks.
3. The failures of a document are a mask of five bits.  Masks are counted by part and label, and these counters, at
   most 32 a part, give all figures for all 120 orders, since every figure is a sum over masks.  A filter's Shapley
   sum needs no order: of the orders of the filters that a document fails, one in so many has the filter first.

Edge cases: a null text is empty, and so a copy of other empty ones; a null lang is part ''.  Rows with a null id
never fail E and make nobody fail it; they have no labels.  Rows that share id and text don't make each other
fail; each row counts.  Several labels of one id count as one, 1 if any is 1.  Ids may be of any type that can be
ordered.  Without documents the result is empty.  Columns other than those named are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import Tables, words

LETTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = r"[#$%&*|]"
BITS = {letter: 1 << k for k, letter in enumerate(LETTERS)}


def own_failures(text: Column) -> Column:
    """The bits of A to D, which a text fails or passes by itself."""
    found = words(text)
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {"A": n < MIN_WORDS, "B": 100 * distinct < DISTINCT_PERCENT * n, "C": 100 * capitals > CAPITAL_PERCENT * F.length(text), "D": text.rlike(SYMBOLS)}
    return sum((F.when(f, BITS[k]).otherwise(0) for k, f in fails.items()), F.lit(0))


def _digest(text: pa.Scalar) -> bytes:
    return hashlib.sha256(text.as_buffer()).digest()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks rows, sorted by fp, text and doc_id, that have a smaller id of the same text before them in the partition.

    Rows of the partition's first fingerprint get the digest of their text; the last rows, with a null mask, are
    the smallest ids of the texts of its last fingerprint.
    """
    first_fp = fp_before = text_before = id_before = schema = None
    tail: dict[pa.Scalar, pa.Scalar] = {}
    for batch in batches:
        if not len(batch):
            continue
        fp, text, ids = batch.column("fp").to_numpy(), batch.column("text"), batch.column("doc_id")
        rows = len(batch)
        if first_fp is None:
            first_fp = fp[0]
        new = np.ones(rows, bool)
        new[0] = fp_before is None or fp[0] != fp_before or text[0] != text_before
        new[1:] = (fp[1:] != fp[:-1]) | ~pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new | (np.arange(rows) == 0))
        group = np.cumsum(new) - new[0]
        # The first id of a group is its smallest; null ids come before it.
        known = np.minimum.reduceat(np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.arange(rows), rows), start)
        smallest = ids.take(pa.array(known, mask=known == rows))
        if not new[0] and id_before.is_valid:
            smallest = pa.concat_arrays([pa.array([id_before], ids.type), smallest[1:]])
        fails = pc.fill_null(pc.not_equal(ids, smallest.take(pa.array(group))), False)
        head = int(np.searchsorted(group, group[fp == first_fp][-1], "right")) if fp[0] == first_fp else 0
        digests = [_digest(text[int(s)]) for s in start if s < head]
        digest = pa.array([digests[g] for g in group[:head]] + [None] * (rows - head), pa.binary())
        columns = {"doc_id": ids, "part": batch.column("part"), "mask": batch.column("mask"), "fails": fails, "fp": batch.column("fp"), "digest": digest}
        out = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns))
        schema = out.schema
        yield out
        if fp[-1] != fp_before:
            tail = {}
        fp_before, text_before, id_before = fp[-1], text[rows - 1], smallest[len(smallest) - 1]
        for g, s in enumerate(start):
            if fp[s] == fp_before and smallest[g].is_valid:
                tail[text[int(s)]] = smallest[g]
    if tail:
        n = len(tail)
        arrays = [pa.array([v.as_py() for v in tail.values()], schema.field("doc_id").type), pa.nulls(n, schema.field("part").type), pa.nulls(n, schema.field("mask").type), pa.array([False] * n), pa.array([fp_before] * n, pa.int64()), pa.array(map(_digest, tail), pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def masks(docs: DataFrame, tables: Tables, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, part and mask (the failures' bits) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"))
    # Ranges of short keys, since their sample goes to the driver; the texts are sorted where they are.
    order = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = order.withColumn("mask", own_failures(F.col("text"))).mapInArrow(_compared, f"doc_id {kind}, part string, mask int, fails boolean, fp long, digest binary")
    found = tables.store(found)
    tails = found.where("mask is null").groupBy("fp", "digest").agg(F.min("doc_id").alias("first"))
    # A row a partition.
    joined = found.where("mask is not null").join(F.broadcast(tails), ["fp", "digest"], "left")
    fails = F.col("fails") | F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined.select("doc_id", "part", F.when(fails, F.col("mask") + BITS["E"]).otherwise(F.col("mask")).alias("mask"))


def counters(marked: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, mask, n, good and toxic: the documents with these failures, and those of them labelled good or toxic."""
    one = labels.select(F.col(doc_id).alias("doc_id"), *((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int").alias(c) for c in ("quality", "toxic")))
    one = one.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    joined = marked.join(one, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))


def steps(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step from the counters, zeros included."""
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))).alias("filter_order")
    each = cells.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    here = sum((F.when(F.instr("filter_order", k) == F.col("step"), b).otherwise(0) for k, b in BITS.items()), F.lit(0))
    before = sum((F.when(F.instr("filter_order", k) < F.col("step"), b).otherwise(0) for k, b in BITS.items()), F.lit(0))
    each = each.select("*", here.alias("here"), F.col("mask").bitwiseAND(before).alias("earlier")).withColumn("hit", F.col("mask").bitwiseAND(F.col("here")))
    hit, new, n = F.col("hit") > 0, F.col("earlier") == 0, F.col("n")
    share = (n * F.lit(120) / F.bit_count("mask")).cast("long")  # 1 to 5 divide the number of orders
    total = lambda name, on, of=n: F.coalesce(F.sum(F.when(on, of)), F.lit(0)).cast("long").alias(name)
    return each.groupBy("part", "filter_order", "step").agg(
        total("kept", ~hit & new), total("removed", hit & new), total("redundant", hit & ~new), total("unique_fails", F.col("mask") == F.col("here")),
        total("good_lost", hit & new, F.col("good")), total("toxic_lost", hit & new, F.col("toxic")), total("shapley", hit, share),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return steps(counters(masks(docs, Tables(docs.sparkSession)), labels))
