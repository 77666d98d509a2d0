"""SimHash near-duplicates: fingerprints at two or fewer differing bits, by deletion variants of half fingerprints.

1. A text's fingerprint has a bit where over half of the XXH64 of its 3-word shingles have it.  Documents with one
   fingerprint are one class.
2. A fingerprint is cut into two halves instead of the three that equal segments would take.  Of two fingerprints
   at two bits or fewer, one half differs by at most one bit, so both share that half with one bit left out: a one-wildcard
   variant.  A pair with a differing bit in each half is found by the first half, and a pair with equal
   halves by the whole half, so the index holds 32 variants of the first half and the two halves themselves.
3. Fingerprints with equal variants are joined and verified by counting the bits that differ.
4. A variant that more than ``CROWD`` fingerprints have, as in a large group of near copies, isn't joined with
   itself.  Each of its fingerprints is listed under its 65 neighbours, those at one bit and itself: two at two bits or
   fewer have a neighbour in common, and all that have one are at two bits or fewer, so each is linked with the smallest.
   That costs 65 rows a fingerprint whatever the crowd's size, and loses no link.
5. Links are joined to components by the smallest class reachable.

Edge cases: texts without words, and null texts, have fingerprint zero and are linked like others.  Rows that
share an id are one document with the links of all of them.  Rows with a null id link others and get the
component of their class, null if it has no id.  Ids may be of any type that can be ordered.  An empty table
gives an empty result.  Columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import Tables, marked
from quire.llm._vector import Words, chunks
from quire.llm.jaccard import _of_one_id, components

WORDS = 3
SEED = 42
BITS = 2
HALF = 32
#: Fingerprints of a variant that are compared with each other; with more they meet under their neighbours.
CROWD = 32


def shingle_spans(words: Words, size: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, last word) of each shingle: ``WORDS`` words in a row of one text, or all of a shorter one."""
    count = np.bincount(words.doc, minlength=rows)
    start = np.cumsum(count) - count
    at = np.arange(size)
    whole = count[words.doc] < WORDS
    last = np.where(whole, start[words.doc] + count[words.doc] - 1, at + WORDS - 1)
    keep = np.where(whole, at == start[words.doc], at + WORDS <= start[words.doc] + count[words.doc])
    return words.doc[keep], at[keep], last[keep]


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each of a chunk's texts."""
    rows = len(offsets) - 1
    out = np.zeros(rows, np.uint64)
    words = Words(data, offsets)
    size = len(words.start)
    if not size:
        return out
    # The words in lower case, one space after each: a shingle is one slice of it.
    length = words.end - words.start
    place = np.cumsum(length + 1) - length - 1
    spaced = np.full(int(length.sum()) + size, 0x20, np.uint8)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    spaced[np.repeat(place, length) + within] = data[np.repeat(words.start, length) + within]
    spaced[(spaced >= 65) & (spaced <= 90)] += 32
    text = spaced.tobytes()
    doc, first, last = shingle_spans(words, size, rows)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(place[first].tolist(), (place[last] + length[last]).tolist(), strict=True)], np.uint64)
    cuts = np.searchsorted(doc, np.arange(rows + 1))
    for row in np.unique(doc):
        own = hashes[cuts[row] : cuts[row + 1]]
        ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, offsets in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(fingerprints_of(data, offsets).view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _index(classes: DataFrame) -> DataFrame:
    """fp, kind, half, side: the low half whole (kind 0) and without each of its bits (1 to 32), and the high half whole (33).

    ``side`` is the bit left out, null for whole halves.
    """
    low = f"(fp & {(1 << HALF) - 1}L)"
    without = f"transform(sequence(1, {HALF}), k -> named_struct('kind', k, 'half', {low} & ~shiftleft(1L, k - 1), 'side', (shiftright(fp, k - 1) & 1) = 1))"
    whole = f"array(named_struct('kind', 0, 'half', {low}, 'side', cast(null as boolean)), named_struct('kind', {HALF + 1}, 'half', shiftrightunsigned(fp, {HALF}), 'side', cast(null as boolean)))"
    return classes.select("fp", F.expr(f"inline(concat({whole}, {without}))"))


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def links(classes: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``classes``: all that components need."""
    index = _index(classes)
    # Halves that are equal meet whole; without a bit only those that differ in it have to.
    sides = index.groupBy("kind", "half").agg(F.count("*").alias("n"), F.min("side").alias("no"), F.max("side").alias("yes"))
    shared = tables.store(sides.where((F.col("n") > 1) & F.coalesce(F.col("no") != F.col("yes"), F.lit(True))).select("kind", "half", "n"))
    # Few variants are shared: most rows go before they are shuffled.
    met = tables.store(marked(index, shared, "kind", "half").where("_hit").drop("_hit").join(shared, ["kind", "half"]).select("kind", "half", "side", "fp", "n"))
    few = met.where(F.col("n") <= CROWD)
    a, b = (few.select("kind", "half", F.col("side").alias(f"{c}_side"), F.col("fp").alias(c)) for c in "ab")
    fits = (F.col("a") < F.col("b")) & F.coalesce(F.col("a_side") != F.col("b_side"), F.lit(True)) & _near(F.col("a"), F.col("b"))
    pairs = a.join(b, ["kind", "half"]).where(fits).select("a", "b")
    crowd = met.where(F.col("n") > CROWD).select("fp").distinct()
    around = crowd.select("fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k))))").alias("near"))
    # At most 65 fingerprints have one neighbour in common.
    around = around.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    found = tables.store(pairs.union(around).distinct())
    tables.drop(shared, met)
    return found


def simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = tables.store(fingerprints(rows))
    classes = tables.store(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    same = _of_one_id(found.withColumnRenamed("fp", "class"))
    joined = components(links(classes, tables).union(same), tables).withColumnRenamed("class", "fp")
    named = classes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
