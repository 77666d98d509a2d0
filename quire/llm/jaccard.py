"""N-gram Jaccard join: grouped prefix join over sets of five-word shingles.

1. Shingles are ordered by how often they occur, rarest first: ``BUCKETS`` hashed counters over the whole
   corpus tell the frequent ones, equal levels are ordered by hash.
2. Two sets with a Jaccard similarity of at least 0.8 share one of their first ``n - ceil(0.8 n) + 1``
   shingles in that order, their prefixes.
3. Documents with equal sets are one class; classes with equal prefixes and sizes are one group.  Only groups
   are listed under the shingles of their prefix.
4. Group pairs that share a prefix shingle are filtered by size, by position and by sketch; those left are expanded to
   their members' pairs and verified on the whole sets, each pair once.  A prefix shingle that no other group has can't be
   shared, so positions count the others only.  The position has to leave enough shingles behind the first shared
   one, which is where a pair has to meet.  A sketch tells for each of ``SKETCH`` bits whether an odd number of the
   set's shingles fall on it: two sketches differ in no more bits than their sets have shingles that aren't shared, which
   rules out nearly all pairs that aren't alike, by an exact bound, of sets up to about twice that size.
   Shingles that the same groups have, such as those of a passage that just these share, are one list: a pair meets once for all
   of them, with the places of the first.
5. Verified links are joined to components by the smallest class reachable.

Near copies by the thousand would give pairs by the million, so the groups listed under a shingle meet in
rounds.  In a round every list is dealt into slots, ``GROWTH`` times as many as in the round before, and the
group of each slot with the fewest shingles of its own, so the likeliest original, is a hub: all groups of the
list meet it, and it leaves the list.  Groups that the links found so far have joined already don't meet, and a
list leaves once it is all one component.  Alike groups share most of their shingles, the rarest among them, so a pass
over the first ``FIRST`` of each group's shared shingles goes ahead of all rounds and finds most lists joined before they
are worked on.  A group has the smallest and the largest component of its classes,
so a pair is passed over only where these are all one; pairs of classes are passed over where their two
components are equal.  No pair with different components is left unverified, so components are exact.  The
classes of one group share their whole prefix and meet in a list of their own.

Edge cases: texts without words, and null texts, have no shingle and are linked with nothing; with fewer than
five words the whole sequence is one shingle.  Rows that share an id are one document with the links of all of
them.  Rows with a null id are verified like others and get the component of their class, null if it has no id.
Ids may be of any type that can be ordered.  An empty table gives an empty result.  Columns other than id and
text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import Tables, marked, small_batches
from quire.llm._vector import Words, chunks, mix

WORDS = 5
PERCENT = 80
BUCKETS = 1 << 20
SLICES = 64
#: Bits of a set's sketch, and the long columns that hold them.
SKETCH = 512
LONGS = [f"s{k}" for k in range(SKETCH // 64)]
#: Rows whose sketches are made at a time.
SKETCHED = 1024
#: Slots of a list in a round for each in the round before.
GROWTH = 8
#: Shared shingles of each group that are worked on ahead of all.
FIRST = 2
#: Tasks over which the pairs of one hub are spread.
SPREAD = 256


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a chunk's texts, in order."""
    words = Words(data, offsets)
    count = np.bincount(words.doc, minlength=len(offsets) - 1)
    found = [words.grams(k) for k in range(1, WORDS + 1)]
    kept = [count[doc] == k if k < WORDS else slice(None) for k, (doc, _, _) in enumerate(found, 1)]
    doc, hashes = (np.concatenate([f[part][keep] for f, keep in zip(found, kept, strict=True)]) for part in (0, 2))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _classes(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each row's set; the rows' hashes lie one after the other, n of each."""
    full, out = np.flatnonzero(n), np.zeros(len(n), np.uint64)
    if len(full):
        start, mixed = (np.cumsum(n) - n)[full], mix(hashes)
        out[full] = mix(np.add.reduceat(mixed, start) * np.uint64(3) + mix(np.bitwise_xor.reduceat(mixed, start)))
    return out.view(np.int64)


def sketches(doc: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """A row of ``SKETCH`` bits, as bytes, for each text: whether an odd number of its shingles fall on the bit."""
    out = np.zeros((rows, SKETCH // 8), np.uint8)
    bit = ((hashes >> np.uint64(8)) % np.uint64(SKETCH)).astype(np.int64)
    for first in range(0, rows, SKETCHED):
        last = min(first + SKETCHED, rows)
        a, b = np.searchsorted(doc, [first, last])
        odd = np.bincount((doc[a:b] - first) * SKETCH + bit[a:b], minlength=(last - first) * SKETCH) & 1
        out[first:last] = np.packbits(odd.reshape(last - first, SKETCH).astype(bool), axis=1, bitorder="little")
    return out


def levels(docs: DataFrame) -> np.ndarray:
    """By bucket 0, or for buckets that stand out 8 times the binary logarithm of their shingles' occurrences in the corpus."""
    width = BUCKETS // SLICES

    def parts(total: np.ndarray) -> pa.RecordBatch:
        packed = [zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in range(SLICES)]
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                total += np.bincount(_bucket(shingles(data, offsets)[1]), minlength=BUCKETS)
        yield parts(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    total = np.zeros(BUCKETS, np.int64)
    # SLICES rows, BUCKETS numbers together, whatever the corpus.
    for r in docs.select("text").mapInArrow(count, schema).repartition(8, "part").mapInArrow(add, schema).collect():
        total[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    usual = float(np.median(total))
    return np.where(total <= usual * 1.3 + 6 * usual**0.5 + 10, 0, 8 * np.log2(np.maximum(total, 1))).astype(np.uint16)


def prefixes(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """doc_id, text's hash, n shingles, class (a hash of the set), prefix (its shingles, eight bytes each) and sketch; n is 0 and the rest null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, offsets in chunks(batch.column("text")):
                doc, hashes = shingles(data, offsets)
                n = np.bincount(doc, minlength=rows)
                start = np.cumsum(n) - n
                classes = _classes(hashes, n)
                order = np.lexsort((hashes, level[_bucket(hashes)], doc))
                ordered = hashes[order]
                length = prefix_length(n)
                found = [ordered[a : a + p].tobytes() if k else None for a, p, k in zip(start, length, n, strict=True)]
                sketch = [x.tobytes() if k else None for x, k in zip(sketches(doc, hashes, rows), n, strict=True)]
                ids, keys = (batch.column(c).slice(first, rows) for c in ("doc_id", "text_key"))
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.array(n, pa.int64()), pa.array(classes, mask=n == 0), pa.array(found, pa.binary()), pa.array(sketch, pa.binary())],
                    names=["doc_id", "text_key", "n", "class", "prefix", "sketch"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n long, class long, prefix binary, sketch binary")


def _longs(sketch: Column) -> list[Column]:
    """A sketch as long columns."""
    part = lambda k: F.conv(F.hex(F.substring(sketch, 8 * k + 1, 8)), 16, -10).cast("long")
    return [part(k).alias(name) for k, name in enumerate(LONGS)]


def _listed(groups: DataFrame, level: np.ndarray) -> DataFrame:
    """One row per group and shingle of its prefix; ``frequent`` tells shingles whose bucket stands out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, n = (batch.column(c).to_numpy() for c in ("group", "n"))
            packed = batch.column("prefix").to_pylist()
            size = np.array([len(p) // 8 for p in packed])
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            token = np.frombuffer(b"".join(packed), np.uint64)
            columns = {
                "token": pa.array(token.view(np.int64)),
                "node": pa.array(np.repeat(group, size)),
                "n": pa.array(np.repeat(n, size)),
                "place": pa.array(place, pa.int32()),
                "frequent": pa.array(level[_bucket(token)] > 0),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return groups.select("group", "n", "prefix").mapInArrow(run, "token long, node long, n long, place int, frequent boolean")


def _least_shared(n: Column, m: Column) -> Column:
    """Shingles that two sets of n and m must share."""
    return F.ceil(F.lit(PERCENT) * (n + m) / F.lit(100 + PERCENT))


def lists(groups: DataFrame, level: np.ndarray) -> DataFrame:
    """The prefix shingles that several groups of fitting sizes have, and these groups: token, node (a group), several (whether it has more classes than one), n, before, rest, low, high and the sketch.

    ``before`` are shingles ahead of this one that such others have too, ``rest`` is how many others may have of
    this one and those behind it.  A shingle of an
    ordinary bucket occurs about as often as the bucket's others at most, so the windows by shingle have no
    key that stands out; those of frequent buckets are taken for shared without being counted.  Ordinary shingles of the same
    groups are one list, named by a hash of these groups; should two hashes be equal, their lists are one and no pair is lost.
    """
    every = _listed(groups, level)
    # In order of size, a group whose neighbours' sizes don't fit has no partner here.
    order = Window.partitionBy("token").orderBy("n", "node")
    # All shingles of all groups are shuffled here, so no column goes along that can be told afterwards.
    rare = every.where("not frequent").select("token", "node", "n").withColumn("x", F.lag("n").over(order)).withColumn("y", F.lead("n").over(order))
    rare = rare.where((100 * F.col("x") >= PERCENT * F.col("n")) | (100 * F.col("n") >= PERCENT * F.col("y"))).drop("x", "y")
    shingle = Window.partitionBy("token")
    # A list has a group once, so none is cancelled.
    name = F.xxhash64(*(F.bit_xor(F.xxhash64("node", F.lit(k))).over(shingle) for k in (1, 2)), F.count("*").over(shingle))
    # Shingles of ordinary buckets are in the order of their unsigned hashes, ahead of the frequent ones.
    rare = rare.select(name.alias("list"), "node", "n", F.lit(-1).alias("place"), F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("order"))
    node = Window.partitionBy("node")
    place = F.row_number().over(node.orderBy("place", "order")).cast("long")
    shared = F.count("*").over(node.orderBy("place", "order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    prefix = prefix_length(F.col("n"))
    frequent = every.where("frequent").select(F.col("token").alias("list"), "node", "n", "place", F.col("token").alias("order"))
    marked = rare.unionByName(frequent).select("list", "node", "n", place.alias("k"), shared.alias("shared"))
    # Dealt by group, as the windows before and the join after it.
    marked = marked.groupBy("node", F.col("list").alias("token")).agg(F.first("n").alias("n"), F.min("k").alias("k"), F.first("shared").alias("shared"))
    # The classes of a group have different sketches.
    sketch = F.when(F.col("group") == F.col("last"), F.col("sketch"))
    marked = marked.join(groups.select(F.col("group").alias("node"), "last", *_longs(sketch)), "node")
    return marked.select(
        "token",
        "node",
        (F.col("node") != F.col("last")).alias("several"),
        "n",
        (F.col("k") - 1).alias("before"),
        (F.col("n") - prefix + F.col("shared") - F.col("k") + 1).alias("rest"),
        F.col("node").alias("low"),
        F.col("last").alias("high"),
        *LONGS,
    )


def prefix_length(n):
    """``n - ceil(0.8 n) + 1``, of a numpy array or a column of longs."""
    return n - F.ceil(PERCENT * n / F.lit(100)) + 1 if isinstance(n, Column) else n + (-n * PERCENT // 100) + 1


def _wanted(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Texts whose text_key is in ``classes``, and a few others."""
    return marked(docs, classes, "text_key").where("_hit").select("text")


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, set (sorted, eight bytes each) and brief (two bytes each) of the classes in ``classes`` (class, text_key), from their documents' texts; some others too, and some twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, rows, data, offsets in chunks(batch.column("text")):
                doc, hashes = shingles(data, offsets)
                cuts = np.searchsorted(doc, np.arange(rows + 1))
                of = _classes(hashes, np.diff(cuts))
                # Copies are sent once by a task.
                new = [k for k in np.unique(of, return_index=True)[1] if cuts[k] < cuts[k + 1] and int(of[k]) not in sent]
                sent.update(of[new].tolist())
                sets = [hashes[cuts[k] : cuts[k + 1]] for k in new]
                brief = [np.sort((x >> np.uint64(20)).astype(np.uint16)).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(of[new], pa.int64()), pa.array(brief, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["class", "brief", "set"])

    return _wanted(docs, classes).mapInArrow(run, "class long, brief binary, set binary")


def _similar(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps pairs whose sets x and y, sorted numbers of ``kind``, are similar enough; exact for whole shingles, and for parts of them none is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), kind) for v in (x, y))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = min(int((y[at] == x).sum()), len(y))
                keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield batch.drop_columns(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _ids(pairs: DataFrame) -> DataFrame:
    """The classes in pairs, each side made distinct before they meet."""
    return pairs.select(F.col("a").alias("class")).distinct().union(pairs.select(F.col("b").alias("class")).distinct()).distinct()


def _compared(pairs: DataFrame, sets: DataFrame, column: str, kind: type) -> DataFrame:
    sets = sets.select("class", column).join(_ids(pairs), "class", "left_semi").dropDuplicates(["class"])
    # A hub is in many pairs: its set goes once to each of the tasks over which they are spread.
    spread = pairs.withColumn("slot", F.pmod(F.xxhash64("a"), F.lit(SPREAD)))
    there = spread.select("b", "slot").distinct().join(sets.select(F.col("class").alias("b"), F.col(column).alias("y")), "b")
    both = spread.join(sets.select(F.col("class").alias("a"), F.col(column).alias("x")), "a").join(there, ["b", "slot"])
    return both.select("a", "b", "of_a", "of_b", "x", "y").mapInArrow(_similar(kind), "a long, b long, of_a long, of_b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """Those of the pairs (a, b, and their components) of classes whose sets are similar enough; stored.

    Two bytes of each shingle rule out most pairs that aren't, the others are compared on the whole shingles.
    """
    ids = tables.store(_ids(pairs).join(classes.select("class", "text_key"), "class"))
    sets = tables.store(_sets(docs, ids))
    likely = tables.store(_compared(pairs, sets, "brief", np.uint16))
    links = tables.store(_compared(likely, sets, "set", np.uint64))
    tables.drop(ids, sets, likely)
    return links


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(class, component): the smallest class reachable, by spreading the smallest label and jumping to its own label."""
    both = tables.store(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = tables.store(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("class"), F.least("a", "low").alias("component"), F.lit(True).alias("moved")))
    while not label.where("moved").isEmpty():
        near = both.join(label, both["b"] == label["class"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = tables.store(label.join(near, label["class"] == near["a"]).select("class", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        jump = spread.select(F.col("class").alias("component"), F.col("component").alias("further"))
        done = label
        label = spread.join(jump, "component").select("class", F.least("component", "further").alias("component"), (F.col("old") != F.least("component", "further")).alias("moved"))
        label = tables.store(label)
        tables.drop(done, spread)
    tables.drop(both)
    return label.select("class", "component")


def _merged(links: DataFrame) -> DataFrame:
    """(component, into): which of the components that links join is now part of a smaller one.

    Labels spread twice, which joins all that a hub or its neighbours link.  Components that a longer chain
    links may keep two names until later; their members meet and are verified, and nothing is lost.
    """
    edges = links.select(F.col("of_a").alias("x"), F.col("of_b").alias("y"))
    edges = edges.union(edges.select("y", "x")).distinct()
    label = edges.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("into"))
    for _ in range(2):
        near = edges.join(label.select(F.col("x").alias("y"), "into"), "y").groupBy("x").agg(F.min("into").alias("near"))
        label = label.join(near, "x").select("x", F.least("into", "near").alias("into"))
    return label.where("x <> into").select(F.col("x").alias("component"), "into")


def _renamed(frame: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    named = merged.select(F.col("component").alias(column), "into")
    return frame.join(named, column, "left").withColumn(column, F.coalesce("into", column)).drop("into")


def _meet(state: DataFrame, hubs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of classes (a, b, and their components) of the pairs of groups that pass the filters."""
    other = hubs.select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "several", "n", "rest", "low", "high", *LONGS)))
    col = F.col
    least = _least_shared(col("n"), col("n2"))
    apart = sum((F.bit_count(col(c).bitwiseXOR(col(f"{c}2"))) for c in LONGS), F.lit(0))
    fits = (
        ((col("node") != col("node2")) | (col("several") != col("several2")))
        & (F.least("low", "low2") != F.greatest("high", "high2"))
        & (100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2"))
        & (F.least("rest", "rest2") >= least)
        & F.coalesce(apart <= col("n") + col("n2") - 2 * least, F.lit(True))
    )
    one, two = F.struct("node", "several", "low"), F.struct(col("node2").alias("node"), col("several2").alias("several"), col("low2").alias("low"))
    pairs = state.join(other, "token").where(fits).select(one.alias("x"), two.alias("y")).select(F.when(col("x") < col("y"), col("x")).otherwise(col("y")).alias("p"), F.greatest("x", "y").alias("q")).distinct()
    for side, name, of in (("p", "a", "of_a"), ("q", "b", "of_b")):
        inside = members.select(col("group").alias("_g"), col("class").alias("_c"), col("component").alias("_of"))
        pairs = pairs.join(inside, (col(f"{side}.node") == col("_g")) & col(f"{side}.several"), "left")
        pairs = pairs.withColumn(name, F.coalesce("_c", f"{side}.node")).withColumn(of, F.coalesce("_of", f"{side}.low")).drop("_g", "_c", "_of")
    return pairs.where("of_a <> of_b").select("a", "b", "of_a", "of_b").distinct()


def _round(state: DataFrame, members: DataFrame, checked: list[DataFrame], number: int, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs to verify, none of those ``checked`` before, lists still to work on, hubs to forget)."""
    slot = F.pmod(F.xxhash64("node", "several", F.lit(number)), F.lit(GROWTH**number))
    own = (F.col("n") - F.col("before") - F.col("rest")) / prefix_length(F.col("n"))
    hub = F.min(F.struct(own.cast("float").alias("own"), "node", "several", "n", "before", "rest", "low", "high", *LONGS)).alias("hub")
    hubs = tables.store(state.groupBy("token", slot.alias("slot")).agg(hub))
    met = _meet(state, hubs.select("token", "hub.*"), members)
    if checked:
        met = met.join(reduce(DataFrame.union, (before.select("a", "b") for before in checked)), ["a", "b"], "left_anti")
    pairs = tables.store(met)
    stays = (F.col("node") != F.col("hub.node")) | (F.col("several") != F.col("hub.several"))
    left = state.withColumn("slot", slot).join(hubs, ["token", "slot"]).where(stays).select(*state.columns)
    return pairs, left, hubs


def links(groups: DataFrame, classes: DataFrame, level: np.ndarray, docs: DataFrame, tables: Tables) -> DataFrame | None:
    """All verified links (a, b) that components need; none if no two groups meet."""
    several = groups.where(F.col("group") != F.col("last")).select("n", "key", "group")
    members = tables.store(classes.join(several, ["n", "key"]).select("class", "group", "n", F.col("class").alias("component"), *_longs(F.col("sketch"))))
    # Members of one group share their whole prefix, as if it were one more shingle.
    inside = members.select(
        F.xxhash64("group", F.lit("inside")).alias("token"), F.col("class").alias("node"), F.lit(False).alias("several"), "n", F.lit(0).cast("long").alias("before"), F.col("n").alias("rest"),
        F.col("class").alias("low"), F.col("class").alias("high"), *LONGS,
    )
    every = tables.store(lists(groups, level).unionByName(inside))
    tables.drop(groups)
    # The first pass only finds links: all lists are whole in the rounds after it.
    state, others, done = every.where(F.col("before") < FIRST), every, [every]
    found: list[DataFrame] = []
    checked: list[DataFrame] = []
    number = 0
    while others is not None or not state.isEmpty():
        pairs, left, hubs = _round(state, members, checked, number, tables)
        ahead, left, old = others is not None, left if others is None else others, [hubs]
        checked.append(pairs)
        one = None if pairs.isEmpty() else _verified(pairs, docs, classes, tables)
        if one is not None and not one.isEmpty():
            found.append(one)
            merged = tables.store(_merged(one))
            moved = tables.store(_renamed(members, merged, "component"))
            span = moved.groupBy("group").agg(F.min("component").alias("l"), F.max("component").alias("h")).select(F.col("group").alias("node"), F.lit(True).alias("several"), "l", "h")
            # A group of one class has the component of its class twice.
            left = _renamed(left, merged, "low").join(span, ["node", "several"], "left")
            left = left.withColumn("low", F.coalesce("l", "low")).withColumn("high", F.coalesce("h", "low")).drop("l", "h").select(*state.columns)
            old += [members, merged]
            members = moved
        named = tables.store(left)
        tables.drop(*done, *old)
        # Lists that are all one component, or one group, have nothing to add.
        mixed = named.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token")
        state = tables.store(named.join(mixed, "token", "left_semi"))
        tables.drop(named)
        others, done = None, [state]
        number += not ahead
    tables.drop(*done, *checked, members)
    out = None
    for one in found:
        out = one.select("a", "b") if out is None else out.union(one.select("a", "b"))
    return out


def _of_one_id(full: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    ids = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("b"), F.max("class").alias("last")).where("b <> last").select("doc_id", "b")
    return full.join(ids, "doc_id").where(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b").distinct()


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    with small_batches(docs.sparkSession):
        return _jaccard_join(docs, doc_id, text)


def _jaccard_join(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("doc_id", "text"))
    level = levels(rows)
    every = tables.store(prefixes(rows, level).withColumn("key", F.xxhash64("prefix")))
    full = every.where("n > 0")
    classes = tables.store(full.groupBy("n", "key", "class").agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")))
    groups = tables.store(full.groupBy("n", "key").agg(F.min("class").alias("group"), F.max("class").alias("last"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")))
    # Prefixes are kept once, by group.
    found = tables.store(every.select("doc_id", "n", "class"))
    tables.drop(every)
    verified = links(groups, classes, level, rows, tables)
    same = _of_one_id(found.where("n > 0").select("doc_id", "class"))
    joined = components(same if verified is None else verified.union(same), tables)
    named = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "component").select("class", F.col("n").alias("_n"), "component_id")
    out = found.select("doc_id", "n", "class").join(named, (found["class"] == named["class"]) & (found["n"] == named["_n"]), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
