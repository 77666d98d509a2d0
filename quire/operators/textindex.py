"""A kept full-text index: postings with positions by token bucket, searched with BM25 and the language of ``querylang``.

A folder holds two tables, both cut into buckets whose files are named by the version that wrote them:

* ``postings``: token and a list of pages with it: key, length of the page in tokens, positions; bucketed by the token's first
  two letters, so that a word and a prefix of two letters or more are in one bucket, and sorted by token, so that a scan
  skips most of the bucket.  A token has a list for each part of the pages that a task groups at a time: so rows that
  are dealt out and sorted are few;
* ``pages``: key, length, hash of the text and the buckets of its tokens; bucketed by key.

A small manifest tells the version of each bucket and the statistics of the whole index.  An update writes the buckets
that the changed pages had or have tokens in under a new version, then the next manifest; readers of the old
one aren't disturbed, and an update that fails leaves no trace but files that nothing reads.  One writer at a time.

A search reads the buckets of its tokens and no text.  Statistics are those of the whole index whatever the project.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ranking import Query, fits, tokens
from quire.tables import exists, remove, stored

BUCKETS = 64
#: Letters of a token that choose its bucket.
LETTERS = 2
#: Tokens that a task groups at a time; a longer page goes by itself.
GROUPED = 200_000
#: Keys of an update that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, LETTERS)), F.lit(buckets)).cast("int")


def _page_bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive pages of a batch with ``GROUPED`` tokens at most, or one page."""
    ends = batch.column("_t").offsets.to_numpy()
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUPED, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each page, with its positions in order, from one row a page with its tokens ``_t``."""
    for batch in (part for whole in batches for part in _parts(whole)):
        found = batch.column("_t")
        length = np.diff(found.offsets.to_numpy())
        flat = found.flatten().dictionary_encode()
        if not len(flat):
            continue
        page, code = np.repeat(np.arange(len(batch)), length), flat.indices.to_numpy()
        place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        order = np.lexsort((place, code, page))
        page, code, place = page[order], code[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (code[1:] != code[:-1])]))
        cuts = pa.array(np.append(start, len(place)), pa.int32())
        names = [n for n in batch.schema.names if n != "_t"]
        columns = [batch.column(n).take(pa.array(page[start])) for n in names]
        columns += [pa.array(length[page[start]], pa.int32()), flat.dictionary.take(pa.array(code[start])), pa.ListArray.from_arrays(cuts, pa.array(place, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "length", "token", "positions"])


def _listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each token, with the list of its pages, from a row for each token of each page."""
    token = batch.column("token").dictionary_encode()
    code = token.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(token.dictionary)))])
    names = [n for n in batch.schema.names if n != "token"]
    one = pa.StructArray.from_arrays([c.take(pa.array(order)) for c in map(batch.column, names)], names=names)
    return pa.RecordBatch.from_arrays([token.dictionary, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), one)], names=["token", "pages"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from map(_listed, _grouped(batches))


def _lists_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists from rows for each token of each page, ``GROUPED`` rows at a time or a batch."""
    held, rows = [], 0
    for batch in batches:
        if held and rows + len(batch) > GROUPED:
            yield _listed(pa.concat_batches(held))
            held, rows = [], 0
        held.append(batch)
        rows += len(batch)
    if rows:
        yield _listed(pa.concat_batches(held))


def _kinds(rows: DataFrame, key: list[str]) -> str:
    of = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    return f"token string, pages array<struct<{of}, length: int, positions: array<int>>>"


def positions(pages: DataFrame, key: list[str], text: str, buckets: int) -> DataFrame:
    """token, pages (key, length, positions ascending from 0), bucket of all pages, a row a token and part of the pages; no shuffle."""
    found = pages.select(*key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    return found.mapInArrow(_lists, _kinds(found, key)).withColumn("bucket", bucket_of(F.col("token"), buckets))


def page_rows(pages: DataFrame, key: list[str], text: str, buckets: int) -> DataFrame:
    """key, length, hash and token_buckets of each page, and its own bucket; no shuffle."""
    found = pages.select(*key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    own = F.array_distinct(F.transform("_t", lambda t: bucket_of(t, buckets)))
    return found.select(*key, F.size("_t").alias("length"), "hash", own.alias("token_buckets"), _page_bucket(key, buckets).alias("bucket"))


@dataclass(frozen=True)
class TextIndex:
    """An index as it was at one version."""

    spark: SparkSession
    folder: str
    version: int
    key: list[str]
    buckets: int
    n: int
    total: int
    postings_versions: dict[int, int]
    pages_versions: dict[int, int]

    def _paths(self, table: str, wanted: list[int]) -> list[str]:
        versions = self.postings_versions if table == "postings" else self.pages_versions
        return [f"{self.folder}/{table}/version={versions[b]}/bucket={b}" for b in wanted if b in versions]

    def _read(self, table: str, wanted: list[int]) -> DataFrame:
        """Rows of the buckets ``wanted``; bucket isn't a column."""
        schema = self.spark.read.parquet(f"{self.folder}/{table}/empty").schema
        paths = self._paths(table, wanted)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def postings(self, wanted: list[int] | None = None) -> DataFrame:
        """key, length, token, positions: a row a page and token."""
        lists = self._read("postings", sorted(self.postings_versions) if wanted is None else wanted)
        return lists.select("token", F.inline("pages")).select(*self.key, "length", "token", "positions")

    def pages(self, wanted: list[int] | None = None) -> DataFrame:
        return self._read("pages", sorted(self.pages_versions) if wanted is None else wanted)


def _write(frame: DataFrame, folder: str, version: int, order: list[str]) -> None:
    """A bucket is one task's and one file's, but for large ones, which Spark splits."""
    dealt = frame.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
    dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/version={version}")


def _publish(spark: SparkSession, folder: str, version: int, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest/{version}")


def _buckets_in(spark: SparkSession, path: str) -> list[int]:
    """Buckets of which a version has files; at most as many as there are buckets."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)
    names = [s.getPath().getName() for s in found]
    return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]


def build(pages: DataFrame, folder: str, key: list[str], text: str = "text", buckets: int = BUCKETS) -> TextIndex:
    """Indexes all ``pages``, one row a key, into ``folder``."""
    spark = pages.sparkSession
    for name, rows, order in (("postings", positions(pages, key, text, buckets), ["token"]), ("pages", page_rows(pages, key, text, buckets), key)):
        _write(rows, f"{folder}/{name}", 1, order)
        rows.limit(0).drop("bucket").write.mode("overwrite").parquet(f"{folder}/{name}/empty")
    stats = spark.read.parquet(f"{folder}/pages/version=1").agg(F.count("*").alias("n"), F.sum("length").alias("total")).first() if _buckets_in(spark, f"{folder}/pages/version=1") else {"n": 0, "total": 0}
    held = {name: {b: 1 for b in _buckets_in(spark, f"{folder}/{name}/version=1")} for name in ("postings", "pages")}
    _publish(spark, folder, 1, {"key": key, "buckets": buckets, "n": stats["n"], "total": stats["total"] or 0, **held})
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str, version: int | None = None) -> TextIndex:
    """The index in ``folder``, at its newest version or a given one."""
    if version is None:
        version = 0
        while exists(spark, f"{folder}/manifest/{version + 1}/_SUCCESS"):
            version += 1
        if not version:
            raise ValueError(f"there is no index in {folder}")
    state = json.loads(spark.read.text(f"{folder}/manifest/{version}").first()[0])
    held = {name: {int(b): v for b, v in state[name].items()} for name in ("postings", "pages")}
    return TextIndex(spark, folder, version, state["key"], state["buckets"], state["n"], state["total"], held["postings"], held["pages"])


def upsert(index: TextIndex, changed: DataFrame, removed: DataFrame | None = None, text: str = "text") -> TextIndex:
    """The index after ``changed`` pages were put in place of those of the same keys, and ``removed`` keys taken out.

    Only buckets that these pages have tokens in, before or after, are written again.
    """
    key, version = index.key, index.version + 1
    keys = changed.select(*key) if removed is None else changed.select(*key).union(removed.select(*key))
    keys = stored(keys.distinct())
    fresh = stored(page_rows(changed, key, text, index.buckets))
    # Bucket numbers: at most index.buckets of them come to the driver.
    numbers = lambda frame, column: sorted(r[0] for r in frame.select(column).distinct().collect() if r[0] is not None)
    homes = numbers(keys, _page_bucket(key, index.buckets))
    stale = index.pages(homes).join(keys, key, "left_semi")
    touched = sorted({*numbers(stale, F.explode("token_buckets")), *numbers(fresh, F.explode("token_buckets"))})
    kept = index.pages(homes).join(keys, key, "left_anti").withColumn("bucket", _page_bucket(key, index.buckets))
    _write(kept.unionByName(fresh), f"{index.folder}/pages", version, key)
    # Where the keys go to every task, rows stay in order of tokens and are put into as few lists as before.
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    old = index.postings(touched).join(F.broadcast(keys) if few else keys, key, "left_anti").select(*key, "length", "token", "positions")
    old = old.mapInArrow(_lists_again, _kinds(keys, key)).withColumn("bucket", bucket_of(F.col("token"), index.buckets))
    _write(old.unionByName(positions(changed, key, text, index.buckets)), f"{index.folder}/postings", version, ["token"])
    before, after = (f.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first() for f in (stale, fresh))
    state: dict = {"key": key, "buckets": index.buckets, "n": index.n - before["n"] + after["n"], "total": index.total - before["total"] + after["total"]}
    for name, mine, again in (("postings", index.postings_versions, touched), ("pages", index.pages_versions, homes)):
        written = set(_buckets_in(index.spark, f"{index.folder}/{name}/version={version}"))
        state[name] = {b: v for b, v in mine.items() if b not in again} | {b: version for b in written}
    _publish(index.spark, index.folder, version, state)
    return opened(index.spark, index.folder, version)


def vacuum(index: TextIndex) -> None:
    """Removes the files that ``index``, the newest version, doesn't read, and the manifests before it."""
    for name, mine in (("postings", index.postings_versions), ("pages", index.pages_versions)):
        for version in range(1, index.version + 1):
            path = f"{index.folder}/{name}/version={version}"
            for b in _buckets_in(index.spark, path) if exists(index.spark, path) else []:
                if mine.get(b) != version:
                    remove(index.spark, f"{path}/bucket={b}")


def missing(index: TextIndex, pages: DataFrame, text: str = "text") -> DataFrame:
    """key and ``reason`` of what a repair has to do: ``absent`` or ``changed`` pages to index, and ``orphan`` ones to take out."""
    key = index.key
    now = pages.select(*key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_now"), F.lit(True).alias("_page"))
    both = now.join(index.pages().select(*key, "hash", F.lit(True).alias("_held")), key, "full")
    reason = F.when(F.col("_held").isNull(), "absent").when(F.col("_page").isNull(), "orphan").when(F.col("hash") != F.col("_now"), "changed")
    return both.select(*key, reason.alias("reason")).where("reason is not null")


def repaired(index: TextIndex, pages: DataFrame, text: str = "text") -> TextIndex:
    """The index brought in step with ``pages``: nothing but pages that differ is tokenized or written."""
    found = stored(missing(index, pages, text))
    wrong = found.where("reason <> 'orphan'").select(*index.key)
    return upsert(index, pages.join(wrong, index.key, "left_semi"), found.where("reason = 'orphan'"), text)


def _hits(index: TextIndex, query: Query, project: str | None = None) -> DataFrame:
    """key, length and the positions of each slot, of pages that have one of them; only the buckets of the slots are read."""
    slots = query.slots
    short = any(prefix and len(token) < LETTERS for token, prefix in slots)
    tokens_wanted = index.spark.createDataFrame([(t,) for t, _ in slots], "token string")
    wanted = None if short else sorted({r[0] for r in tokens_wanted.select(bucket_of(F.col("token"), index.buckets)).collect()})
    rows = index.postings(wanted).where(functools.reduce(operator.or_, (fits(F.col("token"), s) for s in slots), F.lit(False)))
    if project is not None:
        rows = rows.where(F.col(index.key[0]) == project)
    # A prefix may have several tokens on a page.
    at = [F.flatten(F.collect_list(F.when(fits(F.col("token"), s), F.col("positions")))).alias(f"p{k}") for k, s in enumerate(slots)]
    return rows.groupBy(*index.key, "length").agg(F.count("*").alias("tokens"), *at)


def search(index: TextIndex, query: str, project: str | None = None) -> DataFrame:
    """key, rank (smaller is better) and score 1 / (1 + abs(rank)) of the pages that match ``query``.

    Each phrase of the query weighs by BM25 where the parts of the query that it belongs to match.
    """
    wanted, key = Query.of(query), index.key
    df = wanted.counted(_hits(index, wanted), *key).agg(F.count("*").alias("pages"), *wanted.frequencies()).first()
    counted = wanted.counted(_hits(index, wanted, project), *key, "length")
    return wanted.ranked(counted, key, index.n, index.total / index.n if index.n else None, df)
