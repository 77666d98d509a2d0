"""Sources: page images in zip archives and folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import file_stem, flat_stem, is_image

ENTRIES = "path string, archive_bytes long, entry string, pos int, size long, content binary"
ROWS = 1000


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of every file, by any path Spark can open."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def entries(archives: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per file of each zip archive (path, content), in the archive's order; broken archives have none.

    With ``names`` only files of these names are unpacked.
    """

    def unpacked(path: str, content: pa.Scalar) -> Iterator[tuple]:
        if not content.is_valid:
            return
        try:
            # Read where it lies, without a copy.
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                for pos, info in enumerate(z.infolist()):
                    if not info.is_dir() and (names is None or info.filename in names):
                        yield path, len(content.as_buffer()), info.filename, pos, info.file_size, z.read(info)
        except zipfile.BadZipFile:
            return

    kinds = pa.schema([("path", pa.string()), ("archive_bytes", pa.int64()), ("entry", pa.string()), ("pos", pa.int32()), ("size", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (row for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for row in unpacked(path, content))
            for rows in bounded(found, lambda row: len(row[-1])):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return archives.select("path", "content").mapInArrow(read, ENTRIES)


def bounded(rows: Iterator[tuple], size: Callable[[tuple], int], most: int = 1 << 22) -> Iterator[list[tuple]]:
    """Rows in lists of ``ROWS`` at most that end where their sizes reach ``most``: entries together may be large."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) == ROWS or total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


LISTED = "path string, pos int, entry string, size long, compressed long, crc long, place long"


def listing(archives: DataFrame) -> DataFrame:
    """One row per entry of each zip archive (path, content) from its directory at the end, folders too; no entry is unpacked.

    Archives that can't be read have none.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, k, i.filename, i.file_size, i.compress_size, i.CRC, i.header_offset) for k, i in enumerate(z.infolist())]
                except (zipfile.BadZipFile, ValueError, OSError):
                    continue
                yield pd.DataFrame(rows, columns=["path", "pos", "entry", "size", "compressed", "crc", "place"])

    return archives.select("path", "content").mapInPandas(read, LISTED)


def archive_records(archives: DataFrame) -> DataFrame:
    """path, sha256, size_bytes, file_count of each archive, 0 entries for one that can't be read."""
    counted = listing(archives).groupBy("path").agg(F.count("*").alias("file_count"))
    out = archives.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"))
    return out.join(counted, "path", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


MANIFEST = "book_name string, project_id string, built_at string, page_count long, illustration_count long"


def package_manifests(archives: DataFrame, project: Column) -> DataFrame:
    """What a package says of itself in pgdp.json, with its record: project, pages, canvas (the book's name), built, files, sha256.

    Where there is none, or none that can be read, ``project`` and empty values stand in.
    """
    told = entries(archives, ["pgdp.json"]).select("path", F.decode("content", "utf-8").alias("told")).dropDuplicates(["path"])
    return described(archive_records(archives).join(told, "path", "left"), F.col("told"), project)


def described(records: DataFrame, told: Column, project: Column) -> DataFrame:
    """Records of packages with what ``told``, their manifest, says."""
    out = records.withColumn("_project", project).withColumn("m", F.from_json(told, MANIFEST))
    return out.select(
        "path", F.coalesce("m.project_id", "_project").alias("project"), F.coalesce("m.page_count", F.lit(0)).alias("pages"), F.coalesce("m.book_name", F.lit("")).alias("canvas"),
        F.coalesce("m.built_at", F.lit("")).alias("built"), F.col("file_count").alias("files"), "sha256",
    )


def page_images(found: DataFrame) -> DataFrame:
    """Images among archive entries with a stem of their own and their place ``idx0``.

    Entries whose flattened stems clash get _2, _3 and so on in the archive's order.
    """
    images = found.where(is_image(F.col("entry"))).withColumn("base", flat_stem(F.col("entry")))
    images = images.withColumn("copy", F.row_number().over(Window.partitionBy("path", "base").orderBy("pos")))
    images = images.withColumn("stem", F.when(F.col("copy") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("copy").cast("string"))))
    # A suffix may itself clash with another entry's stem; then the place in the archive tells them apart.
    again = F.row_number().over(Window.partitionBy("path", "stem").orderBy("copy", "pos"))
    images = images.withColumn("stem", F.when(again > 1, F.concat("stem", F.lit("_"), (F.col("pos") + 1).cast("string"))).otherwise(F.col("stem")))
    return images.withColumn("idx0", F.row_number().over(Window.partitionBy("path").orderBy("stem")) - 1).drop("base", "copy")


def folder_images(found: DataFrame) -> DataFrame:
    """Images of a folder by stem."""
    images = found.where(is_image(F.col("path"))).withColumn("stem", file_stem(F.col("path"))).withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    return images.withColumn("idx0", F.row_number().over(Window.partitionBy("folder").orderBy("stem", "path")) - 1)


def first_names(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` names of each archive and how many there are: a peek."""
    order = Window.partitionBy("path").orderBy("entry")
    out = found.select("path", "entry").withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("path")))
    return out.where(F.col("rank") <= n)


def page_dirs(found: DataFrame) -> DataFrame:
    """Page ids that have a folder under ``pages/``; hidden ones aren't pages."""
    return found.select(F.regexp_extract("path", r"/projects/([^/]+)/pages/([^/.][^/]*)/", 1).alias("project_id"), F.regexp_extract("path", r"/pages/([^/.][^/]*)/", 1).alias("page_id")).where("page_id <> ''").distinct()


def words(blobs: DataFrame, json: str = "json") -> DataFrame:
    """Words of OCR blobs; a missing ``deleted`` is false."""
    kind = "array<struct<id:string,text:string,confidence:double,bounding_box:struct<left:int,top:int,width:int,height:int>,split_suffix:string,deleted:boolean>>"
    out = blobs.withColumn("_w", F.explode(F.from_json(json, kind)))
    return out.select(*[c for c in blobs.columns if c != json], F.col("_w.id").alias("word_id"), "_w.text", "_w.confidence", "_w.bounding_box.*", F.coalesce("_w.deleted", F.lit(False)).alias("deleted"))
