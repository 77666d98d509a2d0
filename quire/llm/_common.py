"""What the operators share: white space, words, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: Bits of a bitmap of keys.
BITS = 1 << 23
#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of texts that Spark hands to a Python worker at once, and its setting for it.
BATCH, ROWS_AT_ONCE = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside gets at most ``BATCH`` rows at once: texts of Spark's usual 10,000 take tens of MB in the JVM and as many in a Python worker, for each task."""
    before = spark.conf.get(ROWS_AT_ONCE)
    spark.conf.set(ROWS_AT_ONCE, str(min(int(before), BATCH) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(ROWS_AT_ONCE, before)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoints-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def marked(frame: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Adds ``_hit``: true for rows whose keys are in ``wanted``, and for the few that share one of ``BITS`` bits with one of them.

    What goes to the executors is a bitmap of at most ``BITS / 64`` rows, whatever the size of ``wanted``.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    word, place = F.floor(F.col("_bit") / 64).alias("_word"), "cast(_bit % 64 as int)"
    bitmap = wanted.select(bit.alias("_bit")).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {place})")).alias("_bits"))
    out = frame.withColumn("_bit", bit).withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left")
    return out.withColumn("_hit", F.coalesce(F.expr(f"shiftrightunsigned(_bits, {place}) & 1 = 1"), F.lit(False))).drop("_bit", "_word", "_bits")


class Tables:
    """Tables written to the shared folder, which cut the lineage as a checkpoint does and can be deleted once nothing reads them.

    Once a table is written nothing reads the shuffles that led to it, so their files are removed at once rather
    than when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._folder = spark, f"{shared_folder(spark)}/quire-{uuid.uuid4()}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        before = self._spark.conf.get(CLEANUP, None)
        self._spark.conf.set(CLEANUP, "true")
        try:
            # A query takes the setting when it is made.
            df.select("*").write.parquet(path)
        finally:
            self._spark.conf.unset(CLEANUP) if before is None else self._spark.conf.set(CLEANUP, before)
        stored = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(stored)] = (stored, path)
        return stored

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            if id(frame) in self._paths:
                path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(frame))[1])
                path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
