"""Input tables, and tables that are kept in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of an input folder, by any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoints-"))
    return context.getCheckpointDir()


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read from there: made once, and its lineage is cut."""
    path = f"{shared_folder(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def kept_folder(spark: SparkSession, sf_dir: str, name: str, purpose: str) -> str:
    """A folder for what is derived from an input table as it is now: other files, or files of other sizes or times, give another folder."""
    files, where = _file_system(spark, f"{sf_dir}/{name}.parquet")
    found = files.listFiles(where, True)
    state = []
    while found.hasNext():
        f = found.next()
        state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return f"{shared_folder(spark)}/{purpose}-{hashlib.sha256(repr(sorted(state)).encode()).hexdigest()[:16]}"
