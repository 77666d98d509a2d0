"""A training corpus from ``documents``: five stages, each over all that the one before kept.

All stages but the last return the columns of ``documents``, others included; ``n_chars`` follows the text.
Rows with a null text count as clean and stay until they are packed, as their end id alone; rows with a null id
can't be named by the stages that remove documents by id, and stay.  Rows that share an id are one document: they
go together.  Of ties the smallest id stays.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard, lines, packing, toxicity
from quire.llm._common import WORD, materialize, read, small_batches
from quire.llm.queries import tokenizer

#: Ids that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id isn't among ``ids``."""
    ids = materialize(ids.select("doc_id").distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that have no word left by it."""
    found = lines.line_dedup(docs)
    emptied = (F.col("n_deleted") > 0) & ~F.col("text").rlike(WORD)
    return found.where(~emptied).withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies the one with the smallest id stays."""
    return _without(docs, jaccard.jaccard_join(docs).where(F.col("component_id") != F.col("doc_id"))).select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item, edited or not, go."""
    with small_batches(spark):
        return _without(docs, decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences."""
    return packing.best_fit_packing(docs, tokenizer())


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", lines_once),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", not_in_benchmark),
    ("best_fit_packing", packed),
]

#: Stages whose result is a checkpoint already.
CUT = {"toxicity"}

#: Word hashes, tokenization and a fitted model: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name in CUT else materialize(docs)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
