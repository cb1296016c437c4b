"""A corpus pipeline over ``documents``: identify languages, apply quality rules,
leave one of each group of near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next one.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinframe.llm import jaccard, langid, mixing, pieces, quality
from twinframe.llm.common import ensure_checkpoint_dir, table, unique_name
from twinframe.llm.queries import tokenizer_file

#: What Spark hands to a Python worker at a time; a batch is held by the JVM, outside its heap, and by the worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound what rows on their way to Python take; holds for the session, as stages run after they return."""
    for name, value in BATCHES.items():
        spark.conf.set(name, str(value))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    small_batches(spark)
    return langid.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; exact copies count once, as the next stage leaves one of them."""
    return quality.keep_good(docs, copies_once=True)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8."""
    small_batches(spark)
    return jaccard.keep_one_of_each(docs, k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row."""
    small_batches(spark)
    return pieces.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("quality_rules", good),
    ("jaccard_join", single),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Language profiles and subword ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; intermediate tables go to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{unique_name('pipeline')}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
