"""The training-data pipeline: stages over documents, each written and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps, with
the columns of documents (the last stage: token ids instead of texts). Rows whose doc_id is
null are documents like others, and rows that share a doc_id are told apart by their text.
"""

from __future__ import annotations

import functools

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplane.llm import bagminhash, bpe, decontaminate, langid, toxicity
from lumenplane.llm.common import columns_of, driver_gives_back, frugally, held_out, settings, table, work_dir, written

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
#: Rows of an Arrow batch in the last stage, and bytes of texts split together: its executors have other stages behind them.
BATCH_ROWS, GROUP_BYTES = "2000", 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.fit(docs.where(~held_out()), labels)
    return columns_of(toxicity.score(docs, model).where("predicted = 0"), docs)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    return columns_of(langid.predict(docs, langid.fit(docs.where(~held_out()))).where("not rejected"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id, null last."""
    return bagminhash.representatives(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, whole or edited."""
    return columns_of(decontaminate.flag(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written in small batches: several workers of a task hold texts at once."""
    ids = bpe.encode(docs, RANKS, P.PATTERN, keep=["doc_id", "lang", "source"], group_bytes=GROUP_BYTES).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        return written(ids, f"{work_dir(spark)}/ids")


def _small(stage):
    """The stage over small batches, whoever writes what it returns: executors have other stages behind them, and so has the driver."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        driver_gives_back(spark)
        return stage(spark, frugally(docs), sf_dir)

    return run


STAGES = [
    ("toxicity", _small(drop_toxic)),
    ("language_id", _small(drop_unknown_language)),
    ("near_dedup", _small(drop_near_duplicates)),
    ("decontamination", _small(drop_benchmark_copies)),
    ("bpe", _small(tokenize)),
]

#: Trained models and hashed signatures are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}_{name}")
    return docs
