"""A training-corpus pipeline over `documents`: five stages, each reading what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veridra.llm import bpe, decontam, linededup, quality, simhash
from veridra.llm.common import checkpoint_dir, table
from veridra.llm.queries import WORD_VOCAB, vocab


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, vocab(WORD_VOCAB))


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("simhash", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

#: None: fuzzy line dedup, latent retrieval and BPE have no SQL form; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in order; each result is written as Parquet to the shared folder and reread. What
    a later result has replaced is deleted; the last one written stays, as the rows that are returned read it."""
    docs, root = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
        if k:
            _delete(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store Spark reaches it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
