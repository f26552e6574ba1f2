"""A corpus in five stages: quality, exact copies, near copies, benchmark passages, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from thalweg.llm import bpe, decontam, exact_dedup, quality, simhash
from thalweg.llm.common import read, shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more)."""
    return quality.drop_low_quality(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digests of the ids and of the decoded text."""
    import public_tokenizers

    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact_copies), ("simhash", drop_near_copies), ("decontaminate", drop_benchmark), ("bpe", tokenize)]

#: The stages' scores, fingerprints and tokens are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each is written to the shared folder and read again, so a lost executor costs a stage at most.

    A stage's folder goes once the next one is written; the last of them, which the result reads, stays.
    """
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(f"{folder}/{k}-{name}")
            out = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                _delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = out
    return docs
