"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words and that exact deduplication deletes: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of our own only in one process, as in tests.

    On a cluster that names none this is a ValueError: a folder of one machine would lose data without a word.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def checkpoint(df: DataFrame, shrink: int = 1) -> DataFrame:
    """df, written to the shared folder and read from there, with its lineage cut: a lost executor loses none of it.

    shrink: into how many times fewer files than there are shuffle partitions, for what is much smaller than the corpus.
    """
    shared_dir(df.sparkSession)
    if shrink > 1:
        df = df.coalesce(max(1, partitions(df.sparkSession) // shrink))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1, ...: names that clash, in any case, no longer do."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def picked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), by exact names, whatever other columns are called."""
    at = docs.columns.index
    return numbered(docs).select(F.col(f"_{at(id_col)}").alias("doc_id"), F.col(f"_{at(text_col)}").alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
