"""Bounded samples of labelled documents, for fitting the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, picked

#: Hash values that a sample is drawn from, and bytes of text that are drawn at most.
BUCKETS, TRAIN_BYTES = 1 << 20, 64_000_000


def remainder(doc_id, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, train_bytes: int = TRAIN_BYTES) -> tuple[list[str], np.ndarray]:
    """labelled_rows, brought to the driver, as distinct() has them."""
    return distinct([tuple(r) for r in labelled_rows(docs, labels, label, folds, held_out, rows, train_bytes).collect()])


def distinct(rows: list[tuple]) -> tuple[list[str], np.ndarray]:
    """Texts and labels of rows (doc_id, y, text), in the order of doc_id. Repeated texts enter once, with the larger label."""
    once: dict[str, int] = {}
    for _, y, text in sorted(rows, key=lambda r: (r[0], r[2])):
        once[text] = max(y, once.get(text, 0))
    return list(once), np.fromiter(once.values(), dtype=np.int64, count=len(once))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, y, text): at most about `rows` whole texts, of train_bytes together, and their labels, drawn by a hash of doc_id.

    Held-out rows (crc32(doc_id as text) mod folds = held_out), null ids, null labels and labels other than 0 and 1 never
    enter.  The sample is drawn from all labels alike, so it represents any size; its bound keeps the memory of whoever
    takes it.  Of rows that share a doc_id the smallest text enters; texts that do not fit the bytes any more are passed
    over, in the order of the hash.
    """
    train = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), folds) != held_out))
    total = train.count()
    share = int(min(1.0, rows / max(1, total)) * BUCKETS)
    drawn = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)) < share).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = picked(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # as many as `rows`
    found = checkpoint(found.withColumn("bytes", F.octet_length("text")).withColumn("at", F.xxhash64("doc_id")))
    left, out = train_bytes, []
    for r in sorted(found.select("doc_id", "at", "bytes").collect(), key=lambda r: (r["at"], r["doc_id"])):
        if r["bytes"] <= left:
            left -= r["bytes"]
            out.append(r["doc_id"])
    if len(out) < found.count():
        fitting = docs.sparkSession.createDataFrame([(i,) for i in out], found.select("doc_id").schema)
        found = found.join(F.broadcast(fitting), "doc_id", "left_semi")
    return found.select("doc_id", "y", "text")
