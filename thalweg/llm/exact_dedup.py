"""Exact deduplication by a content sort, in DataFrame operations only.

Texts are normalised by deleting white space, dealt out by range (sampled splitters over the first characters of the
normalised text and its digest), sorted externally inside each range, and adjacent rows are compared in full.  A text
that a sample shows to be hot is cut into salted runs, which the splitters spread over several ranges; the runs' first
rows, one for each salt, are then merged by full comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, partitions

#: Leading characters of a normalised text that the splitters compare before its digest: bounds what range sampling brings to the driver.
PREFIX_CHARS = 16


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, seed: int = 17, carry: bool = False) -> DataFrame:
    """Group rows whose normalised texts are identical.

    Returns a row for each input row: doc_id, keep_id (the row that stays: the most code points in the original text,
    then the smallest id), group_size, kept (true for one row of each group) and text_sha256.

    Null texts are empty texts and form one group with them.  A row without an id is kept only in a group where no row
    of that length has one.  Of repeated rows (same id, same text) one is kept, the others carry kept = false.
    Columns other than the two named are ignored, whatever they are called.  An empty table gives an empty result.
    With carry, a struct _row holds all of the input's columns as well.

    sample_rows bounds the rows from which hot texts are estimated (50 for each shuffle partition at least); they decide
    only how work is dealt out, never the result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.struct(*docs.columns).alias("_row")] * carry)
    keyed = _keyed(rows, carry)
    hot = _hot(rows, n, max(sample_rows, 50 * n), seed)
    if hot:
        salts = spark.createDataFrame(hot, "text_sha256 string, _salts int")  # at most 4 n rows, see _hot
        keyed = keyed.join(F.broadcast(salts), "text_sha256", "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("_salts")).cast("int")).otherwise(-1)).drop("_salts")

    # Ranges over (prefix, digest, salt) keep a run in one range, so the windows need no further exchange.
    key = ["_prefix", "text_sha256", *["_salt"] * bool(hot)]
    ranged = keyed.repartitionByRange(*key)
    if carry:  # the original text has moved; normalising it again is cheaper than moving both
        ranged = ranged.withColumn("_norm", normalised(F.col(f"_row.`{text_col}`")))
    run = Window.partitionBy(*key, "_norm")
    sorted_run = run.orderBy("_rank")
    found = ranged.select(
        "doc_id", "_rank", "_norm", *key[1:], *["_row"] * carry,
        F.first("_rank").over(sorted_run).alias("_best"),
        F.count(F.lit(1)).over(run).alias("_size"),
        F.row_number().over(sorted_run).alias("_at"),
    )
    if hot:
        heads = found.filter((F.col("_salt") >= 0) & (F.col("_at") == 1))
        merged = heads.groupBy("text_sha256", "_norm").agg(F.min("_best").alias("_all_best"), F.sum("_size").alias("_all_size")).drop("_norm")
        found = found.drop("_norm").join(F.broadcast(merged), "text_sha256", "left").withColumns({"_best": F.coalesce("_all_best", "_best"), "_size": F.coalesce("_all_size", "_size")})
    return found.select("doc_id", F.col("_best.id").alias("keep_id"), F.col("_size").alias("group_size"), ((F.col("_at") == 1) & (F.col("_rank") == F.col("_best"))).alias("kept"), "text_sha256", *["_row"] * carry)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns."""
    return exact_dedup(docs, id_col, text_col, carry=True).filter("kept").select("_row.*")


def _keyed(rows: DataFrame, carry: bool) -> DataFrame:
    """_rank orders the rows of a group: longer originals first, then smaller ids, rows without an id last."""
    norm = normalised(F.col("_text"))
    keyed = rows.select(
        "doc_id",
        F.struct((-F.coalesce(F.char_length("_text"), F.lit(0))).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")).alias("_rank"),
        norm.alias("_norm"),
        *["_row"] * carry,
    ).select("*", F.substring("_norm", 1, PREFIX_CHARS).alias("_prefix"), F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"))
    return keyed.drop("_norm") if carry else keyed


def _hot(rows: DataFrame, n: int, sample_rows: int, seed: int) -> list[tuple[str, int]]:
    """Digests that hold over half the fair share of a partition in a sample, with the number of salts for each.

    At most 4 n digests can hold so much: a threshold of 1 / (4 n) of the sample bounds the list.
    """
    total = rows.count()
    if total < 2 * n:
        return []
    sampled = rows.sample(False, min(1.0, sample_rows / total), seed).select(F.sha2(normalised(F.col("_text")).cast("binary"), 256).alias("text_sha256"))
    size = min(total, sample_rows)
    counts = sampled.groupBy("text_sha256").count().filter(F.col("count") >= max(4, size / (4 * n))).collect()
    return [(r["text_sha256"], 1 + int(4 * n * r["count"] / size)) for r in counts]
