"""Samples, splits and folds by seeded hashes: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(seed: int, *columns: str) -> Column:
    """The first 48 bits of the MD5 of the seed and the columns joined by |; NULL counts as empty."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def sample_per_group(df: DataFrame, group: str, k: int, ids: list[str], seed: int = 42, order: list | None = None) -> DataFrame:
    """At most k rows of each group."""
    w = Window.partitionBy(group).orderBy(*(order or [hashed(seed, *ids)]))
    return df.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= k).drop("_at")


def sample_rows(df: DataFrame, k: int, ids: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(hashed(seed, *ids)).limit(k)


def group_split(df: DataFrame, groups: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """is_test, the same for all rows of a group."""
    return df.withColumn("is_test", F.pmod(hashed(seed, *groups), F.lit(1_000_000)) < int(test_share * 1_000_000))


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """fold 0 .. k - 1: groups by size are dealt in turn, back and forth, so that folds come out about even."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.orderBy(F.col("n").desc(), group)) - 1  # a row for each group
    turn = F.pmod(at, F.lit(2 * k))
    folds = sizes.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return df.join(F.broadcast(folds) if sizes.limit(100_001).count() <= 100_000 else folds, group)


def stratified_folds(df: DataFrame, label: str, ids: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """fold 0 .. k - 1 by a hash, so that each label is spread evenly in expectation without any sort."""
    return df.withColumn("fold", F.pmod(hashed(seed, label, *ids), F.lit(k)).cast("int"))


def hold_out(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """(rest, held out)."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value))), df.filter(F.col(column) == value)


def permutation_split(df: DataFrame, ids: list[str], share: float, seed: int = 42) -> DataFrame:
    """is_validation for about a share of the rows, drawn one by one."""
    return df.withColumn("is_validation", F.pmod(hashed(seed, *ids), F.lit(1_000_000)) < int(share * 1_000_000))
