"""Joins of pair tables, labelled datasets, hard negatives and stratified samples. Keys always include the basin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import FEATURES
from .pairs import normalise_pair

KEYS = ["basin", "outlet", "confluence", "head_1", "head_2"]


def _present(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def merge_asymmetry(coupling: DataFrame, asymmetry: DataFrame) -> DataFrame:
    return coupling.join(asymmetry.select(*KEYS, "L_1", "L_2", "delta_L", "distance_unit"), KEYS, "left")


def merge_geometry(base: DataFrame, geometry: DataFrame) -> DataFrame:
    """base with the geometric features that are there; where base has a column of that name, both get _x and _y."""
    columns = _present(geometry, [*FEATURES, "qc_flags"])
    if not columns:
        return base
    clash = [c for c in columns if c in base.columns]
    left, right = base, geometry.select(*KEYS, *columns)
    for c in clash:
        left, right = left.withColumnRenamed(c, f"{c}_x"), right.withColumnRenamed(c, f"{c}_y")
    return left.join(right, KEYS, "left")


def merge_embeddings(base: DataFrame, embeddings: DataFrame) -> DataFrame:
    """base with the columns emb_*; other columns of the right side are dropped, missing rows are NULL."""
    return base.join(embeddings.select(*KEYS, *[c for c in embeddings.columns if c.startswith("emb_")]), KEYS, "left")


def labelled_dataset(coupling: DataFrame, asymmetry: DataFrame | None = None, geometry: DataFrame | None = None) -> DataFrame:
    """Coupling with y = touching as 0 or 1, and the lengths and features that are given."""
    out = coupling.withColumn("y", F.col("touching").cast("int"))
    if asymmetry is not None:
        out = out.join(asymmetry.select(*KEYS, *_present(asymmetry, ["L_1", "L_2", "delta_L"])), KEYS, "left")
    return merge_geometry(out, geometry) if geometry is not None else out


def inner_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.drop(*[c for c in a.columns if c not in KEYS]), KEYS)


def update_from(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """old with the new values where there are any, matched within the basin."""
    renamed = new.select(*KEYS, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(renamed, KEYS, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def clean_pairs(df: DataFrame) -> DataFrame:
    """Pair rows as the other operators expect them: overlap_px dropped, smaller head first, defaults for what is missing."""
    require_columns(df, ["outlet", "confluence", "head_1", "head_2"])
    out = normalise_pair(df.drop("overlap_px"))
    defaults = {"basin": F.lit("unknown"), "qc_flags": F.lit("")} | {c: F.lit(None).cast("double") for c in FEATURES}
    return out.withColumns({c: v for c, v in defaults.items() if c not in out.columns})


def basin_settings(df: DataFrame, lat: float = 36.0, z_th: float = 0.0) -> DataFrame:
    """(basin, lat, z_th): the first known value of each basin in key order, or the defaults."""
    first = lambda c, d: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*KEYS[1:]))) if c in df.columns else F.lit(None).cast("double"), F.lit(d)).alias(c)
    return df.groupBy("basin").agg(first("lat", lat), first("z_th", z_th))


def mark_missing_stream(df: DataFrame, known: DataFrame) -> DataFrame:
    """qc_flags with missing_stream added in basins that no stream network is known for."""
    found = known.select("basin", F.lit(True).alias("_known")).distinct()
    flags = F.concat_ws(",", F.when(F.col("qc_flags") != "", F.col("qc_flags")), F.lit("missing_stream"))
    return df.join(found, "basin", "left").withColumn("qc_flags", F.when(F.col("_known"), F.col("qc_flags")).otherwise(flags)).drop("_known")


@dataclass(frozen=True)
class HardNegatives:
    """Limits for negatives relative to the positives' medians; fitted on one table, it filters another without leakage."""

    limits: DataFrame  # group columns, limit_L, limit_d
    group: str | None

    @staticmethod
    def fit(df: DataFrame, length_ratio: float = 3.0, distance_ratio: float = 5.0, group: str | None = None) -> HardNegatives:
        group = group if group in df.columns else None
        positive = F.col("y") == 1

        def limit(x, ratio):
            middle = F.percentile(F.when(positive, x), 0.5)
            return F.when(middle > 0, middle * ratio)

        sums = df.withColumn("_sum", F.col("L_1") + F.col("L_2")) if {"L_1", "L_2"} <= set(df.columns) else df.withColumn("_sum", F.lit(None).cast("double"))
        far = F.col("headhead_dist_m") if "headhead_dist_m" in df.columns else F.lit(None).cast("double")
        usable = F.bool_or(positive) & F.bool_or(F.col("y") == 0)
        rows = sums.filter(F.col(group).isNotNull()) if group else sums
        made = rows.groupBy(*[group] * bool(group)).agg(limit(F.col("_sum"), length_ratio).alias("limit_L"), limit(far, distance_ratio).alias("limit_d"), usable.alias("_usable"))
        return HardNegatives(made, group)

    def filter(self, df: DataFrame, crossing: DataFrame | None = None) -> DataFrame:
        """All positives, and negatives within the limits; an unknown length or limit passes.

        Where a group has no positives or no negatives all of it stays. A group column drops rows of the NULL group.
        crossing (basin, head_1, head_2): negatives that go as well.
        """
        total = F.col("L_1") + F.col("L_2") if {"L_1", "L_2"} <= set(df.columns) else F.lit(None).cast("double")
        far = F.col("headhead_dist_m") if "headhead_dist_m" in df.columns else F.lit(None).cast("double")
        joined = df.join(F.broadcast(self.limits), self.group) if self.group else df.crossJoin(F.broadcast(self.limits))  # a row for each group, or one
        within = lambda x, limit: x.isNull() | F.col(limit).isNull() | (x <= F.col(limit))
        kept = joined.filter(~F.col("_usable") | (F.col("y") == 1) | (within(total, "limit_L") & within(far, "limit_d")))
        if crossing is not None:
            kept = kept.join(crossing.select(*[k for k in ("basin", "head_1", "head_2") if k in df.columns], F.lit(True).alias("_crosses")).distinct(), [k for k in ("basin", "head_1", "head_2") if k in df.columns], "left")
            kept = kept.filter(~F.col("_usable") | (F.col("y") == 1) | F.col("_crosses").isNull())
        return kept.select(*df.columns)


def filter_hard_negatives(df: DataFrame, length_ratio: float = 3.0, distance_ratio: float = 5.0, group: str | None = None, crossing: DataFrame | None = None) -> DataFrame:
    """Fit and filter on the same table."""
    return HardNegatives.fit(df, length_ratio, distance_ratio, group).filter(df, crossing)


def negative_quotas(df: DataFrame, ratio: float) -> DataFrame:
    """(basin, quota): how many negatives of each basin stay, so that they are int(positives * ratio) in all.

    Quotas are the basins' shares, rounded half to even, then corrected by one for the basins with most negatives until
    the sum is right (once around). With fewer negatives than asked for all stay. There is a row for each basin.
    """
    n = df.groupBy("basin").agg(F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos"))
    totals = n.agg(F.sum("neg").alias("all_neg"), F.floor(F.sum("pos") * F.lit(float(ratio))).alias("target"))
    n = n.crossJoin(F.broadcast(totals))
    share = n.withColumn("share", F.when(F.col("all_neg") <= F.col("target"), F.col("neg")).otherwise(F.rint(F.col("neg") / F.col("all_neg") * F.col("target")).cast("long")))
    off = share.agg(F.sum("share").alias("sum_share")).select("sum_share")
    share = share.crossJoin(F.broadcast(off)).withColumn("missing", F.when(F.col("all_neg") <= F.col("target"), F.lit(0)).otherwise(F.col("target") - F.col("sum_share")))
    at = F.row_number().over(Window.orderBy(F.col("neg").desc(), "basin"))  # a row for each basin
    fixed = F.col("share") + F.when(at <= F.abs("missing"), F.signum(F.col("missing").cast("double")).cast("long")).otherwise(F.lit(0))
    return share.select("basin", F.greatest(F.lit(0), F.least(fixed, F.col("neg"))).cast("long").alias("quota"))


def stratified_negatives(df: DataFrame, ratio: float, seed: int = 42, order=None) -> DataFrame:
    """All positives, and each basin's quota of negatives in the order of a seeded hash of the keys (or a given order)."""
    quota = negative_quotas(df, ratio)
    by = order if order is not None else [F.xxhash64(F.lit(seed), *[c for c in KEYS if c in df.columns])]
    ranked = df.filter("y = 0").withColumn("_at", F.row_number().over(Window.partitionBy("basin").orderBy(*by)))
    kept = ranked.join(F.broadcast(quota), "basin").filter(F.col("_at") <= F.col("quota")).select(*df.columns)
    return df.filter("y = 1").unionByName(kept)
