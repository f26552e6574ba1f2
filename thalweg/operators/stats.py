"""Summaries and exact evaluation metrics as aggregates and windows. NaN must have become NULL at the scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def five_numbers(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """median, p25, p75, mean, std (of the population), count of the known values; NULL and 0 where there are none."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = df.groupBy(*(keys or [])).agg(q.alias("q"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("count"))
    return agg.select(*(keys or []), F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "mean", "std", "count")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, mean, std (of a sample), min, quartiles, max."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"))
    return out.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, pct_missing)."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = sums.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])))
    return long.select("column", "n_missing", F.try_divide(F.col("n_missing") * 100.0, F.col("n")).alias("pct_missing"))


def coupling_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs, touching pairs, others and the touching share of each key."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("touching").cast("int")).alias("n_touching"), F.round(F.avg(F.col("touching").cast("double")), 3).alias("touching_rate"))
    return out.withColumn("n_not_touching", F.col("n_pairs") - F.col("n_touching"))


def basin_summary(coupling: DataFrame, asymmetry: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Pairs, touching share and the five numbers of delta_L of each basin; with config (name, ...), its columns too, as config_*."""
    out = coupling_summary(coupling, ["basin"]).join(five_numbers(asymmetry, "delta_L", ["basin"]), "basin", "left")
    if config is None:
        return out
    known = config.select(F.lower("name").alias("_name"), *[F.col(c).alias(f"config_{c}") for c in config.columns if c != "name"])
    return out.join(known, F.lower("basin") == F.col("_name"), "left").drop("_name")


def compare_experiments(df: DataFrame, experiment: str, column: str) -> DataFrame:
    """Median, quartiles and count of a column by experiment."""
    return five_numbers(df, column, [experiment]).select(experiment, "median", "p25", "p75", "count")


def failures(runs: DataFrame) -> DataFrame:
    """Of rows (basin, error, n_pairs): how many basins succeeded and failed, and the pairs of those that succeeded."""
    good = F.col("error").isNull()
    return runs.agg(F.count_if(good).alias("n_done"), F.count_if(~good).alias("n_failed"), F.coalesce(F.sum(F.when(good, F.col("n_pairs"))), F.lit(0)).alias("n_pairs"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for all pairs of columns, each over the rows that know both."""
    known = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[known(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


def target_correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, corr) of each column with the target, the strongest of either sign first, unknown ones last."""
    wide = df.agg(*[F.corr(F.when(F.col(target).isNotNull(), F.col(c).cast("double")), F.when(F.col(c).isNotNull(), F.col(target).cast("double"))).alias(f"c{i}") for i, c in enumerate(columns)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")).alias("corr")) for i, c in enumerate(columns)])))
    return long.orderBy(F.abs("corr").desc_nulls_last(), "column")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n, density) over the data's range; the last bin is closed."""
    span = df.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("total"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("a")) / F.when(F.col("b") > F.col("a"), width)))).otherwise(F.lit(0)).cast("int")
    counted = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = all_bins.join(F.broadcast(counted), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bin", (F.col("a") + width * F.col("bin")).alias("lo"), (F.col("a") + width * (F.col("bin") + 1)).alias("hi"), "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def nearest_to_median(df: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key whose value is nearest to the key's median; ties by the order."""
    mid = df.groupBy(*keys).agg(F.percentile(column, 0.5).alias("_mid"))
    joined = df.join(mid, keys).filter(F.col(column).isNotNull())
    return joined.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col(column) - F.col("_mid")).alias("d"), *order)).alias("m")).select(*keys, F.col("m.d").alias("distance"), *[F.col(f"m.{c}") for c in order])


def largest_group(df: DataFrame, keys: list[str], group: str, condition: Column | None = None) -> DataFrame:
    """The group with most rows of each key (rows that meet the condition, or all where none does); ties to the lowest."""
    hits = F.count_if(condition) if condition is not None else F.count(F.lit(1))
    n = df.groupBy(*keys, group).agg(hits.alias("hits"), F.count(F.lit(1)).alias("rows"))
    some = F.max("hits").over(Window.partitionBy(*keys)) > 0
    n = n.withColumn("n", F.when(some, F.col("hits")).otherwise(F.col("rows")))
    return n.groupBy(*keys).agg(F.max_by(F.struct(group, "n"), F.struct("n", -F.col(group))).alias("m")).select(*keys, F.col(f"m.{group}"), F.col("m.n").alias("n"))


# -- binary classification: columns y (0, 1) and score


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score: the windows below run over these, pre-aggregated."""
    return df.filter(F.col("score").isNotNull() & F.col("y").isNotNull()).groupBy(*keys, "score").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("q"))


#: Ranges of the score over which running sums are taken in parallel.
RANGES = 256


def _running(n: DataFrame, keys: list[str]) -> DataFrame:
    """With the sums over larger scores (own one included) tp, fp, over all scores all_p, all_q.

    Scores are cut at approximate quantiles; windows run inside a range, and the ranges' totals, of which there are
    RANGES + 1 for each key at most, are added: no task sees all scores. The cuts decide only how work is dealt out.
    """
    cuts = n.agg(F.percentile_approx("score", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 10_000).alias("_cuts"))
    n = n.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")  # one row
    inside = Window.partitionBy(*keys, "_range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = n.groupBy(*keys, "_range").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    above, whole = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_above_{c}") for c in "pq"], *[F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in "pq"])
    other = totals.toDF(*[f"_{k}" for k in keys], "_of", *totals.columns[len(keys) + 1 :])
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = n.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in "pq"}).join(other, same)
    return joined.select(*keys, "score", "p", "q", (F.col("_in_p") + F.col("_above_p")).alias("tp"), (F.col("_in_q") + F.col("_above_q")).alias("fp"), "all_p", "all_q")


def confusion(df: DataFrame, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1; a ratio with nothing below the line is 0."""
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    n = df.groupBy(*(keys or [])).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties half; NULL with a single class."""
    keys = keys or []
    n = _running(_counted(df, keys), keys)
    won = F.col("p") * (F.col("all_q") - F.col("fp") + F.col("q") / 2)
    return n.groupBy(*keys).agg(F.try_divide(F.sum(won), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def curve(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A point for each distinct score: tp, fp, tpr, fpr, precision and recall of calling it and all larger ones positive."""
    keys = keys or []
    n = _running(_counted(df, keys), keys)
    return n.select(*keys, "score", "tp", "fp", F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_q").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "all_p").alias("recall"))


def average_precision(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sum over scores of the share of positives there times the precision."""
    keys = keys or []
    n = _running(_counted(df, keys), keys)
    part = F.try_divide("p", "all_p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return n.groupBy(*keys).agg(F.sum(part).alias("average_precision"))


def best_threshold(df: DataFrame, least_recall: float = 0.5, fallback: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """The score with the highest precision among those with enough recall (then the highest score); a fallback without one."""
    keys = keys or []
    good = F.when(F.col("recall") >= least_recall, F.struct("precision", "score", "recall"))
    best = curve(df, keys).groupBy(*keys).agg(F.max(good).alias("b"))
    return best.select(*keys, F.coalesce("b.score", F.lit(fallback)).alias("threshold"), F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def ks_two_sample(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The largest distance of the classes' empirical distributions, and its asymptotic p-value."""
    keys = keys or []
    apart = curve(df, keys).groupBy(*keys).agg(F.max(F.abs(F.col("tpr") - F.col("fpr"))).alias("ks"), F.max("tp").alias("n1"), F.max("fp").alias("n0"))
    root = F.sqrt(F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0")))
    x = root * F.col("ks")
    terms = [F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * x * x) for j in range(1, 101)]
    p = F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(terms[1:], terms[0]))))
    return apart.select(*keys, "ks", "n1", "n0", p.alias("p_value"))


def kernel_density(df: DataFrame, column: str, points: list[float], bandwidth: float) -> DataFrame:
    """(at, density): a Gaussian kernel's estimate at given points; a row for each point and partition is all that moves."""
    grid = F.array(*[F.lit(float(p)) for p in points])
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("x"), F.explode(grid).alias("at"))
    z = (F.col("x") - F.col("at")) / bandwidth
    return rows.groupBy("at").agg((F.sum(F.exp(-0.5 * z * z)) / (F.count(F.lit(1)) * bandwidth * math.sqrt(2 * math.pi))).alias("density"))
