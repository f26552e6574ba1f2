"""Geometric features of pairs, as one plan over path rows: no path is gathered but by its own pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EPSILON, angle_between, azimuth, azimuth_difference, distance
from ..plans.materialize import materialize
from .network import Network
from .pairs import head_paths

KEYS = ["basin", "outlet", "confluence", "head_1", "head_2"]
#: What points depend on: a head and a confluence on its way, which many pairs share.
WAY = ["basin", "head", "confluence"]
FEATURES = ["orientation_diff_deg", "headhead_dist_m", "headhead_dist_norm", "apex_angle_deg", "strahler_order_diff", "proximity_mean_m", "proximity_max_m", "proximity_profile_norm"]
#: Nodes under which a direction rests on a short path.
LEAST_NODES = 4


def _points(pairs: DataFrame, ways: DataFrame, net: Network, scale: float) -> DataFrame:
    """Path rows of each WAY that pairs have, once for all of them, with x, y in metres, the edge to the next node, and the length so far.

    Lengths are summed once along each head's whole way; a confluence cuts it at its own place.
    """
    place = net.nodes.select("basin", F.col("node_id").alias("node"), (F.col("c") * scale).alias("x"), (-F.col("r") * scale).alias("y"))
    w = Window.partitionBy("basin", "head").orderBy("pos")
    steps = ways.select("basin", "head", "pos", "node").join(place, ["basin", "node"])
    steps = steps.select("*", F.lead("x").over(w).alias("xn"), F.lead("y").over(w).alias("yn"))
    steps = steps.withColumn("edge", F.coalesce(distance(F.col("x"), F.col("y"), F.col("xn"), F.col("yn")), F.lit(0.0)))
    before = F.coalesce(F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    steps = steps.withColumn("so_far", before)
    taken = pairs.select("basin", F.explode(F.array("head_1", "head_2")).alias("head"), "confluence").distinct()
    ends = steps.select("basin", "head", F.col("node").alias("confluence"), F.col("pos").alias("last"), F.col("so_far").alias("total"))
    rows = taken.join(ends, WAY).join(steps, ["basin", "head"]).filter("pos <= last")
    on = F.col("pos") < F.col("last")
    return rows.select(*WAY, "x", "y", F.when(on, F.col("xn")).alias("xn"), F.when(on, F.col("yn")).alias("yn"), F.when(on, F.col("edge")).otherwise(0.0).alias("edge"), "so_far", "total")


def directions(points: DataFrame, within: float) -> DataFrame:
    """dx, dy: the length-weighted mean of edges over the first `within` metres of each WAY; flag: what is short.

    An edge counts if the path was shorter than `within` at its start, so the last one may reach beyond.
    """
    near = (F.col("so_far") < within) & F.col("xn").isNotNull()
    long = F.when(near & (F.col("edge") > EPSILON), F.col("edge"))
    sums = points.groupBy(*WAY).agg(
        (F.count_if(near) + 1).alias("n"), F.sum((F.col("xn") - F.col("x")) * long).alias("sx"), F.sum((F.col("yn") - F.col("y")) * long).alias("sy"), F.sum(long).alias("w")
    )
    flag = F.when(F.col("n") < 2, "single_edge").when(F.col("n") < LEAST_NODES, "short_path")
    return sums.select(*WAY, flag.alias("flag"), (F.col("sx") / F.col("w")).alias("dx"), (F.col("sy") / F.col("w")).alias("dy"))


def resample(points: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """(keys, k, x, y): points at the shares k / n of each path's length, k = 0 .. n - 1, interpolated along its edges."""
    spans = points.filter(F.col("xn").isNotNull() & (F.col("total") > EPSILON))
    lo, hi = F.col("so_far") / F.col("total"), (F.col("so_far") + F.col("edge")) / F.col("total")
    share = F.col("k") / F.lit(float(n))
    at = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).filter((lo <= share) & (share < hi))
    part = F.when(hi - lo > EPSILON, (share - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return at.select(*keys, "k", (F.col("x") + part * (F.col("xn") - F.col("x"))).alias("x"), (F.col("y") + part * (F.col("yn") - F.col("y"))).alias("y"))


def proximity(pairs: DataFrame, sampled: DataFrame) -> DataFrame:
    """Mean and largest distance of the two paths' points with equal k, and their ratio; `sampled` holds n points of a path."""
    both = pairs
    for k in "12":
        both = both.join(sampled.toDF("basin", f"head_{k}", "confluence", f"at{k}"), ["basin", f"head_{k}", "confluence"])
    spots = both.select(*KEYS, F.explode("at1").alias("a"), "at2").select(*KEYS, "a", F.explode(F.filter("at2", lambda b: b["k"] == F.col("a.k"))).alias("b"))
    d = distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    out = spots.groupBy(*KEYS).agg(F.avg(d).alias("proximity_mean_m"), F.max(d).alias("proximity_max_m"))
    return out.withColumn("proximity_profile_norm", F.when(F.col("proximity_max_m") > EPSILON, F.col("proximity_mean_m") / F.when(F.col("proximity_max_m") > EPSILON, F.col("proximity_max_m"))))


def evaluate_geometry(pairs: DataFrame, net: Network, orders: DataFrame | None = None, lengths: DataFrame | None = None, scale: float = 1.0, direction_m: float = 500.0, samples: int = 10, ways: DataFrame | None = None) -> DataFrame:
    """The keys, FEATURES and qc_flags (comma-separated) of each pair.

    orders: (basin, node_id, strahler); lengths: the keys with L_1 and L_2, for the normalised distance. Pairs with
    unknown nodes are left out.
    """
    ways = head_paths(net) if ways is None else ways
    pairs = pairs.select(*KEYS)
    base = pairs
    for k, node in (("1", "head_1"), ("2", "head_2"), ("0", "confluence")):
        base = base.join(net.nodes.select("basin", F.col("node_id").alias(node), (F.col("c") * scale).alias(f"x{k}"), (-F.col("r") * scale).alias(f"y{k}")), ["basin", node])
    base = base.join(lengths.select(*KEYS, "L_1", "L_2"), KEYS, "left") if lengths is not None else base.withColumns({"L_1": F.lit(None).cast("double"), "L_2": F.lit(None).cast("double")})
    points = _points(pairs, ways, net, scale)
    spots = resample(points, samples, WAY).groupBy(*WAY).agg(F.collect_list(F.struct("k", "x", "y")).alias("at"))
    turned = materialize(directions(points, direction_m).join(spots, WAY, "left"))
    for k in "12":
        here = ["basin", f"head_{k}", "confluence"]
        base = base.join(turned.select(F.col("basin"), F.col("head").alias(f"head_{k}"), "confluence", F.col("flag").alias(f"flag{k}"), azimuth(F.col("dx"), F.col("dy")).alias(f"az{k}")), here, "left")
        via = ways.select("basin", F.col("head").alias(f"head_{k}"), F.col("node").alias("confluence"), F.col("via").alias("node_id"))
        if orders is not None:
            base = base.join(via.join(orders, ["basin", "node_id"]).select("basin", f"head_{k}", "confluence", F.col("strahler").alias(f"order{k}")), ["basin", f"head_{k}", "confluence"], "left")
        else:
            base = base.withColumn(f"order{k}", F.lit(None).cast("int"))
    base = base.join(proximity(pairs, turned.select(*WAY, "at").filter("at IS NOT NULL")), KEYS, "left")
    apart = distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    reach = F.col("L_1") + F.col("L_2")
    flags = F.array_compact(F.array(
        F.concat(F.lit("orient1:"), F.col("flag1")), F.concat(F.lit("orient2:"), F.col("flag2")),
        F.when(reach <= EPSILON, F.lit("zero_path_length")), F.when(apart < EPSILON, F.lit("coincident_nodes")),
        F.when(F.col("proximity_mean_m").isNull(), F.lit("proximity_path_error")),
    ))
    apex = angle_between(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0"))
    return base.select(
        *KEYS, azimuth_difference(F.col("az1"), F.col("az2")).alias("orientation_diff_deg"), apart.alias("headhead_dist_m"),
        (apart / F.when(reach > EPSILON, reach)).alias("headhead_dist_norm"), apex.alias("apex_angle_deg"),
        F.abs(F.col("order1") - F.col("order2")).cast("double").alias("strahler_order_diff"),
        "proximity_mean_m", "proximity_max_m", "proximity_profile_norm", F.array_join(flags, ",").alias("qc_flags"),
    )
