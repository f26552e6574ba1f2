"""Path lengths from both heads of a pair to their confluence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import delta_l
from .network import Network, upstream_distance


def evaluate_asymmetry(pairs: DataFrame, net: Network, scale: float = 1.0, distances: DataFrame | None = None) -> DataFrame:
    """basin, outlet, confluence, head_1, head_2, L_1, L_2, delta_L, distance_unit; pairs with unknown nodes are left out."""
    far = upstream_distance(net) if distances is None else distances
    end = far.select("basin", F.col("node_id").alias("confluence"), F.col("up_dist").alias("d0"))
    out = pairs.join(end, ["basin", "confluence"])
    for k in "12":
        out = out.join(far.toDF("basin", f"head_{k}", f"d{k}"), ["basin", f"head_{k}"])
    length = [F.greatest(F.lit(0.0), F.col(f"d{k}") - F.col("d0")) * scale for k in "12"]
    out = out.select("basin", "outlet", "confluence", "head_1", "head_2", length[0].alias("L_1"), length[1].alias("L_2"))
    return out.select("*", delta_l(F.col("L_1"), F.col("L_2")).alias("delta_L"), F.lit("meters").alias("distance_unit"))
