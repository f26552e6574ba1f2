"""Which pairs of heads have upstream areas that touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import explode_line
from ..plans.materialize import materialize
from .grid import offsets
from .network import Network, dependence, head_cells


@dataclass(frozen=True)
class CouplingOptions:
    """connectivity of touching cells, the stream threshold, and how many of its square roots heads may lie apart."""

    connectivity: int = 8
    threshold: int = 300
    prefilter_multiplier: float = 2.0

    def __post_init__(self):
        if self.connectivity not in (4, 8):
            raise ValueError("connectivity must be 4 or 8")
        if self.threshold <= 0 or self.prefilter_multiplier <= 0:
            raise ValueError("threshold and multiplier must be positive")


def with_places(pairs: DataFrame, net: Network, ncols: int | None = None) -> DataFrame:
    """Row and column of both heads: r1, c1, r2, c2. With ncols, a head that is no node is a cell's linear index; without, its pair goes."""
    for k in "12":
        places = net.nodes.select("basin", F.col("node_id").alias(f"head_{k}"), F.col("r").alias(f"r{k}"), F.col("c").alias(f"c{k}"))
        pairs = pairs.join(places, ["basin", f"head_{k}"], "left" if ncols else "inner")
        if ncols:
            cell = {f"r{k}": F.floor(F.col(f"head_{k}") / ncols), f"c{k}": F.pmod(F.col(f"head_{k}"), F.lit(ncols))}
            pairs = pairs.withColumns({x: F.coalesce(x, at) for x, at in cell.items()})
    return pairs


def areas_of(pairs: DataFrame, net: Network, flow: DataFrame) -> DataFrame:
    """(basin, head, cell_id): the cells that drain to each head of the pairs, among them cells that are no heads of the network."""
    named = pairs.select("basin", F.explode(F.array("head_1", "head_2")).alias("cell_id")).distinct()
    heads = net.nodes.filter("is_head").select("basin", F.col("node_id").alias("cell_id"))
    others, areas = materialize(named.join(heads, ["basin", "cell_id"], "left_anti")), head_cells(net, flow)
    if others.isEmpty():
        return areas
    return areas.union(dependence(others, flow).select("basin", F.col("seed").alias("head"), "cell_id"))


def near_enough(options: CouplingOptions):
    dr, dc = F.col("r1") - F.col("r2"), F.col("c1") - F.col("c2")
    return F.sqrt((dr * dr + dc * dc).cast("double")) <= options.prefilter_multiplier * float(options.threshold) ** 0.5


def crossing_pairs(placed: DataFrame, net: Network) -> DataFrame:
    """The pairs whose connecting line has a stream pixel inside: (basin, head_1, head_2)."""
    lines = placed.select("basin", "head_1", "head_2", "r1", "c1", "r2", "c2").distinct()
    inside = explode_line(lines, ["basin", "head_1", "head_2"], "r1", "c1", "r2", "c2", interior=True)
    streams = net.nodes.select("basin", "r", "c").distinct()
    return inside.join(streams, ["basin", "r", "c"], "left_semi").select("basin", "head_1", "head_2").distinct()


def contacts(areas: DataFrame, ncols: int, connectivity: int, pairs: DataFrame) -> DataFrame:
    """(basin, head_1, head_2, n): neighbouring cell pairs, one cell in each head's area; a shared cell is no contact.

    Areas of heads in no pair are left out first. Both joins are on cell ids, so the work follows the areas' borders, not
    the grid's size.
    """
    pairs = pairs.select("basin", "head_1", "head_2").distinct()
    areas = areas.join(pairs.select("basin", F.explode(F.array("head_1", "head_2")).alias("head")).distinct(), ["basin", "head"], "left_semi")
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets(connectivity)])
    around = areas.select("basin", F.col("head").alias("head_1"), "cell_id", F.inline(steps)).filter((F.pmod(F.col("cell_id"), F.lit(ncols)) + F.col("dc")).between(0, ncols - 1))
    around = around.select("basin", "head_1", (F.col("cell_id") + F.col("dr") * ncols + F.col("dc")).alias("cell_id"))
    met = around.join(areas.select("basin", "cell_id", F.col("head").alias("head_2")), ["basin", "cell_id"]).filter("head_1 < head_2")
    return met.join(pairs, ["basin", "head_1", "head_2"], "left_semi").groupBy("basin", "head_1", "head_2").agg(F.count(F.lit(1)).alias("n"))


def evaluate_coupling(pairs: DataFrame, net: Network, flow: DataFrame, ncols: int, options: CouplingOptions | None = None, prefilter: bool = True, stream_filter: bool = True, areas: DataFrame | None = None) -> DataFrame:
    """basin, outlet, confluence, head_1, head_2, touching, contact_px, size1_px, size2_px, skipped_prefilter.

    A pair whose line crosses a stream is left out; one whose heads lie too far apart stays, untouching and with NULL
    sizes. Either gate can be switched off. The gates come before the join of areas. A head that is no node of the network
    is a cell's linear index.
    """
    options = options or CouplingOptions()
    placed = with_places(pairs, net, ncols)
    if stream_filter:
        placed = placed.join(crossing_pairs(placed, net), ["basin", "head_1", "head_2"], "left_anti")
    judged = placed.withColumn("skipped_prefilter", ~near_enough(options) if prefilter else F.lit(False))
    areas = areas_of(pairs, net, flow) if areas is None else areas
    touch = contacts(areas, ncols, options.connectivity, judged.filter("not skipped_prefilter"))
    size = areas.groupBy("basin", "head").agg(F.count(F.lit(1)).alias("size"))
    out = judged.join(touch, ["basin", "head_1", "head_2"], "left")
    for k in "12":
        out = out.join(size.toDF("basin", f"head_{k}", f"size{k}"), ["basin", f"head_{k}"], "left")
    known = ~F.col("skipped_prefilter")
    return out.select("basin", "outlet", "confluence", "head_1", "head_2", (known & (F.coalesce("n", F.lit(0)) > 0)).alias("touching"), F.when(known, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("contact_px"), *[F.when(known, F.col(f"size{k}")).alias(f"size{k}_px") for k in "12"], "skipped_prefilter")
