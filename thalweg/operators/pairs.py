"""Pairs of stream heads that first meet at a confluence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .network import Network, paths

KEYS = ["outlet", "confluence", "head_1", "head_2"]
#: A confluence's heads are joined in blocks of about so many.
HEADS_IN_BLOCK = 1024


def normalise_pair(df: DataFrame, a: str = "head_1", b: str = "head_2") -> DataFrame:
    """The smaller head first; lengths L_1 and L_2, where there are any, change places with their heads."""
    swapped = F.col(a) > F.col(b)
    lengths = {"L_1": F.when(swapped, F.col("L_2")).otherwise(F.col("L_1")), "L_2": F.when(swapped, F.col("L_1")).otherwise(F.col("L_2"))} if {"L_1", "L_2"} <= set(df.columns) else {}
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)} | lengths)


def head_paths(net: Network) -> DataFrame:
    """(basin, head, pos, node, via): each head's way to its outlet; via is the node before, NULL at the head."""
    ways = paths(net.nodes.filter("is_head"), net.edges)
    before = ways.select("basin", "head", (F.col("pos") + 1).alias("pos"), F.col("node").alias("via"))
    return ways.join(before, ["basin", "head", "pos"], "left")


def first_meet_pairs(net: Network, ways: DataFrame | None = None) -> DataFrame:
    """(basin, outlet, confluence, head_1, head_2): heads whose ways come together at a confluence through different branches.

    In a forest this is the pairs' lowest common node downstream. The join pairs heads within a confluence only, on
    equal (basin, node); its size is the result's. The heads of a large confluence are dealt to blocks, each of which
    meets all of them, so none is left to one task. A pair of a head with itself cannot arise.
    """
    ways = head_paths(net) if ways is None else ways
    at = net.nodes.filter("is_confluence").select("basin", F.col("node_id").alias("node"))
    arriving = ways.filter(F.col("via").isNotNull()).join(at, ["basin", "node"], "left_semi").select("basin", "node", "head", "via")
    blocks = arriving.groupBy("basin", "node").agg(F.ceil(F.count(F.lit(1)) / HEADS_IN_BLOCK).cast("int").alias("blocks"))
    arriving = arriving.join(blocks, ["basin", "node"])
    dealt = arriving.select("basin", "node", "head", "via", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int").alias("block"))
    other = arriving.select("basin", "node", F.col("head").alias("head_2"), F.col("via").alias("via_2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = dealt.join(other, ["basin", "node", "block"]).filter("head < head_2 and via <> via_2")
    ends = ways.groupBy("basin", "head").agg(F.max_by("node", "pos").alias("outlet"))
    return pairs.join(ends, ["basin", "head"]).select("basin", "outlet", F.col("node").alias("confluence"), F.col("head").alias("head_1"), "head_2").distinct()


def pairs_by_confluence(pairs: DataFrame) -> DataFrame:
    """(basin, confluence, pairs): the sorted set of pairs at each confluence."""
    return pairs.groupBy("basin", "confluence").agg(F.array_sort(F.collect_set(F.struct("head_1", "head_2"))).alias("pairs"))


def path_to(ways: DataFrame, pairs: DataFrame, head: str = "head_1") -> DataFrame:
    """The nodes from a pair's head to its confluence, both included; no rows where it cannot be reached."""
    keys = ["basin", "outlet", "confluence", "head_1", "head_2"]
    end = ways.select("basin", F.col("head").alias(head), F.col("node").alias("confluence"), F.col("pos").alias("last"))
    return pairs.join(end, ["basin", head, "confluence"]).join(ways.withColumnRenamed("head", head), ["basin", head]).filter("pos <= last").select(*keys, "pos", "node", "last")


def path_gaps(points: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Chebyshev distances between consecutive points (r, c): largest, mean, how many over 1 and their share in percent."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.greatest(F.abs(F.col("r") - F.lag("r").over(w)), F.abs(F.col("c") - F.lag("c").over(w)))
    gaps = points.select(*keys, gap.alias("gap")).filter(F.col("gap").isNotNull())
    over = F.count_if(F.col("gap") > 1)
    return gaps.groupBy(*keys).agg(F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), over.alias("n_over"), (over / F.count(F.lit(1)) * 100).alias("pct_over"))
