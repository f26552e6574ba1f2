"""Flow forests and stream networks, by pointer doubling: log2(depth) joins on (basin, node), never a full closure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize


@dataclass(frozen=True)
class Network:
    """nodes(basin, node_id, r, c, is_head, is_confluence, is_outlet), edges(basin, u, v) from upstream to downstream."""

    nodes: DataFrame
    edges: DataFrame


def _jumps(links: DataFrame) -> DataFrame:
    """basin, upstream end and downstream end, whatever the two are called."""
    ends = [c for c in links.columns if c != "basin"]
    return links.select("basin", *ends).toDF("basin", "u", "v")


def doubled(links: DataFrame):
    """Yield (k, jumps(basin, u, v)) with v the node 2**k steps downstream of u, while there are any.

    A cycle would double without end; no path is longer than the number of links, which bounds the rounds.
    """
    jumps, k, left = materialize(_jumps(links)), 0, None
    while jumps.limit(1).count():
        yield k, jumps
        left = left or max(1, jumps.count())
        k += 1
        if 2**k > 2 * left:
            raise ValueError("the links hold a cycle")
        jumps = materialize(jumps.join(jumps.toDF("basin", "v", "w"), ["basin", "v"]).select("basin", "u", F.col("w").alias("v")))


def contributing_area(cells: DataFrame, flow: DataFrame) -> DataFrame:
    """(basin, cell_id, area): how many cells drain to each cell, itself included.

    After round k every cell counts those less than 2**k steps upstream, so a round adds the counts of the cells exactly
    2**k steps upstream.
    """
    area = cells.select("basin", F.col("cell_id").alias("v"), F.lit(1).cast("long").alias("area"))
    for _, jumps in doubled(flow):
        gained = jumps.join(area.toDF("basin", "u", "more"), ["basin", "u"]).groupBy("basin", "v").agg(F.sum("more").alias("more"))
        area = materialize(area.join(gained, ["basin", "v"], "left").select("basin", "v", (F.col("area") + F.coalesce("more", F.lit(0))).alias("area")))
    return area.withColumnRenamed("v", "cell_id")


def stream_network(cells: DataFrame, flow: DataFrame, threshold: int) -> Network:
    """Cells with a contributing area from the threshold on, and the flow between them."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    wet = materialize(contributing_area(cells, flow).filter(F.col("area") >= threshold).select("basin", F.col("cell_id").alias("node_id")))
    edges = flow.join(wet.withColumnRenamed("node_id", "cell_id"), ["basin", "cell_id"], "left_semi").select("basin", F.col("cell_id").alias("u"), F.col("down_id").alias("v"))
    return network(wet.join(cells.select("basin", F.col("cell_id").alias("node_id"), "r", "c"), ["basin", "node_id"]), edges)


def network(nodes: DataFrame, edges: DataFrame) -> Network:
    """Nodes with their roles: heads have nothing upstream, confluences two nodes or more, outlets nothing downstream.

    Self-loops and repeated edges are dropped.
    """
    edges = materialize(edges.select("basin", "u", "v").filter("u <> v").distinct())
    up = edges.groupBy("basin", F.col("v").alias("node_id")).agg(F.count(F.lit(1)).alias("_up"))
    down = edges.select("basin", F.col("u").alias("node_id"), F.lit(True).alias("_down")).distinct()
    known = nodes.select("basin", "node_id", "r", "c").join(up, ["basin", "node_id"], "left").join(down, ["basin", "node_id"], "left")
    roles = known.select("basin", "node_id", "r", "c", F.col("_up").isNull().alias("is_head"), F.coalesce(F.col("_up") >= 2, F.lit(False)).alias("is_confluence"), F.col("_down").isNull().alias("is_outlet"))
    return Network(materialize(roles), edges)


def validate(net: Network) -> None:
    """IndexError if an edge ends outside the nodes."""
    ends = net.edges.select("basin", F.explode(F.array("u", "v")).alias("node_id"))
    if ends.join(net.nodes, ["basin", "node_id"], "left_anti").limit(1).count():
        raise IndexError("an edge leads to a node that does not exist")


def outlet_of(net: Network) -> DataFrame:
    """(basin, node_id, outlet) for each node: where its flow ends."""
    return net_roots(net.nodes.select("basin", "node_id"), net.edges)


def net_roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(basin, node_id, outlet): the end of each node's way, by squaring the map from a node to the next one.

    Ends map to themselves, so after k rounds every node knows the one 2**k steps on, or its end.
    """
    links = _jumps(links)
    at = nodes.select("basin", "node_id").join(links.toDF("basin", "node_id", "next"), ["basin", "node_id"], "left").select("basin", "node_id", F.coalesce("next", "node_id").alias("outlet"))
    at, rounds, size = materialize(at), 0, None
    while True:
        ahead = at.select("basin", F.col("node_id").alias("outlet"), F.col("outlet").alias("end"))
        both = at.join(ahead, ["basin", "outlet"], "left").select("basin", "node_id", F.coalesce("end", "outlet").alias("end"), "outlet")
        at = materialize(both.select("basin", "node_id", F.col("end").alias("outlet"), (F.col("end") != F.col("outlet")).alias("moved")))
        moved, at = at.filter("moved").limit(1).count(), at.drop("moved")
        if not moved:
            return at
        rounds += 1
        size = size or at.count()
        if 2**rounds > 2 * size:
            raise ValueError("the links hold a cycle")


def paths(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(basin, head, pos, node): every start's way downstream, itself at position 0.

    Round k shifts the rows known so far by 2**k steps, so a path of n nodes takes log2(n) joins.
    """
    rows = materialize(starts.select("basin", F.col("node_id").alias("head"), F.lit(0).alias("pos"), F.col("node_id").alias("node")))
    for k, jumps in doubled(links):
        further = rows.join(jumps.toDF("basin", "node", "next"), ["basin", "node"]).select("basin", "head", (F.col("pos") + 2**k).alias("pos"), F.col("next").alias("node"))
        rows = materialize(rows.union(further))
    return rows


def upstream_distance(net: Network, scale: float = 1.0) -> DataFrame:
    """(basin, node_id, up_dist): the length of the way from each node down to its outlet, in map units."""
    place = net.nodes.select("basin", "node_id", "r", "c")
    ends = net.edges.join(place.toDF("basin", "u", "ru", "cu"), ["basin", "u"]).join(place.toDF("basin", "v", "rv", "cv"), ["basin", "v"])
    length = F.sqrt(((F.col("ru") - F.col("rv")) * (F.col("ru") - F.col("rv")) + (F.col("cu") - F.col("cv")) * (F.col("cu") - F.col("cv"))).cast("double")) * scale
    jumps = materialize(ends.select("basin", "u", "v", length.alias("d")))
    # dist(u) sums the lengths of 2**k steps; nodes whose way is shorter hold all of it.
    whole = net.nodes.join(jumps.select("basin", F.col("u").alias("node_id"), "v", "d"), ["basin", "node_id"], "left").select("basin", "node_id", "v", F.coalesce("d", F.lit(0.0)).alias("d"))
    whole = materialize(whole)
    while whole.filter(F.col("v").isNotNull()).limit(1).count():
        ahead = whole.toDF("basin", "v", "w", "more")
        whole = materialize(whole.join(ahead, ["basin", "v"], "left").select("basin", "node_id", F.col("w").alias("v"), (F.col("d") + F.coalesce("more", F.lit(0.0))).alias("d")))
    return whole.select("basin", "node_id", F.col("d").alias("up_dist"))


def strahler_orders(net: Network) -> DataFrame:
    """(basin, node_id, strahler): 1 at heads; below, the largest order upstream, and one more where it meets itself.

    A node is of order k + 1 or more if it is, or lies below, a node that two nodes or more of order k or more lead to.
    So each order takes one closure downstream, of log2(depth) joins; rounds are as many as there are orders, about a
    dozen in the largest networks, however long the ways are.
    """
    jumps = [j.toDF("basin", "node_id", "next") for _, j in doubled(net.edges)]
    found, above = [net.nodes.select("basin", "node_id", F.lit(1).alias("strahler"))], net.edges
    while True:
        met = above.groupBy("basin", F.col("v").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("basin", "node_id")
        for jump in jumps:
            met = met.union(met.join(jump, ["basin", "node_id"]).select("basin", F.col("next").alias("node_id")))
        met = materialize(met.distinct())
        if met.isEmpty():
            break
        found.append(met.select("basin", "node_id", F.lit(len(found) + 1).alias("strahler")))
        above = net.edges.join(met.withColumnRenamed("node_id", "u"), ["basin", "u"], "left_semi")
    orders = found[0]
    for part in found[1:]:
        orders = orders.union(part)
    return orders.groupBy("basin", "node_id").agg(F.max("strahler").alias("strahler"))


def head_cells(net: Network, flow: DataFrame) -> DataFrame:
    """(basin, head, cell_id): all cells that drain to each head, itself included; in a forest every cell has one at most."""
    heads = net.nodes.filter("is_head").select("basin", F.col("node_id").alias("cell_id"))
    above = flow.join(heads, ["basin", "cell_id"], "left_anti").select("basin", "cell_id", "down_id")  # cut below each head
    cells = above.select("basin", F.col("cell_id").alias("node_id")).union(heads.select("basin", "cell_id"))
    ends = net_roots(cells.distinct(), above)
    return ends.join(heads.withColumnRenamed("cell_id", "outlet"), ["basin", "outlet"], "left_semi").select("basin", F.col("outlet").alias("head"), F.col("node_id").alias("cell_id"))


def dependence(seeds: DataFrame, flow: DataFrame) -> DataFrame:
    """(basin, seed, cell_id): all cells that drain to each seed, itself included; seeds may lie on each other's way."""
    rows = materialize(seeds.select("basin", F.col("cell_id").alias("seed"), "cell_id"))
    for _, jumps in doubled(flow):
        rows = materialize(rows.union(rows.join(jumps.toDF("basin", "above", "cell_id"), ["basin", "cell_id"]).select("basin", "seed", F.col("above").alias("cell_id"))))
    return rows


def upstream_network(net: Network, seeds: DataFrame) -> Network:
    """The part of a network that drains to any of the seeds (basin, node_id), seeds included."""
    kept = dependence(seeds.select("basin", F.col("node_id").alias("cell_id")), net.edges).select("basin", F.col("cell_id").alias("node_id")).distinct()
    kept = materialize(kept)
    ends = [kept.toDF("basin", x) for x in "uv"]
    return network(net.nodes.join(kept, ["basin", "node_id"], "left_semi"), net.edges.join(ends[0], ["basin", "u"], "left_semi").join(ends[1], ["basin", "v"], "left_semi"))


def heads_per_confluence(net: Network, ways: DataFrame) -> DataFrame:
    """(basin, confluence, n_heads, heads): the heads above each confluence."""
    at = net.nodes.filter("is_confluence").select("basin", F.col("node_id").alias("node"))
    found = ways.join(at, ["basin", "node"], "left_semi").filter("head <> node")
    return found.groupBy("basin", F.col("node").alias("confluence")).agg(F.count(F.lit(1)).alias("n_heads"), F.array_sort(F.collect_list("head")).alias("heads"))


def reachable(net: Network, pairs: DataFrame) -> DataFrame:
    """The pairs (basin, start, target) whose target lies on the start's way downstream; a node reaches itself."""
    ways = paths(pairs.select("basin", F.col("start").alias("node_id")).distinct(), net.edges)
    return pairs.join(ways.select("basin", F.col("head").alias("start"), F.col("node").alias("target")), ["basin", "start", "target"], "left_semi")


def outlet_view(net: Network, outlets: DataFrame) -> DataFrame:
    """Edges (basin, outlet, u, v) of the networks of some outlets (basin, outlet), as a plan of them would show."""
    roots = outlet_of(net).select("basin", F.col("node_id").alias("u"), "outlet")
    return net.edges.join(roots, ["basin", "u"]).join(outlets, ["basin", "outlet"], "left_semi").select("basin", "outlet", "u", "v")
