"""Connected components of a graph given by links, on DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links are far fewer than documents: their rounds are written to so many times fewer files.
SHRINK = 8
#: So many links at most (16 MB) are joined by one task; more take rounds over all partitions.
ONE_TASK = 1_000_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node of its component.

    Null ends and self-links are dropped.  Up to ONE_TASK links between longs are joined in one task: rounds are some
    twenty stages of as many tasks as there are partitions, whatever they hold, and the driver remembers each of these.
    """
    edges = checkpoint(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), SHRINK)
    if {t for _, t in edges.dtypes} == {"bigint"} and edges.count() <= ONE_TASK:
        return checkpoint(edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
    return _in_rounds(edges)


def _in_one_task(batches):
    ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if ends:
        nodes, roots = components(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the links (u[i], v[i]), and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        # Of two roots the larger one hangs on the smallest that it meets, then all hang on roots again.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _in_rounds(edges: DataFrame) -> DataFrame:
    """connected_components of distinct links (u, v) with u > v.

    Alternates the large-star and small-star steps, each a minimum over neighbours and a join, until nothing changes;
    every round is checkpointed, so a lost executor never costs more than a round.
    """
    seen = None
    while (now := _fingerprint(edges)) != seen:
        seen = now
        if now[0] == 0:
            break
        edges = checkpoint(_small_star(_large_star(edges)), SHRINK)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select("v", "v").distinct()).distinct()


def _fingerprint(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()
