"""Rasters as long tables: cells(basin, cell_id, r, c, z) with cell_id = r * ncols + c; a masked elevation is NULL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (row offset, column offset) of the neighbours that share an edge, then of those that share a corner.
EDGES, CORNERS = [(-1, 0), (0, -1), (0, 1), (1, 0)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def offsets(connectivity: int) -> list[tuple[int, int]]:
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    return EDGES + CORNERS * (connectivity == 8)


def mask_below(cells: DataFrame, limit) -> DataFrame:
    """Elevations strictly below the limit become NULL."""
    return cells.withColumn("z", F.when(~(F.col("z") < limit), F.col("z")))


def grid_stats(cells: DataFrame) -> DataFrame:
    """Shape, range and share of known elevations of each basin."""
    return cells.groupBy("basin").agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.count("z") / F.count(F.lit(1)) * 100).alias("pct_valid"))


def neighbours(cells: DataFrame, ncols: int, connectivity: int = 8) -> DataFrame:
    """A row for each cell and neighbour place inside the columns, with the place's id: joins on it are equi-joins."""
    places = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets(connectivity)])
    return cells.select("*", F.inline(places)).filter((F.col("c") + F.col("dc")).between(0, ncols - 1)).withColumn("n_id", F.col("cell_id") + F.col("dr") * ncols + F.col("dc"))


def flow_directions(cells: DataFrame, ncols: int) -> DataFrame:
    """flow(basin, cell_id, down_id): each known cell drains to the neighbour with the steepest descent.

    Ties go to the smaller id. Cells without a lower neighbour (pits, flats, edges) are sinks and have no row.
    """
    known = cells.filter(F.col("z").isNotNull())
    lower = known.select("basin", F.col("cell_id").alias("n_id"), F.col("z").alias("n_z"))
    steps = neighbours(known, ncols).join(lower, ["basin", "n_id"]).filter("n_z < z")
    slope = (F.col("z") - F.col("n_z")) / F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))
    return steps.groupBy("basin", "cell_id").agg(F.min(F.struct((-slope).alias("s"), "n_id")).alias("best")).select("basin", "cell_id", F.col("best.n_id").alias("down_id"))


def unravel(cell_id: Column, ncols: int) -> tuple[Column, Column]:
    return F.floor(cell_id / ncols).cast("long"), F.pmod(cell_id, F.lit(ncols)).cast("long")


@dataclass(frozen=True)
class Affine:
    """World = a c + b r + x0, d c + e r + y0."""

    a: float
    b: float
    x0: float
    d: float
    e: float
    y0: float

    def world(self, r: Column, c: Column) -> tuple[Column, Column]:
        return self.a * c + self.b * r + self.x0, self.d * c + self.e * r + self.y0


def padded_box(points: DataFrame, keys: list[str], pad_frac: float = 0.1) -> DataFrame:
    """Bounding box of the points (r, c) of each key, padded by a share of its span."""
    box = points.groupBy(*keys).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    pad = {x: F.greatest((F.col(f"{x}1") - F.col(f"{x}0")) * pad_frac, F.lit(1e-9)) for x in "rc"}
    return box.select(*keys, *[(F.col(f"{x}{k}") + (2 * k - 1) * pad[x]).alias(f"{x}{k}") for x in "rc" for k in (0, 1)])


def crop(cells: DataFrame, boxes: DataFrame, keys: list[str], nrows: int | None = None, ncols: int | None = None) -> DataFrame:
    """Cells inside the boxes of their basin, which are clamped to the extent where it is given.

    The places inside each box are joined with the cells on (basin, r, c): no cell is compared with a box that it is not in.
    """
    low = {x: F.ceil(F.greatest(F.col(f"{x}0"), F.lit(0.0))) for x in "rc"}
    high = {x: F.floor(F.least(F.col(f"{x}1"), F.lit(float(n - 1))) if n else F.col(f"{x}1")) for x, n in (("r", nrows), ("c", ncols))}
    inside = boxes.select(*keys, *[low[x].alias(f"_{x}0") for x in "rc"], *[high[x].alias(f"_{x}1") for x in "rc"]).filter("_r0 <= _r1 and _c0 <= _c1")
    places = inside.withColumn("r", F.explode(F.sequence("_r0", "_r1"))).withColumn("c", F.explode(F.sequence("_c0", "_c1"))).drop("_r0", "_r1", "_c0", "_c1")
    return places.join(cells, ["basin", "r", "c"]).select(*keys, *[c for c in cells.columns if c not in keys])


def subsample(cells: DataFrame, stride: int) -> DataFrame:
    """Every stride-th row and column."""
    return cells.filter((F.col("r") % stride == 0) & (F.col("c") % stride == 0))


def first_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key in an order."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_at") <= k).drop("_at")
