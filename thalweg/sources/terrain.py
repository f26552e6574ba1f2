"""Terrain tables from embeddings: vectors are rows of an elevation grid, cut into basins of equal height."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import flow_directions
from ..operators.network import Network, stream_network
from ..plans.materialize import materialize

NCOLS, BASIN_ROWS, THRESHOLD = 64, 125, 3


def terrain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(basin, cell_id, r, c, z), read from two columns only; NaN becomes NULL."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("c", "z"))
    r, z = F.pmod("vec_id", F.lit(BASIN_ROWS)), F.col("z").cast("double")
    basin = F.concat(F.lit("b"), F.floor(F.col("vec_id") / BASIN_ROWS).cast("string"))
    return rows.select(basin.alias("basin"), (r * NCOLS + F.col("c")).alias("cell_id"), r.alias("r"), F.col("c").cast("long").alias("c"), F.when(~F.isnan(z), z).alias("z"))


@dataclass(frozen=True)
class Terrain:
    cells: DataFrame
    flow: DataFrame
    net: Network


def terrain(spark: SparkSession, sf_dir: str, threshold: int = THRESHOLD) -> Terrain:
    cells = materialize(terrain_cells(spark, sf_dir))
    flow = materialize(flow_directions(cells, NCOLS))
    return Terrain(cells, flow, stream_network(cells, flow, threshold))
