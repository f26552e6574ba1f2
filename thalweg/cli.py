"""Commands: couple (pairs of one raster) and enrich (geometry for a CSV of pairs)."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import coupling, geometry, grid, labels, network, pairs
from .plans.materialize import materialize
from .sources import files

log = logging.getLogger("thalweg")
PAIR_SCHEMA = "basin string, outlet long, confluence long, head_1 long, head_2 long, L_1 double, L_2 double, lat double, z_th double, qc_flags string"


def set_up_logging(verbose: bool) -> None:
    """To standard error, or the file in THALWEG_LOG_FILE; the level from THALWEG_LOG_LEVEL unless verbose."""
    path = os.environ.get("THALWEG_LOG_FILE")
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers = [handler]
    log.setLevel("DEBUG" if verbose else os.environ.get("THALWEG_LOG_LEVEL", "INFO"))


def raster_cells(spark: SparkSession, path: str, mask_below: float | None = None) -> tuple[DataFrame, int]:
    """cells of one raster as basin 'dem', and its number of columns."""
    cells = materialize(files.read_rasters(spark, path))
    ncols = cells.agg(F.max("c")).first()[0] + 1
    named = cells.select(F.lit("dem").alias("basin"), (F.col("r") * ncols + F.col("c")).alias("cell_id"), "r", "c", "z")
    return (grid.mask_below(named, mask_below) if mask_below is not None else named), ncols


def couple(spark: SparkSession, path: str, threshold: int, connectivity: int, mask_below: float | None, outlets: list[int] | None) -> DataFrame:
    cells, ncols = raster_cells(spark, path, mask_below)
    cells = materialize(cells.filter(F.col("z").isNotNull()))
    flow = materialize(grid.flow_directions(cells, ncols))
    net = network.stream_network(cells, flow, threshold)
    found = pairs.first_meet_pairs(net)
    if outlets:
        found = found.filter(F.col("outlet").isin(outlets))
    return coupling.evaluate_coupling(found, net, flow, ncols, coupling.CouplingOptions(connectivity, threshold))


def enrich(df: DataFrame, networks: dict[str, network.Network], direction_m: float = 500.0) -> DataFrame:
    """Pairs with the geometric features of the networks that are known, all basins in one plan; other basins get the flag missing_stream."""
    out = labels.clean_pairs(df)
    known = df.sparkSession.createDataFrame([(b,) for b in networks], "basin string")
    if networks:
        parts = [network.Network(*[t.withColumn("basin", F.lit(basin)) for t in (net.nodes, net.edges)]) for basin, net in networks.items()]
        net = network.Network(*[reduce(DataFrame.unionByName, tables) for tables in ([p.nodes for p in parts], [p.edges for p in parts])])
        rows = out.join(F.broadcast(known), "basin", "left_semi")  # a row for each basin that was asked for
        made = geometry.evaluate_geometry(rows, net, network.strahler_orders(net), rows if "L_1" in out.columns else None, direction_m=direction_m)
        out = labels.update_from(out, made, [*geometry.FEATURES, "qc_flags"])
    return labels.mark_missing_stream(out, known)


def load_networks(names: list[str], loader: Callable[[str], network.Network | None]) -> dict[str, network.Network]:
    """Networks of the basins that a loader finds; one that fails or returns None is logged and left out."""
    found = {}
    for name in names:
        try:
            net = loader(name)
        except Exception:
            log.exception("basin %s could not be loaded", name)
            net = None
        if net is not None:
            found[name] = net
    return found


def enrich_main(argv: list[str] | None = None) -> int:
    """Add geometric features to a CSV of pairs, from rasters <basin>.tif in a folder."""
    parser = argparse.ArgumentParser(prog="thalweg-enrich", description="Geometric features for pairs of stream heads")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--rasters", required=True)
    parser.add_argument("--threshold", type=int, default=300)
    parser.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(argv)
    set_up_logging(args.verbose)
    try:
        spark = SparkSession.builder.getOrCreate()
        rows = files.read_results(spark, args.input, PAIR_SCHEMA)
        names = [r[0] for r in rows.select("basin").dropna().distinct().collect()]

        def loader(name: str) -> network.Network:
            cells, ncols = raster_cells(spark, f"{args.rasters}/{name}.tif")
            cells = materialize(cells.filter(F.col("z").isNotNull()).withColumn("basin", F.lit(name)))
            return network.stream_network(cells, materialize(grid.flow_directions(cells, ncols)), args.threshold)

        files.write_results(enrich(rows, load_networks(names, loader)), args.output)
        return 0
    except Exception:
        log.exception("failed")
        return 1


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: no such raster, or a failure; 2: no pairs."""
    parser = argparse.ArgumentParser(prog="thalweg", description="Coupling of stream heads in a raster")
    parser.add_argument("dem")
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("--threshold", type=int, default=300)
    parser.add_argument("--connectivity", type=int, choices=[4, 8], default=8)
    parser.add_argument("--mask-below", type=float)
    parser.add_argument("--outlets")
    parser.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(argv)
    set_up_logging(args.verbose)
    if "://" not in args.dem and not os.path.exists(args.dem):
        log.error("no such raster: %s", args.dem)
        return 1
    try:
        spark = SparkSession.builder.getOrCreate()
        outlets = [int(x) for x in args.outlets.split(",")] if args.outlets else None
        found = materialize(couple(spark, args.dem, args.threshold, args.connectivity, args.mask_below, outlets))
        n, touching = found.agg(F.count(F.lit(1)), F.count_if("touching")).first()
        if not n:
            log.warning("no pairs")
            return 2
        files.write_results(found, args.output)
        log.info("%d pairs, %d touching (%.1f %%)", n, touching, 100 * touching / n)
        return 0
    except Exception:
        log.exception("failed")
        return 1


if __name__ == "__main__":
    sys.exit(main())
