"""Study areas: published reference values, names of local rasters, and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, as published: basin, latitude, elevation threshold (m), median lengthwise asymmetry, number of pairs.
BASINS = [
    ("taiwan", 23.47, 80.0, 1.16, 57010),
    ("clanalpine", 39.69, 1700.0, 0.27, 1547),
    ("daqing", 40.71, 1200.0, 0.82, 1961),
    ("finisterre", -5.95, 400.0, 0.93, 31675),
    ("humboldt", 40.52, 1450.0, 0.34, 2313),
    ("inyo", 36.71, 1200.0, 0.17, 2419),
    ("kammanassie", -33.62, 630.0, 0.35, 2858),
    ("luliang", 39.27, 1100.0, 0.46, 5685),
    ("panamint", 36.17, 800.0, 0.40, 6852),
    ("sakhalin", 47.07, 60.0, 0.56, 5774),
    ("vallefertil", -30.44, 1050.0, 0.90, 6415),
    ("sierramadre", 17.52, 380.0, 1.01, 17271),
    ("sierranevada_spain", 37.05, 1200.0, 0.19, 6046),
    ("piedepalo", -31.32, 650.0, 0.17, 9731),
    ("toano", 40.50, 1710.0, 0.18, 3721),
    ("troodos", 34.94, 200.0, 0.84, 18104),
    ("tsugaru", 40.97, 30.0, 0.53, 2343),
    ("yoro", 35.28, 130.0, 1.38, 726),
]
# Local raster names that are spelled in another way than the basin.
ALIASES = {"calnalpine": "clanalpine", "kammanasie": "kammanassie", "sierranevadaspain": "sierranevada_spain"}
SCHEMA = "name string, lat double, z_th double, delta_L double, num_pairs int"


def basin_config(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The basins' values; with a path, a CSV with a header that has these columns and any others."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path else spark.createDataFrame(BASINS, SCHEMA)


def lookup(name: str) -> dict:
    """One basin's values by its name or a local raster's, whatever the case; KeyError names the basins there are."""
    key = ALIASES.get(name.lower(), name.lower())
    for row in BASINS:
        if row[0] == key:
            return dict(zip(("name", "lat", "z_th", "delta_L", "num_pairs"), row, strict=True))
    raise KeyError(f"unknown basin {name!r}; known: {', '.join(sorted(r[0] for r in BASINS))}")


def with_config(df: DataFrame, column: str = "basin") -> DataFrame:
    """df with the values of its basins; NULL for basins that are not known. The table has 18 rows."""
    spark = df.sparkSession
    alias = spark.createDataFrame(list(ALIASES.items()), "_alias string, _name string")
    named = df.join(F.broadcast(alias), F.lower(column) == F.col("_alias"), "left").withColumn("_key", F.coalesce("_name", F.lower(column))).drop("_alias", "_name")
    return named.join(F.broadcast(basin_config(spark).withColumnRenamed("name", "_key")), "_key", "left").drop("_key")


def output_folder(root: str, area: str, experiment: str | None = None, threshold: int | None = None) -> str:
    """root/area, and below it experiment, th<threshold>, or both joined by an underscore."""
    parts = [p for p in (experiment, f"th{threshold}" if threshold else None) if p]
    return "/".join([root, area, *["_".join(parts)] * bool(parts)])


def resolve_raster(reference: str, folder: str, known: dict[str, str], exists) -> str:
    """A raster's path: a known name (whatever the case, unchecked), a path as it is, under the folder, or by file name."""
    if reference.lower() in known:
        return known[reference.lower()]
    for path in (reference, f"{folder}/{reference}", f"{folder}/{reference.rpartition('/')[2]}"):
        if exists(path):
            return path
    raise FileNotFoundError(reference)
