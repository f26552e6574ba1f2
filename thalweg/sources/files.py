"""Readers and writers of files: CSV results, elevation rasters, patches, metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from . import geotiff

CELL_SCHEMA = "path string, r long, c long, z double"
#: Rows of a raster that a task hands over at a time.
ROWS = 256


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of pairs under an explicit schema; NaN becomes NULL. FileNotFoundError if there is none."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(path) from e
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def discover_results(spark: SparkSession, root: str, schema: str, name: str = "full_features.csv") -> DataFrame:
    """root/*/name of all basins but experiments; basin comes from the folder where the file has none."""
    df = read_results(spark, f"{root}/*/{name}", schema)
    folder = F.regexp_extract("_metadata.file_path", rf"([^/]+)/{name}$", 1)
    basin = F.coalesce("basin", folder) if "basin" in df.columns else folder
    return df.withColumn("_folder", folder).withColumn("basin", basin).filter("_folder <> 'experiments'").drop("_folder")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_basin(df: DataFrame, path: str, experiment: str | None = None, threshold: int | None = None) -> None:
    """Parquet in a folder for each basin, under experiment and threshold where they are given."""
    keys = {k: v for k, v in (("experiment", experiment), ("stream_threshold", threshold)) if v is not None}
    df.withColumns({k: F.lit(v) for k, v in keys.items()}).write.mode("overwrite").partitionBy(*keys, "basin").parquet(path)


def completed_basins(spark: SparkSession, path: str) -> DataFrame:
    """(basin): those that already have an output; of a path that does not exist yet, none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select(F.col("basin").cast("string").alias("basin")).distinct()
    except AnalysisException:
        return spark.createDataFrame([], "basin string")


def remaining(work: DataFrame, done: DataFrame) -> DataFrame:
    return work.join(done, "basin", "left_anti")


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    """One JSON object as a single row."""
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def list_rasters(spark: SparkSession, folder: str, suffix: str = "_strm_crop") -> DataFrame:
    """(name, path) of the rasters in a folder: lower-cased names without the suffix. Only file names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder).select("path")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tif$", "")
    return files.select(F.lower(F.regexp_replace(stem, f"{suffix}$", "")).alias("name"), "path")


def decode_tiff(data: bytes) -> tuple[int, int, list[float]]:
    """(rows, columns, values) of a single-band TIFF."""
    values = geotiff.decode(data).values
    return *values.shape, values.ravel().tolist()


def _tiffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path", "content")


def read_rasters(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """cells(path, r, c, z) of rasters; NaN and the nodata value, the file's own unless given, become NULL. A file is decoded by one task."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                raster = geotiff.decode(bytes(content))
                missing, cols = raster.nodata if nodata is None else nodata, raster.values.shape[1]
                for r in range(0, len(raster.values), ROWS):
                    z = raster.values[r : r + ROWS].astype(float)
                    z[z == missing] = np.nan
                    yield pd.DataFrame({"path": name, "r": np.repeat(np.arange(r, r + len(z)), cols), "c": np.tile(np.arange(cols), len(z)), "z": z.ravel()})

    return _tiffs(spark, path).mapInPandas(run, CELL_SCHEMA).withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def raster_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_rows, n_cols, a, b, x0, d, e, y0, cellsize, nodata) of rasters, a row for each file; NULL where a file does not say."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rasters = [geotiff.decode(bytes(c)) for c in pdf["content"]]
            out = {"path": pdf["path"], "n_rows": [r.values.shape[0] for r in rasters], "n_cols": [r.values.shape[1] for r in rasters]}
            for k, n in enumerate(("a", "b", "x0", "d", "e", "y0")):
                out[n] = [r.transform[k] if r.transform else None for r in rasters]
            yield pd.DataFrame(out | {"cellsize": [r.cellsize for r in rasters], "nodata": [r.nodata for r in rasters]})

    schema = "path string, n_rows long, n_cols long, a double, b double, x0 double, d double, e double, y0 double, cellsize double, nodata double"
    return _tiffs(spark, path).mapInPandas(run, schema)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, pixels) of square class images in .npy files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            arrays = [np.load(io.BytesIO(bytes(c)), allow_pickle=False) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "size": [a.shape[0] for a in arrays], "pixels": [a.ravel().astype("int8").tolist() for a in arrays]})

    return files.mapInPandas(run, "path string, size int, pixels array<tinyint>")


PATCH_KEYS = "basin string, outlet long, confluence long, head_1 long, head_2 long"


def write_patches(images: DataFrame, folder: str) -> DataFrame:
    """Writes each patch to folder/basin/rasters/outlet_head_head.npy and returns (keys, raster_path) of what was written.

    folder is a path or URI that all executors share. A file is written under another name and renamed, so a task that is
    run again leaves whole files only.
    """

    def run(batches):
        import io
        import os
        import uuid

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        made = set()
        for pdf in batches:
            paths = []
            for r in pdf.itertuples():
                place = f"{r.basin}/rasters"
                if place not in made:
                    store.create_dir(f"{root}/{place}", recursive=True)
                    made.add(place)
                data, name = io.BytesIO(), f"{place}/{r.outlet}_{r.head_1}_{r.head_2}.npy"
                np.save(data, np.asarray(r.pixels, dtype=np.uint8).reshape(r.size_, r.size_))
                part = f"{root}/{place}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data.getvalue())
                store.move(part, f"{root}/{name}")
                paths.append(os.path.join(folder, name))
            yield pdf[["basin", "outlet", "confluence", "head_1", "head_2"]].assign(raster_path=paths)

    rows = images.select("basin", "outlet", "confluence", "head_1", "head_2", F.col("size").alias("size_"), "pixels")
    return materialize(rows.mapInPandas(run, f"{PATCH_KEYS}, raster_path string"))


def patch_manifest(pairs: DataFrame, written: DataFrame) -> DataFrame:
    """Pairs with the raster_path that write_patches gave, NULL where no patch could be made."""
    keys = ["basin", "outlet", "confluence", "head_1", "head_2"]
    return pairs.join(written.select(*keys, "raster_path"), keys, "left")
