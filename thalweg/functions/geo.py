"""Scalar expressions over columns: units, vectors, angles, path lengths. Undefined results are NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres of a degree of longitude at the equator and of latitude; below EPSILON a length counts as zero.
METERS_PER_DEGREE_LON, METERS_PER_DEGREE_LAT = 111_320.0, 110_540.0
EPSILON = 1e-10


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def meters_per_degree(lat) -> Column:
    """Geometric mean of the lengths of a degree along both axes at a latitude."""
    return F.sqrt(F.lit(METERS_PER_DEGREE_LON) * F.cos(F.radians(F.abs(_c(lat)))) * F.lit(METERS_PER_DEGREE_LAT))


def pixel_size_meters(lat, cellsize) -> Column:
    return _c(cellsize) * meters_per_degree(lat)


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((_c(x2) - _c(x1)) * (_c(x2) - _c(x1)) + (_c(y2) - _c(y1)) * (_c(y2) - _c(y1)))


def angle_between(ax, ay, bx, by) -> Column:
    """Degrees between two vectors; NULL if one is shorter than EPSILON."""
    a, b = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    long = (a >= EPSILON) & (b >= EPSILON)
    cosine = (ax * bx + ay * by) / F.when(long, a * b)
    return F.when(long, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))  # greatest and least pass over NULL


def azimuth(dx, dy) -> Column:
    """Clockwise from north, 0 to 360; NULL for the zero vector."""
    turned = F.degrees(F.atan2(dx, dy))
    return F.when((F.abs(dx) >= EPSILON) | (F.abs(dy) >= EPSILON), F.when(turned < 0, turned + 360.0).otherwise(turned))


def azimuth_difference(a, b) -> Column:
    d = F.abs(a - b)
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def unit_vector(dx, dy) -> Column:
    """Struct (x, y) of length 1; NULL if shorter than EPSILON."""
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n >= EPSILON, F.struct((dx / F.when(n >= EPSILON, n)).alias("x"), (dy / F.when(n >= EPSILON, n)).alias("y")))


def delta_l(a, b) -> Column:
    """Twice the difference of two path lengths over their sum; 0 where both are 0."""
    total = _c(a) + _c(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(2.0) * F.abs(_c(a) - _c(b)), total))


def length_ratio(a, b) -> Column:
    top = F.greatest(a, b)
    return F.when(top > 0, F.try_divide(F.least(a, b), top))


def asymmetry_scale(lat, cellsize) -> Column:
    """Metres for a map unit in path lengths: a degree's where cells are under 1 unit or of unknown size, else 1."""
    return F.when(_c(lat).isNotNull() & (_c(cellsize).isNull() | (_c(cellsize) < 1)), meters_per_degree(lat)).otherwise(F.lit(1.0))


def geometry_scale(lat, cellsize) -> Column:
    """Metres for a pixel in geometry: the pixel's size where a latitude is given, else 1."""
    size = F.when(_c(cellsize) < 1, pixel_size_meters(lat, cellsize)).otherwise(_c(cellsize))
    return F.when(_c(lat).isNotNull() & _c(cellsize).isNotNull(), size).otherwise(F.lit(1.0))


def detect_cellsize(*candidates: Column) -> Column:
    """The first known of: the stream's, the grid's, its resolution, the transform's first coefficient's size."""
    return F.coalesce(*[F.abs(c) for c in candidates])


def rotation_angle(r1, c1, r2, c2, rc, cc) -> Column:
    """Angle that turns the line from a confluence to the middle of two heads upright; 0 where they coincide."""
    dr, dc = (r1 + r2) / 2.0 - rc, (c1 + c2) / 2.0 - cc
    return F.when((F.abs(dr) < 1e-9) & (F.abs(dc) < 1e-9), F.lit(0.0)).otherwise(F.lit(math.pi) - F.atan2(dc, dr))


def rotate(r, c, rc, cc, angle) -> tuple[Column, Column]:
    dr, dc = r - rc, c - cc
    return rc + dr * F.cos(angle) - dc * F.sin(angle), cc + dr * F.sin(angle) + dc * F.cos(angle)


def round_even(x) -> Column:
    """Half to even, to a whole number."""
    return F.rint(x).cast("long")


def line_pixels(r0, c0, r1, c1, interior: bool = False) -> Column:
    """array<struct(i, r, c)>: pixels of the line between two pixels, in closed form; without both ends if interior.

    Along the longer axis every step is a pixel; the other offset is the nearest whole one, halves going up.
    """
    dr, dc = F.abs(r1 - r0), F.abs(c1 - c0)
    major, minor = F.greatest(dr, dc), F.least(dr, dc)
    sr, sc = F.signum((r1 - r0).cast("double")).cast("long"), F.signum((c1 - c0).cast("double")).cast("long")
    first, last = (F.lit(1).cast("long"), major - 1) if interior else (F.lit(0).cast("long"), major)

    def pixel(i):
        off = F.when(major == 0, F.lit(0).cast("long")).otherwise(F.floor((2 * minor * i + major).cast("double") / F.when(major > 0, 2 * major).otherwise(F.lit(1))))
        by_row = dr > dc
        return F.struct(i.alias("i"), (r0 + sr * F.when(by_row, i).otherwise(off)).alias("r"), (c0 + sc * F.when(by_row, off).otherwise(i)).alias("c"))

    empty = F.array().cast("array<bigint>")
    return F.transform(F.when(last >= first, F.sequence(first, last)).otherwise(empty), pixel)


def explode_line(df: DataFrame, keep: list[str], r0, c0, r1, c1, interior: bool = False) -> DataFrame:
    """The columns to keep and r, c of each pixel of a line, a row for each: the same pixels as line_pixels.

    Only the steps are an array; the pixels are column arithmetic, which stays inside generated code.
    """
    lines = df.select(*keep, *[F.col(c).cast("long").alias(f"_{n}") if isinstance(c, str) else c.cast("long").alias(f"_{n}") for n, c in (("r0", r0), ("c0", c0), ("r1", r1), ("c1", c1))])
    dr, dc = F.abs(F.col("_r1") - F.col("_r0")), F.abs(F.col("_c1") - F.col("_c0"))
    lines = lines.withColumns({"_m": F.greatest(dr, dc), "_k": F.least(dr, dc), "_by_row": dr > dc})
    first, last = (F.lit(1).cast("long"), F.col("_m") - 1) if interior else (F.lit(0).cast("long"), F.col("_m"))
    steps = lines.filter(last >= first).withColumn("_i", F.explode(F.sequence(first, last)))
    off = F.expr("CASE WHEN _m = 0 THEN 0L ELSE (2 * _k * _i + _m) div (2 * _m) END")
    sign = lambda a, b: F.when(F.col(a) < F.col(b), 1).when(F.col(a) > F.col(b), -1).otherwise(0)
    r = F.col("_r0") + sign("_r0", "_r1") * F.when(F.col("_by_row"), F.col("_i")).otherwise(off)
    c = F.col("_c0") + sign("_c0", "_c1") * F.when(F.col("_by_row"), off).otherwise(F.col("_i"))
    return steps.select(*keep, r.alias("r"), c.alias("c"))
