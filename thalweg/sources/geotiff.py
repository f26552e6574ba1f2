"""Single-band GeoTIFF files: strips or tiles, plain, LZW or Deflate, with predictors, geotransform and nodata value."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: The tags that are read, types of tag values, and compressions.
WIDTH, LENGTH, BITS, COMPRESSION, OFFSETS, BANDS, ROWS_PER_STRIP, COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINTS, TRANSFORMATION, NODATA = 33550, 33922, 34264, 42113
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
ASCII, NONE, LZW, DEFLATE = 2, 1, 5, (8, 32946)
FORMATS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Raster:
    """values (rows x columns), (a, b, x0, d, e, y0) of world = a c + b r + x0, d c + e r + y0, and the nodata value; None where the file has none."""

    values: np.ndarray
    transform: tuple[float, ...] | None
    nodata: float | None

    @property
    def cellsize(self) -> float | None:
        return abs(self.transform[0]) if self.transform else None


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    start, tags = struct.unpack_from(order + "I", data, 4)[0], {}
    for i in range(struct.unpack_from(order + "H", data, start)[0]):
        entry = start + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        form = f"{order}{count}{'s' if kind == ASCII else TYPES.get(kind, '')}"
        if kind != ASCII and kind not in TYPES:
            continue
        at = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        tags[tag] = struct.unpack_from(form, data, at)
    return order, tags


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    clear, end = 256, 257
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, prior, out, held, bits = list(first), 9, None, [], 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == end:
            break
        if code == clear:
            table, width, prior = list(first), 9, None
            continue
        if prior is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else prior + prior[:1]
            table.append(prior + entry[:1])
        out.append(entry)
        prior = entry
        if width < 12 and len(table) >= (1 << width) - 1:
            width += 1
    return b"".join(out)


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == LZW:
        return _lzw(data)
    if compression in DEFLATE:
        return zlib.decompress(data)
    raise ValueError(f"compression {compression} is not read")


def _block(raw: bytes, dtype: np.dtype, rows: int, cols: int, predictor: int) -> np.ndarray:
    """rows x cols values; predictor 2 stores differences along a row, 3 those of the bytes of floats, high bytes first."""
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, dtype=np.uint8, count=rows * cols * dtype.itemsize).reshape(rows, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, dtype.itemsize, cols).transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols)
    values = np.frombuffer(raw, dtype=dtype, count=rows * cols).reshape(rows, cols)
    return np.cumsum(values, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else values


def decode(data: bytes) -> Raster:
    """The raster of a file's content; ValueError for what is not a TIFF, has several bands or an unknown compression."""
    order, tags = _tags(data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if one(BANDS, 1) != 1:
        raise ValueError("only rasters of a single band are read")
    rows, cols = one(LENGTH), one(WIDTH)
    dtype = np.dtype(f"{order}{FORMATS[one(FORMAT, 1)]}{one(BITS) // 8}")
    out = np.empty((rows, cols), dtype=dtype.newbyteorder("="))
    tiled = TILE_OFFSETS in tags
    high, wide = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, rows), rows), cols)
    places = [(r, c) for r in range(0, rows, high) for c in range(0, cols, wide)]
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    for (r, c), at, n in zip(places, offsets, counts, strict=True):
        tall = high if tiled else min(high, rows - r)
        block = _block(_unpacked(data[at : at + n], one(COMPRESSION, NONE)), dtype, tall, wide, one(PREDICTOR, 1))
        out[r : r + tall, c : c + wide] = block[: rows - r, : cols - c]
    return Raster(out, _transform(tags), float(one(NODATA).split(b"\0")[0]) if NODATA in tags else None)


def _transform(tags: dict[int, tuple]) -> tuple[float, ...] | None:
    if TRANSFORMATION in tags:
        m = tags[TRANSFORMATION]
        return m[0], m[1], m[3], m[4], m[5], m[7]
    if PIXEL_SCALE in tags and TIE_POINTS in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINTS][:5]
        return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    return None
