import struct
import zlib

import numpy as np
import pytest

from thalweg.sources import files, geotiff


def lzw(data):
    """Codes of a TIFF's LZW, by the published rules: clear first, a width more once the table passes the codes of the one before."""
    table, width, bits, now = {bytes([i]): i for i in range(256)}, 9, "", b""
    size = 258
    put = lambda code: format(code, f"0{width}b")
    bits += put(256)
    for byte in data:
        more = now + bytes([byte])
        if more in table:
            now = more
            continue
        bits += put(table[now])
        table[more], size, now = size, size + 1, bytes([byte])
        if size > (1 << width) - 1 and width < 12:
            width += 1
        elif size > 4094:
            bits += put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
    if now:
        bits += put(table[now])
        if size + 1 > (1 << width) - 1 and width < 12:
            width += 1
    bits += put(257)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def tiff(values, order="<", compression=1, predictor=1, tile=None, strip=None, tags=()):
    rows, cols = values.shape
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    high, wide = tile or (strip or rows, cols)
    blocks = []
    for r in range(0, rows, high):
        for c in range(0, cols, wide):
            block = values[r : r + high, c : c + wide]
            if tile:
                block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1])))
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), dtype=block.dtype))
            raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = np.frombuffer(block.astype(block.dtype.newbyteorder(">")).tobytes(), dtype=np.uint8).reshape(len(block), block.shape[1], -1).transpose(0, 2, 1).reshape(len(block), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(block), 1), dtype=np.uint8)).astype(np.uint8).tobytes()
            blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[compression](raw))
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    own = {256: ("H", [cols]), 257: ("H", [rows]), 258: ("H", [values.dtype.itemsize * 8]), 259: ("H", [compression]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [kind])}
    own |= {322: ("H", [wide]), 323: ("H", [high]), 324: ("I", offsets), 325: ("I", [len(b) for b in blocks])} if tile else {273: ("I", offsets), 278: ("H", [high]), 279: ("I", [len(b) for b in blocks])}
    own |= dict(tags)
    codes, extra, entries = {"H": 3, "I": 4, "d": 12, "s": 2}, b"", b""
    start = at + 2 + 12 * len(own) + 4
    for tag, (form, numbers) in sorted(own.items()):
        raw = numbers if form == "s" else struct.pack(f"{order}{len(numbers)}{form}", *numbers)
        entries += struct.pack(order + "HHI", tag, codes[form], len(numbers))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "I", start + len(extra))
            extra += raw
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + b"".join(blocks) + struct.pack(order + "H", len(own)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize(("dtype", "predictor"), [("f4", 1), ("f4", 3), ("f8", 1), ("i2", 2), ("u1", 1), ("i4", 2)])
@pytest.mark.parametrize("layout", [{}, {"strip": 7}, {"tile": (16, 32)}])
@pytest.mark.parametrize("order", ["<", ">"])
def test_rasters_of_all_kinds(compression, dtype, predictor, layout, order):
    rng = np.random.default_rng(3)
    values = (rng.normal(size=(45, 70)).cumsum(axis=1) * 20).astype(dtype) if dtype != "u1" else rng.integers(0, 9, (45, 70)).astype("u1")
    got = geotiff.decode(tiff(values, order, compression, predictor, **layout))
    assert (got.values == values).all() and got.values.shape == (45, 70) and got.transform is None and got.nodata is None


def test_where_a_raster_lies(spark, tmp_path):
    values = np.array([[1.5, -9.0], [2.5, np.nan]], dtype="f4")
    tags = [(33550, ("d", [30.0, 20.0, 0.0])), (33922, ("d", [1.0, 1.0, 0.0, 500.0, 900.0, 0.0])), (42113, ("s", b"-9\0"))]
    (tmp_path / "one.tif").write_bytes(tiff(values, compression=8, tags=tags))
    (tmp_path / "two.tif").write_bytes(tiff(values, tags=[(34264, ("d", [2.0, 0.0, 0.0, 7.0, 0.0, -2.0, 0.0, 8.0, *[0.0] * 8]))]))
    info = {r["path"].rsplit("/", 1)[1]: r for r in files.raster_info(spark, str(tmp_path)).collect()}
    assert [info["one.tif"][c] for c in ("n_rows", "n_cols", "a", "b", "x0", "d", "e", "y0", "cellsize", "nodata")] == [2, 2, 30.0, 0.0, 470.0, 0.0, -20.0, 920.0, 30.0, -9.0]
    assert [info["two.tif"][c] for c in ("a", "x0", "e", "y0", "cellsize", "nodata")] == [2.0, 7.0, -2.0, 8.0, 2.0, None]
    cells = {(r["path"].rsplit("/", 1)[1], r["r"], r["c"]): r["z"] for r in files.read_rasters(spark, str(tmp_path)).collect()}
    assert cells["one.tif", 0, 0] == 1.5 and cells["one.tif", 0, 1] is None and cells["one.tif", 1, 1] is None and cells["two.tif", 0, 1] == -9.0


def test_files_that_are_not_read():
    for data in (b"XX*\0", b"II*\1" + b"\0" * 20):
        with pytest.raises(ValueError, match="not a TIFF"):
            geotiff.decode(data)
    one = np.zeros((2, 2), dtype="u1")
    with pytest.raises(ValueError, match="single band"):
        geotiff.decode(tiff(one, tags=[(277, ("H", [3]))]))
    with pytest.raises(ValueError, match="compression 7"):
        geotiff.decode(tiff(one, tags=[(259, ("H", [7]))]))
