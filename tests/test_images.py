"""Image files, and sets of products."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.sources import dimap, images, stores
from test_operators import back, raster


def decode(path):
    data = path.read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        size = struct.unpack(">II", part[:8]) if kind == b"IHDR" else size
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], 1 + 3 * size[0])
    assert (lines[:, 0] == 0).all()
    return lines[:, 1:].reshape(size[1], size[0], 3)


@pytest.mark.parametrize("lines", [None, 3])
def test_png(spark, tmp_path, lines):
    grid = np.random.default_rng(1).uniform(-0.2, 1.2, (11, 7))
    grid[3, 4] = np.nan
    p = raster(spark, grid).with_bands(w=F.col("v") / 2, k=F.lit(1.0))
    images.write_png(p, str(tmp_path / "a.png"), "v", "w", "k", 0.0, 1.0, lines)
    byte = lambda a: np.nan_to_num(np.clip(np.floor(a * 256), 0, 255)).astype(np.uint8)
    got = decode(tmp_path / "a.png")
    assert (got == np.stack([byte(grid), byte(grid / 2), np.full(grid.shape, 255)], axis=2)).all()
    assert [f.name for f in tmp_path.iterdir()] == ["a.png"]


def test_product_set(spark, tmp_path):
    a, b = raster(spark, np.ones((2, 3))), raster(spark, np.full((4, 2), 2.0))
    stores.write_product(a, str(tmp_path / "set/first"))
    dimap.write_dimap(b, str(tmp_path / "set/second.dim"))
    (tmp_path / "set/third.asc").write_text("ncols 2\nnrows 1\nxllcorner 0\nyllcorner 0\ncellsize 1\n5 6\n")
    (tmp_path / "set/notes.txt").write_text("x")
    found = images.read_product_set(spark, [str(tmp_path / "set"), str(tmp_path / "set/second.dim")])
    assert [(p.height, p.width) for p in found] == [(2, 3), (4, 2), (1, 2), (4, 2)]
    assert back(found[1]).sum() == 16 and back(found[2]).tolist() == [[5.0, 6.0]]
    rows = images.all_pixels(found).groupBy("product").count().collect()
    assert {r["product"]: r["count"] for r in rows} == {0: 6, 1: 8, 2: 2, 3: 8}
    with pytest.raises(ValueError):
        images.all_pixels([])
