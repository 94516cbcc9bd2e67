"""The splittable raster source: what is read, and what is written."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan
from pyspark.sql.types import StructType
from rasterlake.operators import pixels
from rasterlake.sources import raster_files as r
from test_operators import back, raster

CUBE = np.arange(3 * 40 * 7, dtype=">i2").reshape(3, 40, 7)


def as_file(path, interleave):
    order = {"bsq": CUBE, "bil": CUBE.swapaxes(0, 1), "bip": np.moveaxis(CUBE, 0, 2)}[interleave]
    path.write_bytes(b"head" + np.ascontiguousarray(order).tobytes())
    return r.interleaved(str(path), 40, 7, ">i2", ["a", "b", "c"], interleave, 4)


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_read_in_splits(spark, tmp_path, interleave):
    layout = as_file(tmp_path / "raw", interleave)
    p = r.read_raster(spark, layout, split=7 * 2 * 3 * 6)
    assert p.pixels.rdd.getNumPartitions() == 7
    for k, b in enumerate("abc"):
        assert (back(p, b) == CUBE[k]).all()
    one = r.read_raster(spark, layout, ["b"])
    assert one.bands == ["b"] and (back(one, "b") == CUBE[1]).all()
    part = pixels.subset(p, 2, 30, 3, 5)
    assert (back(part, "c") == CUBE[2, 30:35, 2:5]).all()


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_only_the_lines_asked_for_are_read(spark, tmp_path, interleave, monkeypatch):
    layout = as_file(tmp_path / "raw", interleave)
    reader = r.RasterReader(layout, ["y", "x", "b"], 7 * 2 * 4)
    kept = list(reader.pushFilters([GreaterThanOrEqual(("y",), 10), LessThan(("y",), 15), EqualTo(("x",), 3), EqualTo(("b",), 1.0)]))
    assert len(kept) == 4
    assert [(x.first, x.last) for x in reader.partitions()] == [(10, 14), (14, 15)]
    read = []
    whole = r._Files.bytes
    monkeypatch.setattr(r._Files, "bytes", lambda self, path, begin, length: read.append(length) or whole(self, path, begin, length))
    rows = [x for part in reader.partitions() for batch in reader.read(part) for x in batch.to_pylist()]
    assert rows == [{"y": y, "x": 3, "b": float(CUBE[1, y, 3])} for y in range(10, 15)]
    assert sum(read) <= {"bsq": 5 * 14, "bil": 5 * 42, "bip": 5 * 42}[interleave]


def test_filters_reach_the_source(spark, tmp_path):
    p = r.read_raster(spark, as_file(tmp_path / "raw", "bsq"), ["a"], split=7 * 2)
    some = p.pixels.where("y >= 8 and y < 11 and x > 4")
    assert some.rdd.getNumPartitions() == 3
    assert sorted((x["y"], x["x"], x["a"]) for x in some.collect()) == [(y, x, float(CUBE[0, y, x])) for y in (8, 9, 10) for x in (5, 6)]
    assert p.pixels.where("y = 99").collect() == [] and p.pixels.where("x in (1, 2) and x = 6").collect() == []


def test_scaling_and_no_data(spark, tmp_path):
    (tmp_path / "raw").write_bytes(np.array([1, 2, -9, 4], "<i4").tobytes())
    bands = [r.Band("s", [[0, str(tmp_path / "raw")]], "<i4", 4, 8, scale=0.5, offset=1.0, no_data=-9), r.Band("l", [[0, str(tmp_path / "raw")]], "<i4", 4, 8, log10=True)]
    p = r.read_raster(spark, r.Layout(2, 2, bands))
    assert [tuple(x) for x in p.pixels.orderBy("y", "x").collect()] == [(0, 0, 1.5, 10.0), (0, 1, 2.0, 100.0), (1, 0, None, 1e-9), (1, 1, 3.0, 1e4)]


def test_short_file_is_an_error(spark, tmp_path):
    (tmp_path / "raw").write_bytes(bytes(10))
    with pytest.raises(Exception, match="ends before line"):
        r.read_raster(spark, r.interleaved(str(tmp_path / "raw"), 2, 2, "<i4", ["a"])).pixels.collect()


def test_write_and_read_back(spark, tmp_path):
    grid = np.random.default_rng(1).normal(size=(23, 5)).astype("f4").astype(float)
    grid[3, 2] = grid[22, 4] = np.nan
    p = raster(spark, grid)
    p = p.with_bands(n=F.col("y") * 10 + F.col("x"), e=F.when(F.col("x") == 1, 7.4))
    p = p.with_pixels(p.pixels.where("not (y between 8 and 12)"))  # a strip without rows
    path = str(tmp_path / "out")
    r.write_raster(p, path, {"v": "<f4", "n": ">i2", "e": "u1"}, {"n": -1, "e": 255}, lines=4)
    layout = r.read_layout(spark, path)
    assert [len(b.files) for b in layout.bands] == [6, 6, 6]
    q = r.read_raster(spark, layout, split=1)
    assert q.pixels.rdd.getNumPartitions() == 23
    y, x = np.mgrid[:23, :5]
    absent = (y >= 8) & (y <= 12)
    grid[absent] = np.nan
    assert np.allclose(back(q, "v"), grid, equal_nan=True)
    assert np.allclose(back(q, "n"), np.where(absent, np.nan, y * 10 + x), equal_nan=True)
    assert np.allclose(back(q, "e"), np.where(absent | (x != 1), np.nan, 7), equal_nan=True)
    with pytest.raises(Exception, match="beyond its type"):
        r.write_raster(p, str(tmp_path / "other"), {"v": "<f4", "n": "i1", "e": "u1"})
    r.join_strips(spark, layout, {"n": str(tmp_path / "one/n.img")})
    whole = r.read_raster(spark, r.Layout(23, 5, [r.Band("n", [[0, str(tmp_path / "one/n.img")]], ">i2", 2, 10, no_data=-1)]))
    assert np.allclose(back(whole, "n"), back(q, "n"), equal_nan=True)
    assert isinstance(q.pixels.schema, StructType)
