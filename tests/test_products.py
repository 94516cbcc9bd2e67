"""Product subsets with references and grids, replaced metadata, sums over tall rasters, discarded tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake import session
from rasterlake.operators import neighbourhood, products
from rasterlake.operators import tie_points as tp
from test_operators import back, raster


def scene(spark):
    y, x = np.mgrid[:20, :30]
    p = raster(spark, (100.0 * y + x))
    p = p.with_bands(a=F.col("v") + 1, b=F.col("v") + 2, lat=50 - F.col("y") * 0.1, lon=10 + F.col("x") * 0.1)
    meta = {"type": "T", "bands": [{"name": "w", "expression": "a * 2 + w2", "valid": None}, {"name": "w2", "expression": "flags.x ? b : 0", "valid": "inc > 3"}, {"name": "v", "valid": "lat > 3"}], "metadata": {"Abstracted_Metadata": {"polsarData": "1", "n": "1"}}}
    grids = {n: tp.tie_points(spark, (np.arange(12.0).reshape(3, 4) + k).tolist(), (0.5, 0.5), (10.0, 10.0)) for k, n in enumerate(("inc", "other"))}
    return p.with_pixels(p.pixels, meta=meta), grids


def test_subset_keeps_what_is_referred_to(spark):
    p, grids = scene(spark)
    q, parts = products.product_subset(p, grids, (4, 2, 10, 8), (2, 1), ["w"], [])
    assert q.bands == ["a", "b"] and set(parts) == {"inc"} and [b["name"] for b in q.meta["bands"]] == ["w", "w2"]
    assert (q.height, q.width) == (8, 5) and "metadata" not in q.meta
    assert (back(q, "a") == (100 * (2 + np.arange(8))[:, None] + 4 + 2 * np.arange(5)[None, :] + 1)).all()
    df = spark.createDataFrame([(2.5, 3.5)], "px double, py double")
    old = tp.bilinear_at(grids["inc"], df, F.lit(4 + 2 * 2 + 0.5), F.lit(2 + 3.5), "v").first()["v"]
    assert tp.bilinear_at(parts["inc"], df, F.col("px"), F.col("py"), "v").first()["v"] == pytest.approx(old)
    q, parts = products.product_subset(p, grids, copy_metadata=True)
    assert set(q.bands) == {"v", "a", "b", "lat", "lon"} and set(parts) == {"inc", "other"} and "metadata" in q.meta


def test_subset_by_geometry(spark):
    p, _ = scene(spark)
    q, _ = products.product_subset(p, region="POLYGON((10.55 49.55, 11.25 49.55, 11.25 48.85, 10.55 48.85, 10.55 49.55))", bands=["v"])
    assert (q.height, q.width) == (7, 7) and back(q, "v")[0, 0] == 506
    q, _ = products.product_subset(p, region="POLYGON((10.55 49.55, 11.25 49.55, 11.25 48.85, 10.55 48.85, 10.55 49.55))", bands=["a"], full_swath=True)
    assert (q.height, q.width) == (7, 30)
    for region in ("POLYGON((0 0, 1 0, 1 1, 0 0))", (100, 0, 5, 5)):
        with pytest.raises(ValueError, match="doesn't meet"):
            products.product_subset(p, region=region)
    with pytest.raises(ValueError, match="no"):
        products.product_subset(p, bands=["none"])


def test_replace_metadata(spark):
    p, _ = scene(spark)
    other = p.with_pixels(p.pixels, meta={"type": "U", "start": "s", "metadata": {"Abstracted_Metadata": {"polsarData": "0", "mds1_tx_rx_polar": "HH", "k": "2"}}})
    q = products.replace_metadata(p, other)
    assert q.meta["type"] == "U" and q.meta["bands"] == p.meta["bands"] and q.bands == p.bands
    assert q.meta["metadata"]["Abstracted_Metadata"] == {"polsarData": "1", "mds1_tx_rx_polar": " ", "mds2_tx_rx_polar": " ", "mds3_tx_rx_polar": " ", "mds4_tx_rx_polar": " ", "k": "2"}
    assert other.meta["metadata"]["Abstracted_Metadata"]["mds1_tx_rx_polar"] == "HH"


@pytest.mark.parametrize("edge", [True, False])
def test_sums_over_bands_of_lines(spark, edge, monkeypatch):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(41, 6))
    grid[7, 2] = grid[40, 0] = np.nan
    p = raster(spark, grid)
    values = {"s": (F.col("v"), 2), "t": (F.col("v"), 1)}
    rows = lambda: sorted((r["y"], r["x"], round(r["s"], 9), round(r["t"], 9)) for r in neighbourhood.box_sums(p, values, edge).collect())
    whole = rows()
    monkeypatch.setattr(neighbourhood, "BAND", 8)
    assert rows() == whole and len(whole) == 41 * 6


def test_discard(spark):
    df = session.materialize(spark.range(5).toDF("a"), "some")
    path = session._KEPT[df].removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 5
    session.discard(df)
    session.discard(df)
    session.discard(spark.range(3))
    assert not os.path.exists(path)
