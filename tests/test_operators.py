"""Operators that SQL cannot express, against plain numpy, and small cases of the others."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.functions import band_math as m
from rasterlake.operators import clusters, geometry, joins, neighbourhood, pixels, statistics
from rasterlake.product import from_arrays, product
from rasterlake.sources import stores


def raster(spark, grid, band="v"):
    yy, xx = np.mgrid[: grid.shape[0], : grid.shape[1]]
    rows = [(int(y), int(x), None if np.isnan(v) else float(v)) for y, x, v in zip(yy.ravel(), xx.ravel(), grid.ravel(), strict=True)]
    return product(spark.createDataFrame(rows, f"y long, x long, {band} double"), *grid.shape)


def back(p, band="v"):
    out = np.full((p.height, p.width), np.nan)
    for r in p.pixels.collect():
        out[r["y"], r["x"]] = np.nan if r[band] is None else r[band]
    return out


RAMP = np.arange(1.0, 17.0).reshape(4, 4)


def test_summary_of_the_ramp(spark):
    s = statistics.summary(raster(spark, RAMP), "v").first()
    assert (s["lo"], s["hi"], s["mean"], s["n"]) == (1.0, 16.0, 8.5, 16)
    assert s["sd_pop"] == pytest.approx(4.6097722286464435)


def test_division_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (7.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(m.div(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [np.inf, -np.inf] and np.isnan(got[2]) and got[3] == 3.5
    nan = spark.createDataFrame([(float("nan"),)], "a double")
    assert list(nan.select(m.gt(F.col("a"), 1), m.eq(F.col("a"), F.col("a")), m.ne(F.col("a"), 1), m.inrange([F.col("a")], [0], [1]), m.to_int(F.col("a")) == 0).first()) == [False, False, True, True, True]
    big = spark.createDataFrame([(1e20, -1e20, 2147483647, -2.5)], "a double, b double, i int, c double")
    assert list(big.select(m.to_int(F.col("a")), m.to_int(F.col("b")), m.int_add(F.col("i"), F.lit(1)), m.round_half_up(F.col("c"))).first()) == [2147483647, -2147483648, -2147483648, -2.0]


@pytest.mark.parametrize("shape", [(5, 7), (20, 9)])
def test_tiles_have_no_seams(spark, shape):
    grid = np.random.default_rng(0).random(shape)
    for tile in (4, 64):
        got = back(neighbourhood.tiled(raster(spark, grid), "v", 1, lambda g: neighbourhood.RANKS["median"](neighbourhood._views(g, 1)), tile))
        assert np.allclose(got, np.median(neighbourhood._views(np.pad(grid, 1, mode="edge"), 1), axis=2))


def test_box_mean_repeats_edges(spark):
    got = back(neighbourhood.box_mean(raster(spark, RAMP), "v", 2))
    assert np.allclose(got, neighbourhood._views(np.pad(RAMP, 2, mode="edge"), 2).mean(axis=2))


# Known results for the ramp and a 7x7 amplitude image.
MEAN = [2.6666667, 3.3333333, 4.3333335, 5.0, 5.3333335, 6.0, 7.0, 7.6666667, 9.333333, 10.0, 11.0, 11.666667, 12.0, 12.666667, 13.666667, 14.333333]
MEDIAN = [2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13, 14, 15]
FROST = [2.3268945, 3.1592662, 4.2424283, 4.956943, 5.289399, 6.0, 7.0, 7.684779, 9.321723, 10.0, 11.0, 11.673815, 12.006711, 12.675643, 13.674353, 14.34112]
AMPLITUDES = [
    [99, 105, 124, 138, 128, 34, 62], [105, 91, 140, 98, 114, 63, 31], [107, 94, 128, 138, 96, 61, 82], [137, 129, 136, 105, 100, 55, 85],
    [144, 145, 113, 132, 119, 39, 50], [102, 97, 102, 110, 103, 34, 53], [107, 146, 115, 123, 101, 76, 56],
]
REFINED_LEE = [
    [117.125, 115.6, 108.98584, 115.59759, 111.30918, 67.772064, 77.42791], [120.4, 115.62569, 107.23333, 99.46982, 102.80414, 83.69684, 79.332756],
    [117.458336, 115.96667, 106.94328, 122.64238, 95.61863, 80.35871, 83.98103], [118.21429, 116.314285, 108.13215, 103.94042, 97.82989, 76.39517, 85.19781],
    [118.5, 116.052475, 105.69444, 118.22289, 103.49728, 76.28018, 81.13954], [120.008255, 114.69612, 106.46667, 106.02027, 98.75016, 78.02842, 85.9],
    [121.4375, 119.85731, 107.083336, 106.53835, 97.693275, 88.09068, 83.8125],
]


def test_speckle_filters_of_the_ramp(spark):
    p = raster(spark, RAMP)
    enl = statistics.looks(p, "v", intensity=False).first()["enl"]
    for out, wanted in (
        (neighbourhood.box_mean(p, "v"), MEAN), (neighbourhood.rank_filter(p, "v", "median"), MEDIAN), (neighbourhood.frost(p, "v"), FROST),
        (neighbourhood.lee(p, "v", 1, enl), MEAN), (neighbourhood.gamma_map(p, "v", 1, enl), MEAN),
    ):
        assert np.allclose(back(out).ravel(), wanted, rtol=1e-6)


def test_refined_lee(spark):
    got = back(neighbourhood.refined_lee(raster(spark, np.array(AMPLITUDES, float)), "v"))
    assert np.allclose(got, REFINED_LEE, rtol=1e-6)


def test_refined_lee_at_an_edge(spark):
    rng = np.random.default_rng(3)
    clean = np.where(np.arange(20)[None, :] < 10, 100.0, 900.0) * np.ones((20, 1))
    noisy = clean * rng.gamma(16, 1 / 16, clean.shape)
    got = back(neighbourhood.refined_lee(raster(spark, noisy), "v"))
    inner = (slice(4, -4), slice(7, 13))
    assert np.abs(got - clean)[inner].mean() < 0.8 * np.abs(noisy - clean)[inner].mean()


def test_oversample_keeps_samples(spark):
    grid = np.random.default_rng(1).random((8, 6))
    assert np.allclose(back(neighbourhood.oversample(raster(spark, grid), "v"))[::2, ::2], grid)


def test_fill_holes(spark):
    grid = RAMP.copy()
    grid[1, 1] = np.nan
    assert back(neighbourhood.fill_holes(raster(spark, grid), "v"))[1, 1] == pytest.approx(6.0)


def test_resampling_grid(spark):
    grid = np.array([[10, 20, 30, 40, 50], [30, 20, 30, 20, 30], [10, 40, 20, 30, 70], [20, 30, 40, 60, 80], [10, 40, 10, 90, 70]], float)
    p = raster(spark, grid)
    at = lambda u, v, how: joins.resample(p, spark.createDataFrame([(0, 0)], "y long, x long"), F.lit(u), F.lit(v), "v", how).first()["v"]
    assert at(2.5, 2.5, "nearest") == at(2.5, 2.5, "bilinear") == at(2.5, 2.5, "cubic") == 20
    assert at(2.0, 2.5, "bilinear") == 30 and at(0.1, 0.1, "bilinear") == 10
    assert at(2.5, 2.5, "bicubic") == 20 and at(2.5, 2.5, "sinc") == pytest.approx(20)
    assert at(2.2, 1.7, "bicubic") == pytest.approx(at(2.2, 1.7, "cubic")) and at(0.1, 0.1, "bicubic") != at(0.1, 0.1, "cubic")
    assert joins.resample(p, spark.createDataFrame([(0, 0)], "y long, x long"), F.lit(9.0), F.lit(0.5), "v").count() == 0


def test_multilook_drops_the_rest(spark):
    p = statistics.multilook(raster(spark, np.arange(15.0).reshape(3, 5)), "v", 2, 2)
    assert (p.height, p.width) == (1, 2) and back(p).tolist() == [[3.0, 5.0]]


def test_clusters(spark):
    rng = np.random.default_rng(2)
    grid = np.where(np.arange(200).reshape(10, 20) % 2 == 0, 0.0, 8.0) + 0.1 * rng.standard_normal((10, 20))
    p = raster(spark, grid)
    _, means = clusters.kmeans(p, ["v"], 2)
    assert sorted(round(x[0]) for x in means) == [0, 8]
    _, prior, mean, _ = clusters.gaussian_mixture(p, ["v"], 2, 20)
    assert sorted(np.round(mean.ravel()).tolist()) == [0.0, 8.0] and prior[0] == pytest.approx(0.5, abs=0.05)


def test_pca_of_a_line(spark):
    rows = [(0, i, float(i), 2.0 * i) for i in range(10)]
    p = product(spark.createDataFrame(rows, "y long, x long, a double, b double"))
    out, values = clusters.pca(p, ["a", "b"], 2)
    assert values[1] == pytest.approx(0, abs=1e-9)
    got = [r["pc0"] for r in out.pixels.orderBy("x").collect()]
    assert np.allclose(got, np.sqrt(5) * np.arange(10))


def test_components(spark):
    mask = np.array([[1, 1, 0, 0, 1], [0, 0, 1, 0, 1], [0, 0, 0, 0, 0], [1, 0, 1, 1, 1], [1, 0, 1, 0, 1], [1, 1, 1, 0, 1.0]])
    got = {(r["y"], r["x"]): r["label"] for r in clusters.components(raster(spark, mask), F.col("v") > 0).collect()}
    assert len(got) == int(mask.sum()) and len(set(got.values())) == 3
    assert got[(0, 0)] == got[(1, 2)] == 0 and got[(3, 0)] == got[(5, 4)] and got[(0, 4)] == got[(1, 4)]
    assert clusters.components(raster(spark, mask), F.col("v") > 9).count() == 0
    assert clusters.drop_small(raster(spark, mask), F.col("v") > 0, 5).count() == 11


def test_utm_of_a_known_place(spark):
    e, n = geometry.transverse_mercator(F.lit(48.8582), F.lit(2.2945), 3.0)
    got = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert got["e"] == pytest.approx(448251.8, abs=1.5) and got["n"] == pytest.approx(5411932.7, abs=1.5)


def test_polygon_and_land(spark):
    p = raster(spark, RAMP)
    assert p.pixels.where(pixels.mask_polygon([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])).count() == 4


def test_stores(spark, tmp_path):
    p = raster(spark, RAMP)
    stores.write_product(p, f"{tmp_path}/a", tile=2)
    again = stores.read_product(spark, f"{tmp_path}/a")
    assert (again.height, again.width) == (4, 4) and np.array_equal(back(again), RAMP)
    stores.write_csv(p.pixels, f"{tmp_path}/b", {"mission": "x=1"})
    rows, names = stores.read_csv(spark, f"{tmp_path}/b")
    assert rows.dtypes == p.pixels.dtypes and rows.count() == 16 and names == {"mission": "x=1"}
    cube = np.arange(24, dtype=">i2").reshape(2, 3, 4)
    for kind, data in (("bsq", cube), ("bil", cube.swapaxes(0, 1)), ("bip", np.moveaxis(cube, 0, 2))):
        (tmp_path / f"{kind}.img").write_bytes(np.ascontiguousarray(data).tobytes())
        (tmp_path / f"{kind}.hdr").write_text(f"ENVI\nsamples = 4\nlines = 3\nbands = 2\ndata type = 2\nbyte order = 1\ninterleave = {kind}\nband names = {{\n a,\n b}}\n")
        q = stores.read_envi(spark, f"{tmp_path}/{kind}.hdr", f"{tmp_path}/{kind}.img")
        assert np.array_equal(back(q, "b"), cube[1])
    assert [r[0] for r in p.pixels.select(stores.tile_name(p, 4)).distinct().orderBy(F.lit(1)).collect()].__len__() == 4
    assert len(stores.image_rows(p, "v", "v", "v", 0, 16).first()["rgb"]) == 12


def test_control_points_and_warp(spark):
    from rasterlake.operators import registration as r

    rng = np.random.default_rng(4)
    base = rng.random((70, 70))
    spectrum = np.fft.fft2(base) * np.exp(-40 * (np.fft.fftfreq(70)[:, None] ** 2 + np.fft.fftfreq(70)[None, :] ** 2))
    base = np.real(np.fft.ifft2(spectrum)) * 100
    moved = np.roll(base, (3, -2), axis=(0, 1))
    points = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate([(20, 20), (20, 45), (45, 20), (45, 45), (32, 32), (1, 1)])], "point_id long, y long, x long")
    a, b = raster(spark, base), raster(spark, moved)
    got = r.ground_control_points(a, b, "v", points, half=12).collect()
    assert len(got) == 5
    assert all(abs(g["sy"] - g["y"] - 3) < 0.3 and abs(g["sx"] - g["x"] + 2) < 0.3 for g in got)
    cx, cy, rms = r.warp_terms(np.array([(g["y"], g["x"], g["sy"], g["sx"]) for g in got], float), 1)
    assert abs(cx[0] + cx[1] * 30 + cx[2] * 30 - 28) < 0.3 and rms.max() < 0.5
    out = back(r.coregister(a, b, "v", points, half=12))
    assert np.nanmean(np.abs(out - base)[10:60, 10:60]) < 0.1 * base.std()


def test_range_doppler(spark):
    from rasterlake.operators import registration as r

    states = [(float(t), (0.0, 100.0 * t, 5000.0), (0.0, 100.0, 0.0)) for t in range(11)]
    targets = spark.createDataFrame([(0, 0, 3000.0, 250.0, 0.0), (0, 1, 3000.0, 5000.0, 0.0)], "y long, x long, tx double, ty double, tz double")
    got = r.range_doppler(targets, states, 0.0, 0.01, 5000.0, 10.0).collect()
    assert len(got) == 1
    assert got[0]["v"] == pytest.approx(250.5, abs=1e-3) and got[0]["u"] == pytest.approx((34e6**0.5 - 5000) / 10 + 0.5, abs=1e-3)


def test_wind(spark):
    from rasterlake.operators import registration as r

    row = spark.range(1).select(r.backscatter(F.lit(8.0), F.lit(45.0), F.lit(30.0)).alias("s"), r.backscatter(F.lit(8.0), F.lit(0.0), F.lit(30.0)).alias("up"), r.backscatter(F.lit(8.0), F.lit(90.0), F.lit(30.0)).alias("side"))
    got = row.withColumn("v", r.wind_speed(F.col("s"), F.lit(45.0), F.lit(30.0))).first()
    assert got["v"] == pytest.approx(8.0) and got["up"] > got["s"] > got["side"] > 0
    yy, xx = np.mgrid[:32, :32]
    grid = 0.05 + 0.01 * np.sin(2 * np.pi * xx / 8)  # streaks along y
    cells = r.wind_field(raster(spark, grid), "v", 30.0, 16).collect()
    assert len(cells) == 4 and all(abs(c["direction"] - 90) < 1 and 0 < c["speed"] <= 20 for c in cells)


def test_missing_sample_of_a_ramp(spark):
    """Filters use the samples present and keep every pixel; a pixel in the middle of a 5x5 ramp is missing."""
    rows = [(y, x, None if (y, x) == (2, 2) else float(5 * y + x)) for y in range(5) for x in range(5)]
    p = product(spark.createDataFrame(rows, "y long, x long, v double"))
    grid = {(y, x): v for y, x, v in rows}
    near = lambda y, x: [v for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (v := grid[min(max(y + dy, 0), 4), min(max(x + dx, 0), 4)]) is not None]
    mean = {(r["y"], r["x"]): r["v"] for r in neighbourhood.box_mean(p, "v").pixels.collect()}
    low = {(r["y"], r["x"]): r["v"] for r in neighbourhood.rank_filter(p, "v", "min").pixels.collect()}
    for at in grid:
        assert mean[at] == pytest.approx(sum(near(*at)) / len(near(*at))) and low[at] == min(near(*at))
    kernel = {(r["y"], r["x"]): r["v"] for r in neighbourhood.kernel_filter(p, "v", *neighbourhood.KERNELS["laplace_3x3"]).pixels.collect()}
    assert len(kernel) == 25 and kernel[2, 2] is None and kernel[0, 0] is not None
    at = spark.createDataFrame([(0, 0)], "y long, x long")
    assert joins.resample(p, at, F.lit(2.75), F.lit(2.5), "v", "bilinear").first()["v"] == 13.0  # the only one of its two neighbours


def test_raster_of_one_line(spark):
    p = from_arrays(spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "id long, a array<double>"), "id", "a")
    assert (p.height, p.width, p.pixels.count()) == (1, 3, 3)


def test_geodesics(spark):
    """A quarter of the equator and of a meridian have known lengths; the way back is the reverse; odd places."""
    rows = [(1, 0.0, 0.0, 0.0, 90.0), (2, 0.0, 0.0, 90.0, 0.0), (3, 50.0, 5.0, 50.0, 5.0), (4, None, 0.0, 1.0, 1.0), (5, 0.0, 0.0, 0.3, 179.9), (6, 10.0, 170.0, -20.0, -160.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double")
    got = {r["k"]: r for r in geometry.geodesic(df, "a", "b", "c", "d").collect()}
    assert got[1]["distance"] == pytest.approx(6378137.0 * np.pi / 2, abs=1e-3) and got[1]["heading"] == pytest.approx(90)
    assert got[2]["distance"] == pytest.approx(10001965.729, abs=1e-2) and got[2]["heading"] == pytest.approx(0)
    assert (got[3]["distance"], got[3]["heading"]) == (0.0, None)
    assert got[4]["distance"] is None and got[5]["distance"] is None
    there = geometry.geodesic(df, "a", "b", "c", "d").where("k in (1, 6)")
    for r in geometry.travel(there.withColumnRenamed("back_heading", "back"), "a", "b", "distance", "heading").collect():
        assert (r["to_lat"], r["to_lon"]) == pytest.approx((r["c"], r["d"]), abs=1e-8)
        assert r["back_heading"] == pytest.approx(r["back"], abs=1e-6)


def test_ascii_grid_and_elevation_tile(spark, tmp_path):
    """Grids come back with their missing samples; a pixel and a line that are absent are missing ones."""
    rows = [(0, 0, 1.5), (0, 1, None), (0, 2, -2.0), (2, 0, 4.0), (2, 2, 1e-7)]
    p = product(spark.createDataFrame(rows, "y long, x long, v double"))
    stores.write_ascii_grid(p, "v", f"{tmp_path}/grid", (5.0, 6.0), 0.25)
    q = stores.read_ascii_grid(spark, f"{tmp_path}/grid")
    held = {(r["y"], r["x"]): r["v"] for r in q.pixels.collect()}
    assert (q.height, q.width, q.meta) == (3, 3, {"corner": (5.0, 6.0), "cell": 0.25})
    assert held == {(y, x): None for y in range(3) for x in range(3)} | {(y, x): v for y, x, v in rows}
    np.array([[1, -9999], [300, -2]], ">i2").tofile(f"{tmp_path}/tile.dem")
    tile = stores.read_elevation_tile(spark, f"{tmp_path}/tile.dem", 2, 2).pixels.collect()
    assert {(r["y"], r["x"]): r["elevation"] for r in tile} == {(0, 0): 1.0, (0, 1): None, (1, 0): 300.0, (1, 1): -2.0}


def test_geometry_join_odd_shapes(spark):
    """A concave polygon over several cells against the parity of one literal; shapes without an area, outside or null have no pixels."""
    p = raster(spark, np.arange(80.0 * 70).reshape(80, 70))
    corners = [(2.2, 1.1), (66.3, 4.4), (30.1, 30.2), (68.0, 77.7), (5.5, 60.6)]
    shapes = [(1, corners, 7.0), (2, [], 7.0), (3, None, 7.0), (4, [(1.0, 1.0), (9.0, 9.0)], 7.0), (5, [(-9.0, -9.0), (-1.0, -9.0), (-1.0, -1.0)], 7.0), (6, [(-9.0, -9.0), (500.0, -9.0), (500.0, 500.0), (-9.0, 500.0)], 7.0)]
    df = spark.createDataFrame(shapes, "id int, points array<struct<x: double, y: double>>, v double")
    got = joins.geometry_join(p, df, "points").collect()
    wanted = {(r["y"], r["x"]) for r in p.pixels.where(pixels.mask_polygon(corners)).collect()}
    assert {(r["y"], r["x"]) for r in got if r["id"] == 1} == wanted and len(got) == len(wanted) + 80 * 70
    assert {r["v"] for r in got} == {7.0}  # the shapes' column
