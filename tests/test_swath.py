"""Tie-point grids, places on irregular grids, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.operators import swath
from rasterlake.operators import tie_points as tp
from rasterlake.product import Product
from test_operators import back, raster

# A grid of 3 by 5 points and its values between and beyond them.
FIVE = [[0.0, 1.0, 2.0], [1.0, 2.0, 3.0], [2.0, 3.0, 4.0], [3.0, 4.0, 5.0], [4.0, 5.0, 6.0]]
BEYOND = [(-1, -1, -0.75), (4, -1, 0.5), (9, -1, 1.75), (-1, 4, 1.75), (4, 4, 3.0), (9, 4, 4.25), (-1, 9, 4.25), (4, 9, 5.5), (9, 9, 6.75)]


def at(spark, t, places, how=tp.bilinear_at):
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "k int, px double, py double")
    return [r["v"] for r in how(t, df, F.col("px"), F.col("py"), "v").orderBy("k").collect()]


def test_between_and_beyond_points(spark):
    t = tp.tie_points(spark, FIVE, (0.5, 0.5), (4.0, 2.0))
    assert at(spark, t, [(x + 0.5, y + 0.5) for x, y, _ in BEYOND]) == pytest.approx([v for _, _, v in BEYOND])
    places = [(i * 2 + 0.5, j + 0.5) for j in range(9) for i in range(5)]
    assert at(spark, t, places) == pytest.approx([(i + j) / 2 for j in range(9) for i in range(5)])
    whole = {(r["y"], r["x"]): r["v"] for r in tp.over(t, 12, 11, "v").collect()}
    assert sorted(whole) == [(y, x) for y in range(12) for x in range(11)]
    assert all(v == pytest.approx(x / 4 + y / 2) for (y, x), v in whole.items())


def test_angles_leap(spark):
    t = tp.tie_points(spark, [[350.0, 10.0], [350.0, 10.0]], (0.5, 0.5), (10.0, 10.0), 360)
    assert tp.angle_discontinuity(t) == 360
    got = np.array(at(spark, t, [(3.0, 1.0), (5.5, 1.0), (8.0, 1.0)]))
    assert ((got >= 0) & (got <= 360)).all() and np.allclose((got - [354.9, 0.0, 5.1] + 180) % 360, 180, atol=0.2)
    t = tp.tie_points(spark, [[170.0, -170.0], [170.0, -170.0]], (0.5, 0.5), (10.0, 10.0), 180)
    assert np.abs(at(spark, t, [(5.5, 1.0)])) == pytest.approx([180.0])
    assert {(r["x"]): r["v"] for r in tp.over(t, 1, 11, "v").collect()}[0] == pytest.approx(170.0)


@pytest.mark.parametrize("offset", [0.0, 0.5, 7.0])
def test_quadratic_rows(spark, offset):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(4, 7))
    t = tp.tie_points(spark, grid.tolist(), (offset, 1.0), (16.0, 8.0))
    x = np.array([int(offset + k * 16) for k in range(7)], float)
    fits = [np.polyfit(x, line, 2)[::-1] for line in grid]
    got = [(r["c0"], r["c1"], r["c2"]) for r in tp.quadratic_fit(t).orderBy("row").collect()]
    assert np.allclose(got, fits, atol=1e-9)
    places = [(3.0, 1.0), (50.0, 9.5), (90.0, 1000.0), (5.0, -20.0)]
    rows = [0, 1, 3, 0]
    assert at(spark, t, places, tp.quadratic_at) == pytest.approx([float(np.polyval(fits[r][::-1], p[0])) for r, p in zip(rows, places, strict=True)])


def test_biquadratic(spark):
    rng = np.random.default_rng(2)
    grid = rng.normal(size=(5, 6)) * 1e3
    t = tp.tie_points(spark, grid.tolist(), (3.0, 4.0), (16.0, 8.5))
    y, x = (a.ravel().astype(float) for a in np.mgrid[:5, :6])
    x, y = np.floor(x * 16), np.floor(y * 8.5)
    wanted = np.linalg.lstsq(np.stack([np.ones(30), x, y, x * x, x * y, y * y], axis=1), grid.ravel(), rcond=None)[0]
    assert np.allclose(tp.biquadratic_fit(t), wanted, rtol=1e-7, atol=1e-9)


def test_subset(spark):
    grid = np.add.outer(np.arange(9.0) * 2, np.arange(8.0)).tolist()
    t = tp.tie_points(spark, grid, (0.5, 0.5), (16.0, 8.0))
    s = tp.subset(t, 40, 20, 32, 24, 2, 1)
    assert (s.step_x, s.step_y) == (8.0, 8.0) and s.points.count() == s.rows * s.cols
    places = [(0.5, 0.5), (10.5, 3.5), (15.5, 23.5)]
    source = [(40 + (x - 0.5) * 2 + 0.5, 20 + y) for x, y in places]
    assert at(spark, s, places) == pytest.approx(at(spark, t, source))


def skewed(y, x, lon0):
    """Coordinates of a swath that is turned and bent."""
    return 40.0 - 0.8 * y - 0.3 * x + 0.004 * x * x, (lon0 + 0.9 * x - 0.35 * y + 0.003 * x * y + 180) % 360 - 180


def with_coordinates(spark, grid, lon0):
    h, w = grid.shape
    rows = []
    for y in range(h):
        for x in range(w):
            lat, lon = skewed(y, x, lon0)
            rows.append((y, x, float(lat), float(lon), float(grid[y, x])))
    return Product(spark.createDataFrame(rows, "y long, x long, lat double, lon double, v double"), h, w)


@pytest.mark.parametrize("lon0", [10.0, 172.0, -176.0])
def test_places_on_a_skewed_swath(spark, lon0):
    p = with_coordinates(spark, np.zeros((12, 15)), lon0)
    rng = np.random.default_rng(3)
    places = np.concatenate([rng.uniform([0, 0], [11, 14], (60, 2)), [[0, 0], [11, 14], [4, 7]]])
    rows = []
    for k, (y, x) in enumerate(places):
        a, b = int(min(y, 10)), int(min(x, 13))
        w = [(1 - y + a) * (1 - x + b), (1 - y + a) * (x - b), (y - a) * (1 - x + b), (y - a) * (x - b)]
        corner = [skewed(a + i, b + j, lon0) for i in (0, 1) for j in (0, 1)]
        lons = [(c[1] - corner[0][1] + 180) % 360 - 180 for c in corner]
        lon = (sum(u * v for u, v in zip(w, lons, strict=True)) + corner[0][1] + 180) % 360 - 180
        rows.append((k, float(sum(u * c[0] for u, c in zip(w, corner, strict=True))), float(lon)))
    rows += [(900, 80.0, 0.0), (901, None, 1.0), (902, float("nan"), 1.0)]
    got = {r["k"]: r for r in swath.locate(swath.pixel_quads(p), spark.createDataFrame(rows, "k int, la double, lo double"), F.col("la"), F.col("lo"), ("k",)).collect()}
    assert sorted(got) == list(range(len(places)))
    for k, (y, x) in enumerate(places):
        assert (got[k]["sy"], got[k]["sx"]) == pytest.approx((y + 0.5, x + 0.5), abs=1e-5)
    for k in (60, 61, 62):
        assert (got[k]["near_y"], got[k]["near_x"]) == (places[k][0] + 0.5, places[k][1] + 0.5)


@pytest.mark.parametrize("lon0", [172.0, -8.0])
def test_places_do_not_depend_on_blocks(spark, monkeypatch, lon0):
    rng = np.random.default_rng(4)
    p = with_coordinates(spark, np.zeros((21, 19)), lon0)
    # A part lies over another one, some points are missing, two are there twice and one quad is far too wide.
    over = p.pixels.withColumn("lat", F.when(F.expr("y > 13"), F.col("lat") + 6.3).otherwise(F.col("lat"))).withColumn("lat", F.when(~F.expr("(y = 5 and x = 5) or (y = 8 and x = 16)"), F.col("lat")))
    over = over.withColumn("lon", F.when(F.expr("y = 20 and x = 18"), F.col("lon") + 150).otherwise(F.col("lon")))
    twice = over.where("y = 8 and x in (7, 8)").withColumn("lat", F.col("lat") + F.when(F.col("x") == 7, 0.05).otherwise(-0.05))
    p = Product(over.unionByName(twice), 21, 19)
    y, x = rng.uniform(0, 20, 3000), rng.uniform(0, 18, 3000)
    places = np.stack(skewed(y, x, lon0), axis=1)
    places[::3, 0] += 6.3
    lat, lon = skewed(*np.mgrid[:21, :19], lon0)
    places = np.concatenate([places, np.stack([lat.ravel(), lon.ravel()], axis=1)])
    asked = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(places)], "k int, la double, lo double")
    found = []
    for blocks, pairs in ((1024, 1 << 19), (1, 1 << 19), (8, 100)):
        monkeypatch.setattr(swath, "BLOCKS", blocks)
        monkeypatch.setattr(swath, "PAIRS", pairs)
        q = swath.pixel_quads(p)
        found.append((q.side, sorted(tuple(r) for r in swath.locate(q, asked, F.col("la"), F.col("lo"), ("k",)).collect())))
    assert [side for side, _ in found] == [1, 16, 4]
    assert len(found[0][1]) > 2000 and found[0][1] == found[1][1] == found[2][1]


def test_collocate(spark):
    y, x = np.mgrid[:12, :15]
    p = with_coordinates(spark, 2.0 * y + x, 178.0)
    target = Product(p.pixels.where("y between 2 and 8 and x between 3 and 9").select("y", "x", "lat", "lon"), 12, 15)
    got = swath.collocate(p, "v", swath.pixel_quads(p), target, F.col("lat"), F.col("lon"))
    assert np.allclose(back(got)[2:9, 3:10], (2.0 * y + x)[2:9, 3:10], atol=1e-6)
    near = swath.collocate(p, "v", swath.pixel_quads(p), target, F.col("lat") + 0.05, F.col("lon") - 0.02, "nearest")
    assert np.allclose(back(near)[2:9, 3:10], (2.0 * y + x)[2:9, 3:10])
    holes = Product(p.pixels.withColumn("lat", F.when(~F.expr("y = 5 and x = 5"), F.col("lat"))), 12, 15)
    got = back(swath.collocate(holes, "v", swath.pixel_quads(holes), target, F.col("lat") + 1e-4, F.col("lon")))
    assert np.isnan(got[5, 5]) and not np.isnan(got[7, 7])
    none = Product(p.pixels.limit(0), 12, 15)
    assert swath.collocate(none, "v", swath.pixel_quads(none), target, F.col("lat"), F.col("lon")).pixels.count() == 0


def test_tie_point_quads_agree_with_the_grids(spark):
    lat = tp.tie_points(spark, [[50.0 - i - 0.2 * j for j in range(4)] for i in range(4)], (0.5, 0.5), (8.0, 8.0))
    lon = tp.tie_points(spark, [[5.0 + 1.5 * j - 0.3 * i for j in range(4)] for i in range(4)], (0.5, 0.5), (8.0, 8.0))
    places = [(3.3, 4.4), (20.0, 9.1), (0.5, 0.5)]
    la, lo = at(spark, lat, places), at(spark, lon, places)
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(la, lo, strict=True))], "k int, la double, lo double")
    got = {r["k"]: (r["sx"], r["sy"]) for r in swath.locate(swath.tie_point_quads(lat, lon), df, F.col("la"), F.col("lo"), ("k",)).collect()}
    assert [got[k] for k in range(3)] == [pytest.approx(p, abs=1e-6) for p in places]


def geolocated(spark):
    """A slant-range raster: range grows with x by 10 m a sample, coordinates follow line and sample."""
    step = 8.0
    lat = tp.tie_points(spark, [[10.0 + 0.01 * i * step for _ in range(5)] for i in range(5)], (0.5, 0.5), (step, step))
    lon = tp.tie_points(spark, [[20.0 + 0.01 * j * step for j in range(5)] for _ in range(5)], (0.5, 0.5), (step, step))
    ns = tp.tie_points(spark, [[(800_000.0 + 10.0 * j * step) / swath.HALF_LIGHT * 1e9 for j in range(5)] for _ in range(5)], (0.5, 0.5), (step, step))
    y, x = np.mgrid[:32, :32]
    return raster(spark, (100.0 * y + x).astype(float)), lat, lon, ns


def test_ellipsoid_correction_by_geolocation_grid(spark):
    source, lat, lon, ns = geolocated(spark)
    target = spark.createDataFrame([(i, j) for i in range(6) for j in range(6)], "y long, x long")
    la, lo = 10.0 + 0.01 * (F.col("y") * 4 + 0.25), 20.0 + 0.01 * (F.col("x") * 4 + 0.5)
    got = back(swath.ellipsoid_correction_gg(source, "v", lat, lon, ns, target, 6, 6, la, lo, 10.0, 0.0, 1.0, zero_doppler=True))
    y, x = np.mgrid[:6, :6]
    # Line and sample count from the first pixel's centre, at .5 of the tie points' places.
    assert np.allclose(got, 100 * (4 * y + 0.25 + 0.5) + 4 * x + 0.5, atol=1e-3)
    late = back(swath.ellipsoid_correction_gg(source, "v", lat, lon, ns, target, 6, 6, la, lo, 10.0, 0.0, 0.01))
    shift = (800_000.0 + 10.0 * (4 * x + 0.5)) / swath.HALF_LIGHT / 0.01
    assert np.allclose(late, got + 100 * shift, atol=1e-2)


def test_ellipsoid_correction_in_ground_range(spark):
    source, lat, lon, ns = geolocated(spark)
    target = spark.createDataFrame([(1, j) for j in range(6)], "y long, x long")
    la, lo = 10.0 + 0.01 * (F.col("y") * 4 + 0.5), 20.0 + 0.01 * F.col("x") * 4
    # slant = 800000 + g: sample = g / 10; a record with another origin holds from second 100 on
    records = [(0.0, 0.0, [800_000.0, 1.0]), (100.0, 0.0, [0.0, 1.0])]
    got = back(swath.ellipsoid_correction_gg(source, "v", lat, lon, ns, target, 2, 6, la, lo, 10.0, 0.0, 1.0, zero_doppler=True, ground_range=records))
    assert np.allclose(got[1], 100 * 5.0 + 4 * np.arange(6), atol=1e-3)
    right = back(swath.ellipsoid_correction_gg(source, "v", lat, lon, ns, target, 2, 6, la, lo, 10.0, 0.0, 1.0, zero_doppler=True, near_left=False, ground_range=records))
    assert np.allclose(right[1][1:], 100 * 5.0 + 31 - 4 * np.arange(1, 6), atol=1e-3)
