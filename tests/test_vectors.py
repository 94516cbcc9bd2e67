"""Vector layers, tiled elevation models, and fine registration."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.operators import elevation, registration, vectors
from test_operators import back, raster

SHAPES = [
    (1, "POLYGON ((2 1, 12.2 1, 12.2 9.7, 2 9.7, 2 1), (4 3, 8 3, 8 6, 4 6, 4 3))"),
    (2, "MULTIPOLYGON (((0 0, 3 0, 0 3, 0 0)), ((14 2, 19.5 5, 15 11.5, 14 2)))"),
    (3, "polygon((-5 8, 30 8, 30 10.4, -5 10.4, -5 8))"),
    (4, "LINESTRING (1.5 1.5, 6.5 4.2, 6.5 9)"),
    (5, "MULTIPOINT ((3.2 3.9), (17 0.5), (40 2))"),
    (6, "POINT (0 0)"),
    (7, "POLYGON EMPTY"),
    (8, None),
    (9, "POLYGON Z ((2 2 7, 5 2 7, 5 5 7, 2 5 7, 2 2 7))"),
]


def covered(wkt, y, x):
    """Even-odd rule at a pixel's centre, for rings given as lists of corners."""
    import re

    rings = [[tuple(map(float, p.split()[:2])) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", wkt)]
    cy, cx, odd = y + 0.5, x + 0.5, False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay <= cy) != (by <= cy) and ax + (cy - ay) * (bx - ax) / (by - ay) <= cx:
                odd = not odd
    return odd


def test_burn(spark):
    df = spark.createDataFrame(SHAPES, "id int, wkt string")
    got = {}
    for r in vectors.burn(df, "id", "wkt", 12, 20).collect():
        got.setdefault(r["id"], []).append((r["y"], r["x"]))
    for k, wkt in SHAPES:
        if wkt and "POLYGON" in wkt.upper() and "EMPTY" not in wkt:
            assert sorted(got[k]) == [(y, x) for y in range(12) for x in range(20) if covered(wkt, y, x)], k
    assert sorted(got[5]) == [(0, 17), (3, 3)] and got[6] == [(0, 0)] and 7 not in got and 8 not in got
    line = sorted(got[4])
    assert line[0] == (1, 1) and (9, 6) in line and len(line) == len(set(line)) and {y for y, _ in line} == set(range(1, 10))
    dense = {(int(1.5 + 2.7 * t), int(1.5 + 5 * t)) for t in np.linspace(0, 1, 2001)} | {(y, 6) for y in range(4, 10)}
    assert {(y, x) for y, x in dense if y != 4 or x >= 6} <= set(line)
    mask = vectors.mask(raster(spark, np.zeros((12, 20))), df.where("id in (1, 2)"), "wkt").pixels
    assert mask.where("mask").count() == len(set(got[1]) | set(got[2])) and mask.count() == 240


def test_read_features(spark, tmp_path):
    (tmp_path / "f.csv").write_text("#separator=TAB\n# styleCss = color:0,0,255\n\norg.made.FT1\tname:String\tgeom:Geometry\tpixel:Integer\tdescription:String\nID65\tmark1\tPOINT(12.3 45.6)\t0\tThis is mark1.\nID66\tmark2\tPOINT(78.9 10.1)\t1\t[null]\nID67\tmark3\tPOINT(23.4 56.7)\tx\tThis is mark3.\nID68\tshort\n")
    df, about = vectors.read_features(spark, str(tmp_path / "f.csv"))
    assert about == {"separator": "TAB", "styleCss": "color:0,0,255"}
    assert [tuple(r) for r in df.orderBy("feature_id").collect()] == [("ID65", "mark1", "POINT(12.3 45.6)", 0, "This is mark1."), ("ID66", "mark2", "POINT(78.9 10.1)", 1, None), ("ID67", "mark3", "POINT(23.4 56.7)", None, "This is mark3.")]
    assert dict(df.dtypes)["pixel"] == "int"
    (tmp_path / "g.csv").write_text("name:String\tlat:Double\na\t1.5\n")
    assert [tuple(r) for r in vectors.read_features(spark, str(tmp_path / "g.csv"))[0].collect()] == [(None, "a", 1.5)]


def test_elevation_of_tiles(spark, tmp_path):
    store = elevation.TileStore(str(tmp_path), 10, 20, -1)
    whole = np.zeros((360, 720))
    rng = np.random.default_rng(1)
    for south, west in ((40, 0), (40, 10), (30, 0), (-10, 170), (-10, -180), (80, -180)):
        tile = rng.integers(0, 3000, (20, 20)).astype(">i2")
        tile[3, 4] = -1
        (tmp_path / store.path(south, west).rsplit("/", 1)[1]).write_bytes(tile.tobytes())
        r, c = int((90 - south - 10) * 2), int((west + 180) * 2)
        whole[r : r + 20, c : c + 20] = np.where(tile == -1, np.nan, tile)
    places = [(49.9, 0.1), (40.01, 5.3), (39.99, 9.99), (44.4, 10.0), (-5.2, 179.9), (-5.2, -179.9), (89.9, -179.8), (0.0, 50.0), (48.3, 2.2), (-5.1, 181.0)]
    df = spark.createDataFrame([(k, 0, a, b) for k, (a, b) in enumerate(places)] + [(90, 0, None, 1.0), (91, 0, 95.0, 1.0)], "y int, x int, la double, lo double")
    got = {r["y"]: r["elevation"] for r in elevation.elevation_at(df, F.col("la"), F.col("lo"), store).collect()}
    assert sorted(got) == list(range(len(places)))
    for k, (lat, lon) in enumerate(places):
        r, c = (90 - lat) * 2 - 0.5, ((lon + 180) % 360) * 2 - 0.5
        a, b = int(np.floor(r)), int(np.floor(c))
        v, w = [], []
        for i in (0, 1):
            for j in (0, 1):
                s = whole[min(max(a + i, 0), 359), (b + j) % 720]
                if not np.isnan(s):
                    v.append(s)
                    w.append((r - a if i else 1 - r + a) * (c - b if j else 1 - c + b))
        assert got[k] == pytest.approx(np.average(v, weights=w))
    near = {r["y"]: r["elevation"] for r in elevation.elevation_at(df, F.col("la"), F.col("lo"), store, "nearest").collect()}
    assert near[0] == whole[80, 360] and near[7] == 0.0


def speckled(seed, n=96):
    """A complex image with a smooth spectrum."""
    rng = np.random.default_rng(seed)
    s = rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n))
    f = np.fft.fftfreq(n)
    return s * np.exp(-30 * (f[:, None] ** 2 + f[None, :] ** 2))


def pair(spark, z):
    return raster(spark, z.real, "i").with_pixels(raster(spark, z.real, "i").pixels.join(raster(spark, z.imag, "q").pixels, ["y", "x"]))


@pytest.mark.parametrize("box", [None, 5])
def test_fine_registration_finds_sub_pixel_shifts(spark, box):
    n = 96
    spectrum = speckled(2, n)
    f = np.fft.fftfreq(n)
    dy, dx = 2.31, -1.27
    master = np.fft.ifft2(spectrum) * 100
    slave = np.fft.ifft2(spectrum * np.exp(-2j * np.pi * (f[:, None] * dy + f[None, :] * dx))) * 100 * np.exp(0.7j)
    places = [(30, 30), (40, 60), (60, 35)]
    rows = [(k, y, x, float(round(y + dy)), float(round(x + dx))) for k, (y, x) in enumerate(places)] + [(9, 2, 2, 4.0, 1.0)]
    points = spark.createDataFrame(rows, "point_id long, y long, x long, sy double, sx double")
    got = registration.fine_control_points(pair(spark, master), pair(spark, slave), ("i", "q"), points, 32, 0.6, box).collect()
    assert sorted(r["point_id"] for r in got) == list(range(len(places)))
    assert all(abs(r["sy"] - r["y"] - dy) < 0.05 and abs(r["sx"] - r["x"] - dx) < 0.05 and r["coherence"] > 0.8 for r in got)
    other = pair(spark, np.fft.ifft2(speckled(3, n)))
    assert registration.fine_control_points(pair(spark, master), other, ("i", "q"), points, 32, 0.6, box).count() == 0


def test_warp_fit_equals_the_plain_fit(spark):
    rng = np.random.default_rng(4)
    y, x = rng.uniform(0, 3000, (2, 60))
    sy, sx = y + 2 + 1e-3 * x + rng.normal(0, 0.1, 60), x - 3 + 2e-7 * y * y + rng.normal(0, 0.1, 60)
    sy[:3] += 30
    table = np.stack([y, x, sy, sx], axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in table], "y double, x double, sy double, sx double")
    for order in (1, 2, 3):
        cx, cy, _ = registration.warp_terms(table, order)
        gx, gy = registration.warp_fit(df, order)
        terms = lambda c: sum(k * t for k, t in zip(c, [1, x, y, x * x, x * y, y * y, x**3, x * x * y, x * y * y, y**3], strict=False))
        assert np.allclose(terms(gx), terms(cx), atol=1e-4) and np.allclose(terms(gy), terms(cy), atol=1e-4)
    assert back(raster(spark, np.ones((2, 2)))).sum() == 4


@pytest.mark.parametrize("angle", [0, 20, 45, 70, 90, 130, 160])
def test_streaks(spark, angle):
    """Streaks of limited length at an angle: noise that is smoothed more along them than across."""
    rng = np.random.default_rng(5)
    f = np.fft.fftfreq(96)
    t = np.radians(angle)
    along, across = f[None, :] * np.cos(t) - f[:, None] * np.sin(t), f[None, :] * np.sin(t) + f[:, None] * np.cos(t)  # y points down
    noise = np.fft.ifft2(np.fft.fft2(rng.normal(size=(96, 96))) * np.exp(-2 * np.pi**2 * ((7 * along) ** 2 + (1.0 * across) ** 2))).real
    grid = 2 + 0.5 * noise / noise.std()
    got, ratio = registration.streak_direction(grid)
    assert abs((got - angle + 90) % 180 - 90) < 12 and 0 <= ratio < 1  # the square window draws slanted ones towards its axes
    even = registration.streak_direction(np.ones((32, 32)))
    assert 0 <= even[0] <= 180 and even[1] <= 1
    cells = registration.wind_field(raster(spark, 10 * np.log10(grid * 0.01)), "v", 30.0, 48, in_db=True, hh=True).collect()
    assert len(cells) == 4 and all(0 < c["speed"] <= 20 for c in cells)
