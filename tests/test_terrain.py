"""Terrain correction by a simulated image."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.operators import terrain
from rasterlake.product import Product
from test_operators import back

A = 6378137.0


def scene(spark, hills):
    """A grid near (0, 0), seen from 700 km above the west by a sensor that flies north."""
    n, step = 60, 0.0009
    y, x = np.mgrid[:n, :n]
    lat, lon = 0.027 - y * step, x * step
    h = 150 * np.exp(-((y - 22) ** 2 + (x - 36) ** 2) / 40) + 120 * np.exp(-((y - 42) ** 2 + (x - 18) ** 2) / 30) + 60 * np.sin(x / 3.0) * np.cos(y / 4.0) if hills else np.zeros((n, n))
    rows = [(int(a), int(b), float(lat[a, b]), float(lon[a, b]), float(h[a, b])) for a in range(n) for b in range(n)]
    angle = np.radians(-3.5)
    place = lambda t: ((A + 700e3) * np.cos(angle), (A + 700e3) * np.sin(angle), 7000.0 * t)
    states = [(float(t), place(t), (0.0, 0.0, 7000.0)) for t in np.linspace(-2, 2, 9)]
    near = np.linalg.norm(np.array(place(0)) - [A, 0, 0]) - 900
    geometry = {"states": states, "first_line": -0.45, "line_time": 0.014, "near_range": float(near), "range_spacing": 60.0}
    return spark.createDataFrame(rows, "y long, x long, lat double, lon double, elevation double"), geometry, n


def test_incidence_on_flat_ground(spark):
    cells, geometry, n = scene(spark, False)
    got = {(r["y"], r["x"]): r for r in terrain.seen(cells, **geometry).collect()}
    assert len(got) == (n - 2) ** 2
    # On the sphere's equator: the triangle of the earth's centre, the sensor and the target.
    for (y, x), r in list(got.items())[::97]:
        lon = np.radians(x * 0.0009 + 3.5)
        sensor = A + 700e3
        slant = np.sqrt(A**2 + sensor**2 - 2 * A * sensor * np.cos(lon))
        off = np.degrees(np.arccos((A**2 + slant**2 - sensor**2) / (2 * A * slant)))
        assert r["incidence"] == pytest.approx(180 - off, abs=0.2) and r["projected"] == pytest.approx(r["incidence"], abs=0.2)


def test_slopes_change_the_incidence(spark):
    cells, geometry, _ = scene(spark, True)
    rows = {(r["y"], r["x"]): r for r in terrain.seen(cells, **geometry).collect()}
    flat = np.median([r["incidence"] for r in rows.values()])
    toward, away = rows[22, 31], rows[22, 41]  # west and east of a hill, the sensor stands in the west
    assert toward["incidence"] < flat < away["incidence"]
    assert all(r["projected"] <= 180 for r in rows.values())


def test_image_with_an_orbit_error_is_put_right(spark):
    cells, geometry, n = scene(spark, True)
    places = terrain.seen(cells, **geometry)
    size = places.agg(F.max("v").alias("v"), F.max("u").alias("u"), F.min("v").alias("v0"), F.min("u").alias("u0")).first()
    assert size["v0"] > 0 and size["u0"] > 0
    h, w = int(size["v"]) + 8, int(size["u"]) + 8
    exact = terrain.simulated_image(places, h, w, "s")
    truth = terrain.sarsim_terrain_correction(exact, "s", cells, n, n, method="nearest", **geometry)
    moved = Product(exact.pixels.select((F.col("y") + 2).alias("y"), (F.col("x") - 1).alias("x"), "s").where(f"y < {h} and x >= 0"), h, w)
    points = spark.createDataFrame([(k, y, x) for k, (y, x) in enumerate((a, b) for a in (20, 28, 36, 44) for b in range(20, w - 16, 8))], "point_id long, y long, x long")
    got = terrain.sarsim_terrain_correction(moved, "s", cells, n, n, points, 1, "nearest", matching={"half": 10, "quality": 1.5}, **geometry)
    a, b = back(truth, "s"), back(got, "s")
    inside = ~np.isnan(a) & ~np.isnan(b)
    wrong = back(terrain.sarsim_terrain_correction(moved, "s", cells, n, n, method="nearest", **geometry), "s")
    assert inside.sum() > 0.8 * (n - 2) ** 2 and (np.abs(a - b)[inside] < 1e-9).mean() > 0.8
    assert (np.abs(a - wrong)[inside & ~np.isnan(wrong)] < 1e-9).mean() < 0.6
    even = terrain.sarsim_terrain_correction(exact, "s", cells, n, n, method="nearest", reference_deg=30.0, **geometry)
    both = even.pixels.join(truth.pixels.select("y", "x", F.col("s").alias("t")), ["y", "x"]).where(F.abs(F.col("s") - F.col("t") * F.sin(F.radians("projected")) / 0.5) > 1e-9)
    assert both.count() == 0


def test_bistatic_lines(spark):
    cells, geometry, _ = scene(spark, False)
    a = {(r["y"], r["x"]): r for r in terrain.seen(cells, **geometry).where("x = 30").collect()}
    b = {(r["y"], r["x"]): r for r in terrain.seen(cells, bistatic=True, **geometry).where("x = 30").collect()}
    slant = geometry["near_range"] + (a[30, 30]["u"] - 0.5) * 60
    assert b[30, 30]["v"] - a[30, 30]["v"] == pytest.approx(slant / 149896229.0 / 0.014, rel=1e-6)
