"""Mosaics in the gradient domain against a dense solve, and oversampling in tiles."""

from fractions import Fraction

import numpy as np
import pytest
from rasterlake.operators import gradient_mosaic as g
from rasterlake.operators import neighbourhood
from test_operators import back, raster


def dense(old, new):
    """The mosaic of two arrays with NaN where one is absent, by one linear system."""
    h, w = old.shape
    o, n = ~np.isnan(old), ~np.isnan(new)
    full = lambda a: np.pad(a, 1)[:-2, 1:-1] & np.pad(a, 1)[2:, 1:-1] & np.pad(a, 1)[1:-1, :-2] & np.pad(a, 1)[1:-1, 2:]
    free = o & n & full(o) & full(n)
    out = np.where(~o, new, np.where(~n | ~full(n), old, new))
    at = {p: k for k, p in enumerate(zip(*np.nonzero(free), strict=True))}
    a, b = np.zeros((len(at), len(at))), np.zeros(len(at))
    for (y, x), k in at.items():
        a[k, k] = -4
        b[k] = -4 * new[y, x]
        for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            b[k] += new[q]
            if q in at:
                a[k, at[q]] = 1
            else:
                b[k] -= out[q]
    if at:
        for p, v in zip(at, np.linalg.solve(a, b), strict=True):
            out[p] = v
    return out


def laid(spark, grids, **options):
    parts = [(raster(spark, a), 0, 0) for a in grids]
    found = np.full(grids[0].shape, np.nan)
    for r in g.gradient_mosaic(parts, "v", **options).collect():
        found[r["y"], r["x"]] = r["v"]
    return found


@pytest.mark.parametrize("tile", [8, 64])
def test_equals_a_dense_solve(spark, tile):
    rng = np.random.default_rng(1)
    old, new = rng.normal(size=(26, 31)), rng.normal(size=(26, 31)) + 5
    old[:, 24:], new[:, :7] = np.nan, np.nan
    new[10:12, 15], old[20, 10:13] = np.nan, np.nan
    got = laid(spark, [old, new], threshold=1e-9, tile=tile, margin=4)
    assert np.allclose(got, dense(old, new), atol=1e-5, equal_nan=True)


def test_seams_vanish(spark):
    y, x = np.mgrid[:20, :40].astype(float)
    base = np.sin(y / 3) + np.cos(x / 5)
    old, new = base.copy(), base + 7 + 0.3 * x - 0.1 * y
    old[:, 30:], new[:, :10] = np.nan, np.nan
    new[0], new[-1], new[:, 30:] = np.nan, np.nan, np.nan
    got = laid(spark, [old, new], threshold=1e-10)
    assert np.allclose(got[:, :30], base[:, :30], atol=1e-6)


def test_no_overlap_and_none_free(spark):
    a, b = np.full((4, 4), np.nan), np.full((4, 4), np.nan)
    a[:, :2], b[:, 2:] = 1.0, 2.0
    assert (laid(spark, [a, b]) == np.where(np.isnan(a), 2.0, 1.0)).all()
    b[:, 1] = 3.0
    assert np.allclose(laid(spark, [a, b]), dense(a, b))
    assert np.isnan(laid(spark, [np.full((3, 3), np.nan), np.full((3, 3), np.nan)])).all()


def wave(y, x):
    return np.cos(2 * np.pi * 0.11 * y + 0.4) * np.sin(2 * np.pi * 0.07 * x + 0.2) + 0.5


@pytest.mark.parametrize("factor", [2, (3, 1), (Fraction(3, 2), Fraction(5, 4))])
def test_oversample(spark, factor):
    y, x = np.mgrid[:70, :50].astype(float)
    q = neighbourhood.oversample(raster(spark, wave(y, x)), "v", factor, tile=32)
    fy, fx = (Fraction(f) for f in (factor if isinstance(factor, tuple) else (factor, factor)))
    got = back(q)
    ky, kx = np.arange(q.height) / float(fy), np.arange(q.width) / float(fx)
    inner = np.ix_((ky > 12) & (ky < 58), (kx > 12) & (kx < 38))
    assert got.shape == (-(-70 * fy.numerator // fy.denominator), -(-50 * fx.numerator // fx.denominator)) and not np.isnan(got).any()
    assert np.abs(got - wave(ky[:, None], kx[None, :]))[inner].max() < 0.03
    whole = back(neighbourhood.oversample(raster(spark, wave(y, x)), "v", factor, tile=128))
    assert np.abs(got - whole)[inner].max() < 0.03


def test_oversample_with_a_missing_sample(spark):
    grid = np.ones((6, 8))
    grid[2, 3] = np.nan
    got = back(neighbourhood.oversample(raster(spark, grid), "v", 2))
    assert np.isnan(got).sum() == 4 and np.isnan(got[4:6, 6:8]).all() and np.allclose(got[~np.isnan(got)], 1.0)


def test_oversample_complex_with_a_centroid(spark):
    """A tone beyond half the sampling rate, seen from zero: only about its centroid it is put in the right place."""
    y, x = np.mgrid[:64, :32].astype(float)
    tone = np.exp(2j * np.pi * (0.62 * y + 0.05 * x))
    from pyspark.sql import functions as F

    p = raster(spark, tone.real).with_pixels(raster(spark, tone.real).pixels.join(raster(spark, tone.imag, "w").pixels, ["y", "x"]).withColumn("w", F.col("w")))
    q = neighbourhood.oversample(p, "v", (2, 1), "w", [0.6])
    got = back(q, "v") + 1j * back(q, "w")
    ky = np.arange(128) / 2
    wanted = np.exp(2j * np.pi * (0.62 * ky[:, None] + 0.05 * np.arange(32)[None, :]))
    assert np.abs(got - wanted)[24:104, :].max() < 0.05
