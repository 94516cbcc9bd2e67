"""Coregistration, wind and terrain: operators whose work per point is numeric and bounded, dealt by Spark one group a point or cell."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..product import Product
from ..session import materialize, ship
from .joins import resample


HALF_LIGHT = 299_792_458.0 / 2  # metres a second, there and back


def _around(p: Product, band: str, points: DataFrame, half: int, y: str, x: str, name: str) -> DataFrame:
    """Pixels within half a window of each point: point_id, dy, dx and the band. The points' windows are cut into pixels, which join the raster by place."""
    steps = F.sequence(F.lit(-half), F.lit(half - 1))
    asked = points.select("point_id", F.col(y).alias("cy"), F.col(x).alias("cx")).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    asked = asked.select("point_id", "dy", "dx", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"))
    return asked.join(p.pixels.select("y", "x", F.col(band).cast("double").alias(name)), ["y", "x"]).select("point_id", "dy", "dx", name)


def correlate(master: np.ndarray, slave: np.ndarray, up: int = 4) -> tuple[float, float, float]:
    """Shift (dy, dx) of the slave against the master, by the peak of their zero-padded cross-spectrum, and the peak over the mean."""
    m, s = np.fft.fft2(master - master.mean()), np.fft.fft2(slave - slave.mean())
    cross = np.fft.fftshift(np.conj(m) * s)
    h, w = cross.shape
    wide = np.zeros((h * up, w * up), complex)
    a, b = (h * up - h) // 2, (w * up - w) // 2
    wide[a : a + h, b : b + w] = cross
    peak = np.abs(np.fft.ifft2(np.fft.ifftshift(wide)))
    at = np.unravel_index(peak.argmax(), peak.shape)
    wrap = lambda i, n: (i - n if i > n // 2 else i) / up
    return wrap(at[0], h * up), wrap(at[1], w * up), float(peak.max() / max(peak.mean(), 1e-300))


def ground_control_points(master: Product, slave: Product, band: str, points: DataFrame, half: int = 16, quality: float = 2.0, up: int = 4, rounds: int = 2) -> DataFrame:
    """For points (point_id, y, x) of the master the matching place (sy, sx) in the slave, found by cross-correlation of windows, each round around the last place. Points near the border, or with a low peak, are left out."""
    ship(points.sparkSession)
    found = points.select("point_id", "y", "x", F.col("y").cast("double").alias("sy"), F.col("x").cast("double").alias("sx"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = 2 * half
        if len(pdf) < n * n:
            return pd.DataFrame({"point_id": [], "my": [], "mx": [], "peak": []})
        pdf = pdf.sort_values(["dy", "dx"])
        dy, dx, peak = correlate(pdf["m"].to_numpy().reshape(n, n), pdf["s"].to_numpy().reshape(n, n), up)
        return pd.DataFrame({"point_id": [pdf["point_id"].iloc[0]], "my": [dy], "mx": [dx], "peak": [peak]})

    for _ in range(rounds):
        spot = found.select("point_id", "y", "x", F.floor(F.col("sy") + 0.5).cast("long").alias("ry"), F.floor(F.col("sx") + 0.5).cast("long").alias("rx"))
        windows = _around(master, band, spot, half, "y", "x", "m").join(_around(slave, band, spot, half, "ry", "rx", "s"), ["point_id", "dy", "dx"])
        moved = windows.groupBy("point_id").applyInPandas(run, "point_id long, my double, mx double, peak double").where(F.col("peak") > quality)
        found = spot.join(moved, "point_id").select("point_id", "y", "x", (F.col("ry") + F.col("my")).alias("sy"), (F.col("rx") + F.col("mx")).alias("sx"))
    return found


RIM = 8  # pixels around the slave's window, so that a shifted window has no trace of the spectrum's wrapping round


def shifted_coherence(master: np.ndarray, slave: np.ndarray, dy: np.ndarray, dx: np.ndarray, box: int | None = None) -> np.ndarray:
    """Coherence of a complex window (n, m) with the slave (RIM more pixels on each side) read dy lines and dx columns further on, for all pairs (len(dy), len(dx)). With box, the mean over all boxes of that size inside the window."""
    n, m = master.shape
    ky, kx = np.fft.fftfreq(slave.shape[0])[:, None], np.fft.fftfreq(slave.shape[1])[None, :]
    a, b = (c.ravel()[:, None, None] for c in np.meshgrid(dy, dx, indexing="ij"))
    moved = np.fft.ifft2(np.fft.fft2(slave) * np.exp(2j * np.pi * (ky * a + kx * b)))[:, RIM : RIM + n, RIM : RIM + m]

    def sums(v: np.ndarray) -> np.ndarray:
        if box is None:
            return v.sum(axis=(-2, -1))[..., None, None]
        c = np.cumsum(np.cumsum(np.pad(v, [(0, 0)] * (v.ndim - 2) + [(1, 0), (1, 0)]), axis=-2), axis=-1)
        return c[..., box:, box:] - c[..., :-box, box:] - c[..., box:, :-box] + c[..., :-box, :-box]

    power = np.sqrt(sums(np.abs(master) ** 2) * sums(np.abs(moved) ** 2))
    found = np.divide(np.abs(sums(np.conj(master) * moved)), power, out=np.zeros(power.shape), where=power > 0)
    return found.mean(axis=(-2, -1)).reshape(len(dy), len(dx))


def fine_shift(master: np.ndarray, slave: np.ndarray, start: tuple[float, float], box: int | None = None, rounds: int = 5) -> tuple[float, float, float]:
    """The shift (dy, dx) within half a pixel of start with the greatest coherence, and that coherence: a grid of tenths of a pixel, then ever finer ones around the best so far."""
    best, step = start, 0.1
    bound = [(c - 0.5, c + 0.5) for c in start]
    value = -1.0
    for k in range(rounds):
        side = np.arange(-5, 6) if k == 0 else np.arange(-2, 3)
        dy, dx = (np.clip(best[i] + step * side, *bound[i]) for i in (0, 1))
        found = shifted_coherence(master, slave, dy, dx, box)
        at = np.unravel_index(found.argmax(), found.shape)
        best, value = (float(dy[at[0]]), float(dx[at[1]])), float(found[at])
        step /= 3
    return *best, value


def fine_control_points(master: Product, slave: Product, bands: tuple[str, str], points: DataFrame, window: int = 32, threshold: float = 0.6, box: int | None = None) -> DataFrame:
    """Points (point_id, y, x of the master, sy and sx in the slave) with sy and sx to a fraction of a pixel, and their coherence.

    Around each point both complex rasters are cut to windows; the slave's place is
    moved by up to half a pixel to where the windows are most coherent (with box,
    where boxes of that size are on average). Points with less than the threshold, or
    with a pixel of a window missing (of the slave's with a rim of RIM), are left out.
    A window is a group of its own.
    """
    ship(points.sparkSession)
    half, (i, q) = window // 2, bands
    spot = points.select("point_id", "y", "x", "sy", "sx", F.floor("y").cast("long").alias("my"), F.floor("x").cast("long").alias("mx"), F.floor(F.col("sy") + 0.5).cast("long").alias("ry"), F.floor(F.col("sx") + 0.5).cast("long").alias("rx"))
    spot = materialize(spot, "coarse-points")

    def cut(p: Product, y: str, x: str, names: tuple[str, str], rim: int) -> DataFrame:
        steps = F.sequence(F.lit(1 - half - rim), F.lit(half + rim))
        asked = spot.select("point_id", F.col(y).alias("cy"), F.col(x).alias("cx")).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
        asked = asked.select("point_id", "dy", "dx", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"))
        there = p.pixels.select("y", "x", F.col(i).cast("double").alias(names[0]), F.col(q).cast("double").alias(names[1])).dropna()
        return asked.join(there, ["y", "x"]).select("point_id", "dy", "dx", *names)

    both = cut(slave, "ry", "rx", ("si", "sq"), RIM).join(cut(master, "my", "mx", ("mi", "mq"), 0), ["point_id", "dy", "dx"], "left")
    both = both.join(spot.select("point_id", (F.col("sy") - F.col("ry")).alias("oy"), (F.col("sx") - F.col("rx")).alias("ox")), "point_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = window + 2 * RIM
        if len(pdf) < wide * wide or pdf["mi"].notna().sum() < window * window:
            return pd.DataFrame({"point_id": [], "oy": [], "ox": [], "coherence": []})
        pdf = pdf.sort_values(["dy", "dx"])
        a, b = (pdf[f"{n}i"].to_numpy().reshape(wide, wide) + 1j * pdf[f"{n}q"].to_numpy().reshape(wide, wide) for n in "ms")
        a = a[RIM:-RIM, RIM:-RIM]
        dy, dx, value = fine_shift(a, b, (float(pdf["oy"].iloc[0]), float(pdf["ox"].iloc[0])), box)
        return pd.DataFrame({"point_id": [pdf["point_id"].iloc[0]], "oy": [dy], "ox": [dx], "coherence": [value]})

    found = both.groupBy("point_id").applyInPandas(run, "point_id long, oy double, ox double, coherence double").where(F.col("coherence") >= threshold)
    return spot.join(found, "point_id").select("point_id", "y", "x", (F.col("ry") + F.col("oy")).alias("sy"), (F.col("rx") + F.col("ox")).alias("sx"), "coherence")


def coherence(window: DataFrame, by: list[str], mi: str, mq: str, si: str, sq: str) -> DataFrame:
    """Magnitude of the complex correlation of two complex bands over the rows of each group."""
    re, im = F.col(mi) * F.col(si) + F.col(mq) * F.col(sq), F.col(mq) * F.col(si) - F.col(mi) * F.col(sq)
    power = F.sqrt(F.sum(F.col(mi) ** 2 + F.col(mq) ** 2) * F.sum(F.col(si) ** 2 + F.col(sq) ** 2))
    return window.groupBy(*by).agg((F.sqrt(F.sum(re) ** 2 + F.sum(im) ** 2) / F.when(power > 0, power)).alias("coherence"))


def warp_terms(points: np.ndarray, order: int, threshold: float = 1.0, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomials of (y, x) for sy and sx by least squares over points (y, x, sy, sx), a table of at most some thousand rows. Points with a large residual go, by mean plus deviation while the mean is over the threshold. Terms as in joins.warp."""
    y, x = points[:, 0], points[:, 1]
    terms = [np.ones_like(x), x, y, x * x, x * y, y * y, x**3, x * x * y, x * y * y, y**3][: {1: 3, 2: 6, 3: 10}[order]]
    basis, keep = np.stack(terms, axis=1), np.ones(len(points), bool)
    for i in range(rounds):
        if keep.sum() < max(3, basis.shape[1]):
            raise ValueError("too few control points")
        cx, cy = (np.linalg.lstsq(basis[keep], points[keep, c], rcond=None)[0] for c in (3, 2))
        rms = np.hypot(basis @ cx - points[:, 3], basis @ cy - points[:, 2])
        mean, sd = rms[keep].mean(), rms[keep].std()
        limit = mean + sd if mean > threshold else threshold
        bad = keep & (rms >= limit)
        if not bad.any() or i == rounds - 1:
            break
        keep &= ~bad
    return cx, cy, rms[keep]


def _terms(y: Column, x: Column, order: int) -> list[Column]:
    return [F.lit(1.0), x, y, x * x, x * y, y * y, x * x * x, x * x * y, x * y * y, y * y * y][: {1: 3, 2: 6, 3: 10}[order]]


def warp_fit(points: DataFrame, order: int, threshold: float = 1.0, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """What warp_terms() fits, for any number of points (y, x, sy, sx): each round is two aggregates, of the normal equations and of the residuals' mean and deviation, so the points stay where they are."""
    points = materialize(points.select(*[F.col(c).cast("double").alias(c) for c in ("y", "x", "sy", "sx")]), "control-points")
    scale = float(points.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1.0))).first()[0] or 1.0)
    terms = _terms(F.col("y") / scale, F.col("x") / scale, order)
    degree = np.array([0, 1, 1, 2, 2, 2, 3, 3, 3, 3][: len(terms)])
    keep = F.lit(True)
    for i in range(rounds):
        pairs = [(a, b) for a in range(len(terms)) for b in range(a, len(terms))]
        sums = [F.sum(terms[a] * terms[b]).alias(f"a{a}_{b}") for a, b in pairs] + [F.sum(t * F.col(c)).alias(f"{c}{a}") for a, t in enumerate(terms) for c in ("sx", "sy")]
        got = points.where(keep).agg(F.count("*").alias("n"), *sums).first()
        if got["n"] < max(3, len(terms)):
            raise ValueError("too few control points")
        normal = np.zeros((len(terms), len(terms)))
        for a, b in pairs:
            normal[a, b] = normal[b, a] = got[f"a{a}_{b}"]
        cx, cy = (np.linalg.lstsq(normal, np.array([got[f"{c}{a}"] for a in range(len(terms))]), rcond=None)[0] for c in ("sx", "sy"))
        gap = lambda k, c: sum((float(v) * t for v, t in zip(k, terms, strict=True)), F.lit(0.0)) - F.col(c)  # noqa: E731, B023
        rms = F.sqrt(F.pow(gap(cx, "sx"), 2) + F.pow(gap(cy, "sy"), 2))
        found = points.where(keep).agg(F.avg(rms).alias("m"), F.stddev_pop(rms).alias("d"), F.max(rms).alias("top")).first()
        limit = found["m"] + found["d"] if found["m"] > threshold else threshold
        if found["top"] < limit or i == rounds - 1:
            break
        keep = keep & (rms < limit)
    return cx / scale**degree, cy / scale**degree


def coregister(master: Product, slave: Product, band: str, points: DataFrame, order: int = 1, method: str = "cubic", **options) -> Product:
    """The slave's band on the master's pixels: control points, polynomial, resampling."""
    cx, cy = warp_fit(ground_control_points(master, slave, band, points, **options), order)
    terms = _terms(F.col("y").cast("double"), F.col("x").cast("double"), order)
    poly = lambda c: sum((float(k) * t for k, t in zip(c, terms, strict=True)), F.lit(0.5))
    return master.with_pixels(resample(slave, master.pixels.select("y", "x"), poly(cx), poly(cy), band, method))


def range_doppler(targets: DataFrame, states: list[tuple[float, tuple, tuple]], first_line: float, line_time: float, near_range: float, range_spacing: float, rounds: int = 40, bistatic: bool = False, sensor: bool = False) -> DataFrame:
    """targets (y, x and earth-centred tx, ty, tz in metres) with source coordinates u (range) and v (line) of a slant-range image.

    The time at which the target is abeam comes from bisection of the sign of
    (target - position) . velocity over the states (time, position, velocity; a
    few records an image), linear between them. Targets without a change of sign
    are left out. With bistatic, line times hold the signal's way there and back.
    With sensor, the position abeam comes along as px, py and pz.
    """
    times = np.array([s[0] for s in states], float)
    table = np.array([[*s[1], *s[2]] for s in states], float)

    def run(batches):
        for pdf in batches:
            t = pdf[["tx", "ty", "tz"]].to_numpy(float)
            state = lambda at: np.stack([np.interp(at, times, table[:, k]) for k in range(6)], axis=1)
            gap = lambda at: (lambda s: ((t - s[:, :3]) * s[:, 3:]).sum(axis=1))(state(at))
            low, high = np.full(len(t), times[0]), np.full(len(t), times[-1])
            first = gap(low) > 0
            good = first != (gap(high) > 0)
            for _ in range(rounds):
                mid = (low + high) / 2
                same = (gap(mid) > 0) == first
                low, high = np.where(same, mid, low), np.where(same, high, mid)
            at = (low + high) / 2
            place = state(at)[:, :3]
            slant = np.linalg.norm(t - place, axis=1)
            line = at + slant / HALF_LIGHT if bistatic else at
            out = pdf[["y", "x"]].assign(u=(slant - near_range) / range_spacing + 0.5, v=(line - first_line) / line_time + 0.5)
            yield (out.assign(px=place[:, 0], py=place[:, 1], pz=place[:, 2]) if sensor else out)[good]

    ship(targets.sparkSession)
    return targets.select("y", "x", "tx", "ty", "tz").mapInPandas(run, "y long, x long, u double, v double" + (", px double, py double, pz double" if sensor else ""))


def terrain_correction(image: Product, band: str, targets: DataFrame, height: int, width: int, method: str = "bilinear", **geometry) -> Product:
    """The image on a map grid: each target cell's line and range, then one resampling join."""
    places = range_doppler(targets, **geometry)
    return Product(resample(image, places, F.col("u"), F.col("v"), band, method), height, width, image.meta)


def wind_speed(nrcs: Column, direction_deg: Column, incidence_deg: Column) -> Column:
    """Speed in 0.1 ... 20 m/s whose modelled backscatter is nearest, by trying all steps of 0.1."""
    speeds = F.sequence(F.lit(1), F.lit(200))
    fits = F.transform(speeds, lambda k: F.struct(F.abs(backscatter(k / 10.0, direction_deg, incidence_deg) - nrcs).alias("gap"), (k / 10.0).alias("speed")))
    return F.array_min(fits)["speed"]


# Coefficients of the C-band model function CMOD5.
CMOD5 = [0.0, -0.688, -0.793, 0.338, -0.173, 0.0, 0.004, 0.111, 0.0162, 6.34, 2.57, -2.18, 0.4, -0.6, 0.045, 0.007, 0.33, 0.012, 22.0, 1.95, 3.0, 8.39, -3.44, 1.36, 5.35, 1.99, 0.29, 3.80, 1.53]


def backscatter(speed: Column, direction_deg: Column, incidence_deg: Column) -> Column:
    """Backscatter of a sea surface by the C-band model: wind speed, its direction against the look, incidence. After Hersbach, Stoffelen and de Haan (2007), An improved C-band scatterometer ocean geophysical model function: CMOD5."""
    c = CMOD5
    v = speed if isinstance(speed, Column) else F.lit(float(speed))
    tilt = (incidence_deg - 40) / 25
    tilt2 = tilt * tilt
    level, growth, bend = c[1] + c[2] * tilt + c[3] * tilt2 + c[4] * tilt * tilt2, c[5] + c[6] * tilt, c[7] + c[8] * tilt
    sharpness, knee = c[9] + c[10] * tilt + c[11] * tilt2, c[12] + c[13] * tilt
    scaled = bend * v
    at_knee = 1 / (1 + F.exp(-knee))
    weak = F.pow(F.when(knee != 0, F.least(scaled, knee) / F.when(knee != 0, knee)).otherwise(1.0), knee * (1 - at_knee)) * at_knee
    saturation = F.when(scaled < knee, weak).otherwise(1 / (1 + F.exp(-F.greatest(scaled, knee))))
    mean = F.pow(saturation, sharpness) * F.pow(F.lit(10.0), level + growth * v)
    upwind = (c[14] * (1 + tilt) - c[15] * v * (0.5 + tilt - _tanh(4 * (tilt + c[16] + c[17] * v)))) / (1 + F.exp(0.34 * (v - c[18])))
    unit, fall, rise = c[21] + c[22] * tilt + c[23] * tilt2, c[24] + c[25] * tilt + c[26] * tilt2, c[27] + c[28] * tilt
    relative = v / unit + 1
    start, slope = c[19] - (c[19] - 1) / c[20], 1 / (c[20] * (c[19] - 1) ** (c[20] - 1))
    relative = F.when(relative < c[19], start + slope * F.pow(F.when(relative > 1, relative - 1).otherwise(0.0), F.lit(c[20]))).otherwise(relative)
    crosswind = (-fall + rise * relative) * F.exp(-relative)
    turn = F.radians(direction_deg)
    return mean * F.pow(1 + upwind * F.cos(turn) + crosswind * F.cos(2 * turn), F.lit(1.6))


def _tanh(x: Column) -> Column:
    return 1 - 2 / (F.exp(2 * x) + 1)


FLATTEN = 11  # side of the mean that a window is divided by


def streak_direction(grid: np.ndarray, km: float = 20.0) -> tuple[float, float]:
    """The direction of a square window's streaks, in degrees from the lines counter-clockwise up to half a turn, and the ratio of the axes of their spectrum (1: no direction).

    The window is divided by its local mean; four spectra of two thirds of its size,
    at its corners, are averaged; of wavelengths from 2.5 to 15 km (the window is
    km wide) a median of three by three is taken; and a quadratic form is fitted to
    what is left under its peak. Streaks lie across the axis along which it is widest.
    """
    n = len(grid)
    h = FLATTEN // 2
    box = lambda a: sum(np.pad(a, h)[i : i + n, j : j + n] for i in range(2 * h + 1) for j in range(2 * h + 1))
    mean = box(grid) / box(np.ones((n, n)))
    flat = np.divide(grid, mean, out=np.ones((n, n)), where=mean != 0)
    size = n * 2 // 3 | 1
    corners = [flat[a : a + size, b : b + size] for a in (0, n - size) for b in (0, n - size)]
    power = np.mean([np.abs(np.fft.fftshift(np.fft.fft2(c))) ** 2 for c in corners], axis=0)
    wave = 2 * math.pi * km * 1000 * 2 / 3  # of a wavelength in metres: so many waves in a spectrum's window
    outer, inner = min(int(wave / 2500), size // 2), int(wave / 15_000)
    inner = 1 if inner >= size // 2 else inner
    middle = size // 2
    part = power[middle - outer : middle + outer + 1, middle - outer : middle + outer + 1].copy()
    part[outer - inner : outer + inner + 1, outer - inner : outer + inner + 1] = 0
    v = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(part, 1, mode="edge"), (3, 3)), axis=(2, 3))
    y, x = np.mgrid[-outer : outer + 1, -outer : outer + 1].astype(float)
    terms = np.stack([(x * x).ravel(), (y * y).ravel(), (x * y).ravel()], axis=1)
    c = np.linalg.lstsq(terms, (v - v.max()).ravel(), rcond=None)[0]
    values, axes = np.linalg.eigh(np.array([[c[0], -c[2] / 2], [-c[2] / 2, c[1]]]))  # y upwards
    steep = axes[:, np.abs(values).argmax()]  # across the widest extent
    ratio = float(np.abs(values).min() / np.abs(values).max()) if np.abs(values).max() > 0 else 1.0
    return math.degrees(math.atan2(steep[1], steep[0])) % 180, ratio


def wind_field(p: Product, band: str, incidence_deg: float, window: int, land: Column | None = None, km: float = 20.0, in_db: bool = False, hh: bool = False) -> DataFrame:
    """Per window cell its centre's backscatter, the direction of its streaks and the ratio of their spectrum's axes, as streak_direction() gives them, and the wind speed.

    km is a window's width. Backscatter may be given in decibels; that of HH is taken
    to VV. Pixels on land or missing count as the mean of the others; cells with half
    of their pixels such, or not whole, are left out.
    """
    keep = F.lit(True) if land is None else ~land
    v = F.col(band).cast("double")
    v = F.pow(F.lit(10.0), v / 10) if in_db else v
    tan2 = math.tan(math.radians(incidence_deg)) ** 2
    factor = ((1 + 2 * tan2) / (1 + tan2)) ** 2 if hh else 1.0
    rows = p.pixels.select(F.floor(F.col("y") / window).cast("long").alias("cy"), F.floor(F.col("x") / window).cast("long").alias("cx"), "y", "x", F.when(keep, v).alias("v"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["y", "x"])["v"].to_numpy(float)
        bad = np.isnan(v)
        if len(v) < window * window or bad.sum() * 2 >= len(v):
            return pd.DataFrame({"cy": [], "cx": [], "nrcs": [], "direction": [], "ratio": []})
        grid = np.where(bad, v[~bad].mean(), v).reshape(window, window)
        angle, ratio = streak_direction(grid, km)
        return pd.DataFrame({"cy": [int(key[0])], "cx": [int(key[1])], "nrcs": [factor * grid[window // 2, window // 2]], "direction": [angle], "ratio": [ratio]})

    ship(rows.sparkSession)
    cells = rows.groupBy("cy", "cx").applyInPandas(run, "cy long, cx long, nrcs double, direction double, ratio double")
    return cells.withColumn("speed", wind_speed(F.col("nrcs"), F.col("direction"), F.lit(float(incidence_deg))))
