"""Remote-sensing formulas, a quantiser and lookup tables, as Columns."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .band_math import clip

# Gravity, weight of air, the constant of visibility, and the radius used by the view correction.
GRAVITY, AIR, KOSCHMIEDER, RADIUS = 9.80665, 1.26895, 3.92 * 2, 6370997.0


def reflectance(radiance: Column, sun_zenith: Column, irradiance: float) -> Column:
    return radiance * math.pi / (irradiance * F.cos(F.radians(sun_zenith)))


def elevation_of_zenith(zenith: Column) -> Column:
    """And the zenith of an elevation."""
    return 90 - zenith


def pressure_at(sea_pressure: Column, height: Column) -> Column:
    return sea_pressure * F.exp(-GRAVITY * AIR * 1e-2 * height / sea_pressure)


def koschmieder(visibility: Column) -> Column:
    """Optical depth of a visibility, and the other way round; missing for 0."""
    return KOSCHMIEDER / F.when(visibility != 0, visibility)


def view_corrected(lat: Column, lon: Column, height: Column, view_zenith: Column, view_azimuth: Column) -> tuple[Column, Column]:
    """Position of a point at a height that is seen at an angle."""
    shift, way = height * F.tan(F.radians(view_zenith)), F.radians(view_azimuth)
    return lat + F.degrees(shift * F.cos(way) / RADIUS), lon + F.degrees(shift * F.sin(way) / (RADIUS * F.cos(F.radians(lat))))


def quantise(value: Column, low: float, high: float, levels: int = 256) -> Column:
    """Level of equal steps from low to high; what lies outside gets the end's level, what is missing none."""
    return clip(F.floor((value - low) / (high - low) * levels), 0, levels - 1).cast("int")


def _cell(axis: list[float], at: Column) -> tuple[Column, Column]:
    """Index of the axis' cell that holds `at` (from 0, ends clipped), and the share of the cell before it."""
    last = len(axis) - 2
    knots = F.array(*[F.lit(float(a)) for a in axis])
    v = clip(at.cast("double"), float(axis[0]), float(axis[-1]))
    i = F.when(v.isNotNull(), F.least(F.lit(last), F.greatest(F.lit(0), F.size(F.filter(knots, lambda a: a <= v)) - 1)))
    low, high = F.get(knots, i), F.get(knots, i + 1)
    return i, (v - low) / (high - low)


def lookup(axes: list[list[float]], values: list[float], *at: Column) -> Column:
    """Multilinear interpolation in a table of any number of axes (growing, two knots or more each); values in row-major order, a literal of the plan."""
    table = F.array(*[F.lit(float(v)) for v in values])
    cells = [_cell(a, c) for a, c in zip(axes, at, strict=True)]
    steps = [math.prod(len(a) for a in axes[k + 1 :]) for k in range(len(axes))]
    total = F.lit(0.0)
    for corner in itertools.product((0, 1), repeat=len(axes)):
        place, weight = F.lit(0), F.lit(1.0)
        for (i, share), step, c in zip(cells, steps, corner, strict=True):
            place = place + (i + c) * step
            weight = weight * (share if c else 1 - share)
        total = total + weight * F.get(table, place)
    return total


def polynomial_surface(x: Column, y: Column, coefficients: list[float]) -> Column:
    """Sum of coefficients times 1, x, y, x2, xy, y2, x3, ... as far as given."""
    total, k, degree = F.lit(0.0), 0, 0
    while k < len(coefficients):
        for j in range(degree + 1):
            if k < len(coefficients):
                total = total + float(coefficients[k]) * F.pow(x, F.lit(degree - j)) * F.pow(y, F.lit(j))
                k += 1
        degree += 1
    return total


def lookup_joined(df: DataFrame, table: DataFrame, axes: dict[str, list[float]], value: str, at: dict[str, Column], name: str) -> DataFrame:
    """df with multilinear interpolation in a table that is too large for a plan: rows of knots by number (<axis>, from 0) and a value.

    axes: the knots of each axis, growing; at: the place on each. The table's rows
    are gathered into cells with their corners, one aggregate, and a row of df joins
    its cell. Places outside are those at the end; missing where a place, or a corner
    of the cell, is.
    """
    names = list(axes)
    corners = list(itertools.product((0, 1), repeat=len(names)))
    sent = table.select(*names, F.col(value).cast("double").alias("_v"), F.posexplode(F.array(*[F.lit(k) for k in range(len(corners))])).alias("_corner", "_k"))
    for i, n in enumerate(names):
        step = F.array(*[F.lit(c[i]) for c in corners])
        sent = sent.withColumn(f"_at_{n}", F.col(n) - F.get(step, F.col("_corner")))
    inside = [F.col(f"_at_{n}").between(0, len(axes[n]) - 2) for n in names]
    for keep in inside:
        sent = sent.where(keep)
    cells = sent.groupBy(*[f"_at_{n}" for n in names]).agg(*[F.max(F.when(F.col("_corner") == k, F.col("_v"))).alias(f"_v{k}") for k in range(len(corners))])
    places = {n: _cell(axes[n], at[n]) for n in names}
    asked = df.withColumns({f"_at_{n}": places[n][0].cast("long") for n in names} | {f"_share_{n}": places[n][1] for n in names})
    total = F.lit(0.0)
    for k, c in enumerate(corners):
        weight = F.lit(1.0)
        for n, far in zip(names, c, strict=True):
            weight = weight * (F.col(f"_share_{n}") if far else 1 - F.col(f"_share_{n}"))
        total = total + weight * F.col(f"_v{k}")
    found = asked.join(cells.select(*[F.col(f"_at_{n}").cast("long").alias(f"_at_{n}") for n in names], *[f"_v{k}" for k in range(len(corners))]), [f"_at_{n}" for n in names], "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], total.alias(name))
