"""Tie-point grids: coarse grids of angles, times and places over a raster.

A grid is a table of its own (row, col, v), as small as the raster is large in
steps, and its fits are sums over that table: three moments a row for a quadratic
along each row, 21 sums for a biquadratic over the grid. Values at image places
come by one equi-join on the four points around, or on the row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TiePoints:
    """points has row and col (from 0) and v. The point (0, 0) lies at the image place (offset_x, offset_y), its neighbours step_x and step_y away; pixel centres lie at .5. discontinuity: 0, or 180 or 360 for angles that leap there."""

    points: DataFrame
    rows: int
    cols: int
    offset_x: float = 0.0
    offset_y: float = 0.0
    step_x: float = 1.0
    step_y: float = 1.0
    discontinuity: int = 0

    def __post_init__(self):
        if self.discontinuity not in (0, 180, 360):
            raise ValueError("a discontinuity is at 180 or 360 degrees")
        if self.step_x <= 0 or self.step_y <= 0:
            raise ValueError("steps are larger than 0")


def tie_points(spark, values: list[list[float]], offset: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (1.0, 1.0), discontinuity: int = 0) -> TiePoints:
    """A grid from rows of numbers; offset and step as (x, y)."""
    rows = [(r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
    return TiePoints(spark.createDataFrame(rows, "row long, col long, v double"), len(values), len(values[0]), *offset, *step, discontinuity)


def angle_discontinuity(t: TiePoints) -> int:
    """360 if the grid has an angle over 180, else 180."""
    return 360 if (t.points.agg(F.max("v")).first()[0] or 0) > 180 else 180


def _cells(t: TiePoints, **values: Column) -> DataFrame:
    """(_row, _col) of each cell with the values at its corners: <name>00, <name>01 (next column), <name>10 (next row), <name>11. A point belongs to four cells at most, so this is one aggregate."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    parts = t.points.select("row", "col", *[v.alias(n) for n, v in values.items()], corner.alias("at"))
    parts = parts.select((F.col("row") - F.col("at.i")).alias("_row"), (F.col("col") - F.col("at.j")).alias("_col"), "at", *values)
    pick = [F.max(F.when((F.col("at.i") == i) & (F.col("at.j") == j), F.col(n))).alias(f"{n}{i}{j}") for n in values for i in (0, 1) for j in (0, 1)]
    return parts.where(F.col("_row").between(0, t.rows - 2) & F.col("_col").between(0, t.cols - 2)).groupBy("_row", "_col").agg(*pick)


def _place(c: Column, offset: float, step: float, size: int) -> tuple[Column, Column]:
    """The cell along an axis and the weight of its far end; places outside are carried on from the cell at the border."""
    f = (c - offset) / step
    cell = F.greatest(F.lit(0), F.least(F.lit(max(size - 2, 0)), F.when(f >= 0, F.floor(f)).otherwise(F.ceil(f)))).cast("long")
    return cell, f - cell


def bilinear_at(t: TiePoints, df: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
    """df with the grid's value at image places (x, y), between its four points or carried on beyond the border; angles by their sines and cosines. Missing where x, y or a point is missing."""
    if t.rows < 2 or t.cols < 2:
        raise ValueError("a grid has two rows and columns at least")
    values = {"s": F.sin(F.radians("v")), "c": F.cos(F.radians("v"))} if t.discontinuity else {"s": F.col("v")}
    (col, wx), (row, wy) = _place(x, t.offset_x, t.step_x, t.cols), _place(y, t.offset_y, t.step_y, t.rows)
    asked = df.withColumns({"_col": col, "_row": row, "_wx": wx, "_wy": wy})
    between = lambda n: (F.col(f"{n}00") * (1 - F.col("_wx")) + F.col(f"{n}01") * F.col("_wx")) * (1 - F.col("_wy")) + (F.col(f"{n}10") * (1 - F.col("_wx")) + F.col(f"{n}11") * F.col("_wx")) * F.col("_wy")
    value = between("s")
    if t.discontinuity:
        value = F.degrees(F.atan2(value, between("c")))
        value = F.when((value < 0) & F.lit(t.discontinuity == 360), value + 360).otherwise(value)
    return asked.join(_cells(t, **values), ["_row", "_col"], "left").select(*[F.col(f"`{c}`") for c in df.columns], value.alias(name))


def _whole(offset: float, step: float, n: int) -> np.ndarray:
    """Places of n points along an axis, their fractions cut off."""
    return np.array([float(int(offset + k * step)) for k in range(n)])


def quadratic_fit(t: TiePoints) -> DataFrame:
    """For each row the least-squares c0 + c1 x + c2 x2 through its points (places without their fractions); missing points count as absent only if a whole row is. One aggregate of three moments a row."""
    place = _whole(t.offset_x, t.step_x, t.cols)
    middle, half = float(place.mean()), float(max(np.ptp(place) / 2, 1.0))
    u = (place - middle) / half  # centred: the normal equations stay well conditioned
    powers = np.stack([u**k for k in range(3)])
    inverse = np.linalg.inv(powers @ powers.T)
    at = (F.floor(t.offset_x + F.col("col") * t.step_x) if t.offset_x >= 0 else F.expr(f"cast({t.offset_x!r}D + col * {t.step_x!r}D as long)")) - middle
    at = at / half
    sums = t.points.groupBy("row").agg(*[F.sum(F.pow(at, F.lit(k)) * F.col("v")).alias(f"m{k}") for k in range(3)])
    b = [sum((float(inverse[i, k]) * F.col(f"m{k}") for k in range(3)), F.lit(0.0)) for i in range(3)]
    # c2 ((x - m) / h)^2 and so on, as powers of x
    c2, c1 = b[2] / half**2, b[1] / half - 2 * middle * b[2] / half**2
    return sums.select("row", (b[0] - b[1] * middle / half + b[2] * middle**2 / half**2).alias("c0"), c1.alias("c1"), c2.alias("c2"))


def quadratic_at(t: TiePoints, df: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
    """df with the quadratic of the grid row at or before y (the last one beyond the grid's end, the first one before it) at x."""
    row = F.expr("cast(null as long)") if t.rows == 0 else F.greatest(F.lit(0), F.least(F.lit(t.rows - 1), F.floor((y - t.offset_y) / t.step_y))).cast("long")
    asked = df.withColumns({"_row": row, "_x": x.cast("double")})
    value = F.col("c0") + F.col("c1") * F.col("_x") + F.col("c2") * F.col("_x") * F.col("_x")
    return asked.join(quadratic_fit(t).withColumnRenamed("row", "_row"), "_row", "left").select(*[F.col(f"`{c}`") for c in df.columns], value.alias(name))


def biquadratic_fit(t: TiePoints) -> list[float]:
    """Least-squares coefficients of 1, x, y, x2, xy, y2 over all points. As the fit is defined, places are those without the grid's offset and fractions; they are centred while the sums are taken."""
    xs, ys = _whole(0.0, t.step_x, t.cols), _whole(0.0, t.step_y, t.rows)
    (mx, hx), (my, hy) = ((float(p.mean()), float(max(np.ptp(p) / 2, 1.0))) for p in (xs, ys))
    u, w = (F.floor(F.col("col") * t.step_x) - mx) / hx, (F.floor(F.col("row") * t.step_y) - my) / hy
    terms = [F.lit(1.0), u, w, u * u, u * w, w * w]
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    there = t.points.where("v is not null")
    found = there.agg(*[F.sum(terms[i] * terms[j]).alias(f"a{i}{j}") for i, j in pairs], *[F.sum(terms[i] * F.col("v")).alias(f"b{i}") for i in range(6)]).first()
    a = np.zeros((6, 6))
    for i, j in pairs:
        a[i, j] = a[j, i] = found[f"a{i}{j}"] or 0.0
    k = np.linalg.lstsq(a, np.array([found[f"b{i}"] or 0.0 for i in range(6)]), rcond=None)[0]
    # From powers of (x - mx) / hx and (y - my) / hy to those of x and y.
    xx, xy, yy = k[3] / hx**2, k[4] / (hx * hy), k[5] / hy**2
    one = k[0] - k[1] * mx / hx - k[2] * my / hy + xx * mx**2 + xy * mx * my + yy * my**2
    return [float(c) for c in (one, k[1] / hx - 2 * xx * mx - xy * my, k[2] / hy - 2 * yy * my - xy * mx, xx, xy, yy)]


def biquadratic(coefficients: list[float], x: Column, y: Column) -> Column:
    c = coefficients
    return c[0] + c[1] * x + c[2] * y + c[3] * x * x + c[4] * x * y + c[5] * y * y


def over(t: TiePoints, height: int, width: int, name: str) -> DataFrame:
    """(y, x) of all pixels with the grid's value at their centres, made cell by cell from the grid itself, without a join of the raster."""
    values = {"s": F.sin(F.radians("v")), "c": F.cos(F.radians("v"))} if t.discontinuity else {"s": F.col("v")}

    def span(cell: str, offset: float, step: float, count: int, size: int) -> Column:
        """Pixels whose centre lies in a cell; the first and the last cell reach to the raster's border."""
        first = F.when(F.col(cell) == 0, F.lit(0)).otherwise(F.ceil(F.col(cell) * step + offset - 0.5))
        end = F.when(F.col(cell) == count - 2, F.lit(size - 1)).otherwise(F.ceil((F.col(cell) + 1) * step + offset - 0.5) - 1)
        first, end = (F.greatest(F.lit(0), F.least(F.lit(size), c)).cast("long") for c in (first, end))
        return F.when(first <= F.least(end, F.lit(size - 1)), F.sequence(first, F.least(end, F.lit(size - 1)).cast("long")))

    cells = _cells(t, **values).withColumn("y", F.explode(span("_row", t.offset_y, t.step_y, t.rows, height))).withColumn("x", F.explode(span("_col", t.offset_x, t.step_x, t.cols, width)))
    wx, wy = (F.col("x") + 0.5 - t.offset_x) / t.step_x - F.col("_col"), (F.col("y") + 0.5 - t.offset_y) / t.step_y - F.col("_row")
    between = lambda n: (F.col(f"{n}00") * (1 - wx) + F.col(f"{n}01") * wx) * (1 - wy) + (F.col(f"{n}10") * (1 - wx) + F.col(f"{n}11") * wx) * wy
    value = between("s")
    if t.discontinuity:
        value = F.degrees(F.atan2(value, between("c")))
        value = F.when((value < 0) & F.lit(t.discontinuity == 360), value + 360).otherwise(value)
    return cells.select("y", "x", value.alias(name))


def subset(t: TiePoints, x: int, y: int, width: int, height: int, step_x: int = 1, step_y: int = 1) -> TiePoints:
    """The grid of a sub-raster (first pixel, size, and steps of sub-sampling): points before the region are left out, two more than fit are kept, and the offset moves along."""

    def along(offset: float, step: float, count: int, start: int, size: int, every: int) -> tuple[float, float, int, int]:
        new_step = step / every
        moved = (offset - 0.5 - start) / every + 0.5
        new_offset = math.fmod(moved, new_step)
        first = max(0, math.floor((new_offset - moved) / new_step + 0.5))
        return new_offset, new_step, first, max(0, min(math.ceil(size / step) + 2, count - first))

    ox, sx, first_col, cols = along(t.offset_x, t.step_x, t.cols, x, width, step_x)
    oy, sy, first_row, rows = along(t.offset_y, t.step_y, t.rows, y, height, step_y)
    inside = t.points.where(F.col("row").between(first_row, first_row + rows - 1) & F.col("col").between(first_col, first_col + cols - 1))
    points = inside.select((F.col("row") - first_row).alias("row"), (F.col("col") - first_col).alias("col"), "v")
    return replace(t, points=points, rows=rows, cols=cols, offset_x=ox, offset_y=oy, step_x=sx, step_y=sy)
