"""Two-dimensional windows.

Sums and means are separable: a window along each line, then one along each
column, both inside code generation. What needs whole neighbourhoods works on
tiles with a margin: a pixel goes to its tile and to the neighbours whose margin
holds it, so no task ever holds more than a tile, however large the raster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..product import Product
from ..session import ship

TILE = 256


def _run(value: Column, line: str | list[str], along: str, h: int, size: int, edge: bool) -> Column:
    """Sum of what is present among 2h+1 neighbours along an axis; beyond the border the edge's value is repeated, or nothing is added."""
    by = Window.partitionBy(line).orderBy(along)
    total = F.sum(value).over(by.rangeBetween(-h, h))
    if not edge:
        return F.coalesce(total, F.lit(0.0))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.greatest(F.lit(0), h - F.col(along)), F.greatest(F.lit(0), F.col(along) + h - (size - 1))
    return F.coalesce(total, F.lit(0.0)) + before * F.coalesce(F.first(value).over(whole), F.lit(0.0)) + after * F.coalesce(F.last(value).over(whole), F.lit(0.0))


BAND = 4096  # lines whose columns are summed in one window, besides a margin


def box_sums(p: Product, values: dict[str, tuple[Column, int]], edge: bool = True) -> DataFrame:
    """p's pixels with sums over boxes: each value with its half size h, for (2h+1)x(2h+1) neighbours.

    Missing samples add nothing. All sums along lines are taken in one pass, then
    all along columns, so there are two shuffles however many sums are asked for.
    Columns are cut to bands of lines with a margin, so a window never holds a tall
    raster's column. With edge, every line has its first and last pixel, and border
    values are repeated.
    """
    df = p.pixels.withColumns({f"_{n}": v.cast("double") for n, (v, _) in values.items()})
    df = df.withColumns({f"_{n}": _run(F.col(f"_{n}"), "y", "x", h, p.width, edge) for n, (_, h) in values.items()})
    most = max((h for _, h in values.values()), default=0)
    lines = max(BAND, 4 * most)
    if p.height > lines:  # a band's margin holds all that its sums need, its first and last lines the raster's border
        last = (p.height - 1) // lines
        band = lambda c: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(c / lines)))
        df = df.withColumn("_band", F.explode(F.sequence(band(F.col("y") - most), band(F.col("y") + most))))
        df = df.withColumns({n: _run(F.col(f"_{n}"), ["x", "_band"], "y", h, p.height, edge) for n, (_, h) in values.items()})
        df = df.where(F.col("_band") == F.floor(F.col("y") / lines)).drop("_band")
    else:
        df = df.withColumns({n: _run(F.col(f"_{n}"), "x", "y", h, p.height, edge) for n, (_, h) in values.items()})
    return df.drop(*[f"_{n}" for n in values])


def _present(c: Column) -> Column:
    return c.isNotNull().cast("double")


def box_mean(p: Product, band: str, h: int = 1) -> Product:
    """Mean of the samples present in each box; missing where there is none."""
    df = box_sums(p, {"s": (F.col(band), h), "n": (_present(F.col(band)), h)})
    return p.with_pixels(df.select("y", "x", (F.col("s") / F.when(F.col("n") > 0, F.col("n"))).alias(band)))


def _moments(p: Product, band: str, h: int) -> DataFrame:
    """Mean and sample variance of what is present in each box."""
    v = F.col(band).cast("double")
    df = box_sums(p, {"s": (v, h), "q": (v * v, h), "n": (_present(v), h)})
    n = F.when(F.col("n") > 0, F.col("n"))
    df = df.withColumn("mean", F.col("s") / n)
    spread = (F.col("q") - n * F.col("mean") * F.col("mean")) / F.when(n > 1, n - 1)
    return df.withColumn("var", F.when(n.isNotNull(), F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(0.0))))


def lee(p: Product, band: str, h: int = 1, enl: float = 1.0) -> Product:
    """Lee filter: the centre is weighted by 1 - cu2/ci2, where ci is the local and cu the speckle's coefficient of variation."""
    cu = 1 / math.sqrt(enl)
    ci = F.sqrt(F.col("var")) / F.when(F.col("mean") != 0, F.abs("mean"))
    w = 1 - cu * cu / (ci * ci)
    v = F.when(ci.isNull() | (ci <= cu), F.col("mean")).otherwise(F.col(band) * w + F.col("mean") * (1 - w))
    return p.with_pixels(_moments(p, band, h).select("y", "x", v.alias(band)))


def gamma_map(p: Product, band: str, h: int = 1, enl: float = 1.0) -> Product:
    """Gamma-MAP filter: mean in even areas, the maximum a posteriori root between, the centre in strong texture."""
    cu = 1 / math.sqrt(enl)
    top = math.sqrt(2) * cu
    mean, c = F.col("mean"), F.col(band).cast("double")
    ci = F.sqrt(F.col("var")) / F.when(mean != 0, F.abs(mean))
    alpha = (1 + cu * cu) / (ci * ci - cu * cu)
    b = alpha - enl - 1
    root = (b * mean + F.sqrt(F.greatest(mean * mean * b * b + 4 * alpha * enl * mean * c, F.lit(0.0)))) / (2 * alpha)
    v = F.when(ci.isNull() | (ci <= cu), mean).when(ci < top, root).otherwise(c)
    return p.with_pixels(_moments(p, band, h).select("y", "x", v.alias(band)))


def ring_detect(p: Product, band: str, target: int, guard: int, background: int, pfa: float = 1e-3) -> Product:
    """Constant false alarm rate detection: 1 where the target box's mean is over the mean plus t deviations of the ring between guard and background box. Boxes are half sizes; at the border they hold what is inside."""
    t = _normal_tail(pfa)
    v = F.col(band).cast("double")
    sizes = {"t": target, "g": guard, "b": background}
    df = box_sums(p, {f"{name}{k}": (c, h) for name, h in sizes.items() for k, c in enumerate((_present(v), v, v * v))}, edge=False)
    n = F.col("b0") - F.col("g0")
    mean = (F.col("b1") - F.col("g1")) / F.when(n > 0, n)
    sd = F.sqrt(F.greatest((F.col("b2") - F.col("g2")) / F.when(n > 0, n) - mean * mean, F.lit(0.0)))
    hit = F.coalesce(F.col("t1") / F.when(F.col("t0") > 0, F.col("t0")) > mean + t * sd, F.lit(False))
    return p.with_pixels(df.select("y", "x", band, hit.cast("int").alias("detected")))


def _normal_tail(pfa: float) -> float:
    """sqrt(2) erfinv(1 - 2 pfa), by bisection."""
    low, high = -10.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(mid / math.sqrt(2)) > pfa else (low, mid)
    return (low + high) / 2


def oil_spill(p: Product, band: str, h: int = 30, threshold_db: float = 2.0) -> Product:
    """1 where a pixel is darker than the local mean by the threshold; 0 where it is missing."""
    df = box_sums(p, {"s": (F.col(band), h), "n": (_present(F.col(band)), h)}, edge=False)
    dark = F.col(band) < F.col("s") / F.when(F.col("n") > 0, F.col("n")) / 10 ** (threshold_db / 10)
    return p.with_pixels(df.select("y", "x", band, F.coalesce(dark, F.lit(False)).cast("int").alias("detected")))


def fill_holes(p: Product, band: str) -> Product:
    """Missing pixels become the mean of the linear interpolations along line and column between the nearest valid neighbours; where one side lacks a neighbour that direction is left out."""

    def between(line: str, along: str) -> Column:
        def nearest(order: Column) -> Column:  # before the pixel in this order: a running value, so linear in the line's length
            by = Window.partitionBy(line).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            return F.last(F.when(F.col(band).isNotNull(), F.struct(F.col(along).alias("at"), F.col(band).cast("double").alias("v"))), True).over(by)

        a, b = nearest(F.col(along).asc()), nearest(F.col(along).desc())
        return a["v"] + (b["v"] - a["v"]) * (F.col(along) - a["at"]) / (b["at"] - a["at"])

    df = p.pixels.withColumn("_x", between("y", "x")).withColumn("_y", between("x", "y"))
    both = F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), (F.col("_x") + F.col("_y")) / 2).otherwise(F.coalesce("_x", "_y"))
    return p.with_pixels(df.select("y", "x", F.coalesce(F.col(band).cast("double"), both).alias(band)))


def multitemporal_speckle(p: Product, bands: list[str], h: int = 1) -> Product:
    """J_i = E[I_i] times the mean over k of I_k / E[I_k], E being the box mean. Missing samples take no part in either mean."""
    df = box_sums(p, {f"m_{b}": (F.col(b), h) for b in bands} | {f"n_{b}": (_present(F.col(b)), h) for b in bands})
    means = {b: F.col(f"m_{b}") / F.when(F.col(f"n_{b}") > 0, F.col(f"n_{b}")) for b in bands}
    shares = {b: F.when(means[b] != 0, F.col(b) / F.when(means[b] != 0, means[b])) for b in bands}
    there = sum((_present(F.col(b)) for b in bands), F.lit(0.0))
    ratio = sum((F.coalesce(c, F.lit(0.0)) for c in shares.values()), F.lit(0.0)) / F.when(there > 0, there)
    return p.with_pixels(df.select("y", "x", *[(means[b] * ratio).alias(b) for b in bands]))


def tiled(p: Product, band: str, h: int, work: Callable[[np.ndarray, bool], np.ndarray], tile: int = TILE, mode: str = "edge") -> Product:
    """work on tiles with a margin of h pixels; beyond the raster's border pixels follow `mode` of numpy.pad. work gets an array with the margin and gives one without. Missing samples are NaN in it, and missing results are null; every pixel of a tile comes back."""
    height, width = p.height, p.width
    near = lambda c, size: F.sequence(F.floor(F.greatest(F.col(c) - h, F.lit(0)) / tile), F.floor(F.least(F.col(c) + h, F.lit(size - 1)) / tile))
    rows = p.pixels.select("y", "x", F.col(band).cast("double").alias("v")).withColumn("ty", F.explode(near("y", height))).withColumn("tx", F.explode(near("x", width)))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(key[0]) * tile, int(key[1]) * tile
        y1, x1 = min(y0 + tile, height), min(x0 + tile, width)
        a, b, c, d = max(y0 - h, 0), max(x0 - h, 0), min(y1 + h, height), min(x1 + h, width)
        grid = np.full((c - a, d - b), np.nan)
        grid[pdf["y"].to_numpy() - a, pdf["x"].to_numpy() - b] = pdf["v"].to_numpy()
        pad = ((h - (y0 - a), h - (c - y1)), (h - (x0 - b), h - (d - x1)))
        grid = np.pad(grid, pad, mode=mode) if mode != "constant" else np.pad(grid, pad, constant_values=np.nan)
        out = work(grid)
        yy, xx = np.mgrid[y0:y1, x0:x1]
        return pd.DataFrame({"y": yy.ravel(), "x": xx.ravel(), band: out.ravel()})

    ship(rows.sparkSession)
    return p.with_pixels(rows.groupBy("ty", "tx").applyInPandas(run, f"y long, x long, `{band}` double"))


def _views(grid: np.ndarray, h: int) -> np.ndarray:
    """(height, width, neighbours) of each pixel's box."""
    n = 2 * h + 1
    v = np.lib.stride_tricks.sliding_window_view(grid, (n, n))
    return v.reshape(*v.shape[:2], n * n)


def _mean(v: np.ndarray) -> np.ndarray:
    """Mean of the samples present along the last axis; NaN if there is none."""
    n = (~np.isnan(v)).sum(axis=-1)
    return np.where(n > 0, np.nansum(v, axis=-1) / np.maximum(n, 1), np.nan)


def _variance(v: np.ndarray) -> np.ndarray:
    n = (~np.isnan(v)).sum(axis=-1)
    return np.where(n > 0, np.nansum((v - _mean(v)[..., None]) ** 2, axis=-1) / np.maximum(n - 1, 1), np.nan)


def _upper_median(v: np.ndarray) -> np.ndarray:
    n = (~np.isnan(v)).sum(axis=-1)
    return np.take_along_axis(np.sort(v, axis=-1), (n // 2)[..., None].clip(max=v.shape[-1] - 1), -1)[..., 0]


RANKS = {
    "min": lambda v: np.fmin.reduce(v, axis=2),
    "max": lambda v: np.fmax.reduce(v, axis=2),
    "mean": _mean,
    "median": _upper_median,
    "stddev": lambda v: np.sqrt(_variance(v)),
    "rms": lambda v: np.sqrt(_mean(v * v)),
}


def rank_filter(p: Product, band: str, kind: str, h: int = 1) -> Product:
    """min, max, mean, median (upper, of an even number), stddev or rms of the samples present in each box."""
    return tiled(p, band, h, lambda grid: RANKS[kind](_views(grid, h)))


# Kernels and their divisors. The origin of a kernel is its middle, or of an even size the last before it.
KERNELS = {
    "horizontal_edges": ([[-1, -1, -1], [2, 2, 2], [-1, -1, -1]], 1),
    "vertical_edges": ([[-1, 2, -1], [-1, 2, -1], [-1, 2, -1]], 1),
    "left_diagonal_edges": ([[2, -1, -1], [-1, 2, -1], [-1, -1, 2]], 1),
    "right_diagonal_edges": ([[-1, -1, 2], [-1, 2, -1], [2, -1, -1]], 1),
    "compass": ([[-1, 1, 1], [-1, -2, 1], [-1, 1, 1]], 1),
    "diagonal_compass": ([[1, 1, 1], [-1, -2, 1], [-1, -1, 1]], 1),
    "roberts_north_west": ([[1, 0], [0, -1]], 1),
    "roberts_north_east": ([[0, 1], [-1, 0]], 1),
    "sobel_north": ([[-1, -2, -1], [0, 0, 0], [1, 2, 1]], 1),
    "sobel_south": ([[1, 2, 1], [0, 0, 0], [-1, -2, -1]], 1),
    "sobel_west": ([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], 1),
    "sobel_east": ([[1, 0, -1], [2, 0, -2], [1, 0, -1]], 1),
    "sobel_north_east": ([[0, -1, -2], [1, 0, -1], [2, 1, 0]], 1),
    "average_3x3": ([[1] * 3] * 3, 9),
    "average_4x4": ([[1] * 4] * 4, 16),
    "average_5x5": ([[1] * 5] * 5, 25),
    "low_pass_3x3": ([[1, 2, 1], [2, 4, 2], [1, 2, 1]], 16),
    "low_pass_5x5": ([[1, 1, 1, 1, 1], [1, 4, 4, 4, 1], [1, 4, 12, 4, 1], [1, 4, 4, 4, 1], [1, 1, 1, 1, 1]], 60),
    "high_pass_3x3": ([[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]], 1),
    "sharpen_3x3": ([[0, -1, 0], [-1, 5, -1], [0, -1, 0]], 1),
    "high_pass_5x5": ([[0, -1, -1, -1, 0], [-1, 2, -4, 2, -1], [-1, -4, 13, -4, -1], [-1, 2, -4, 2, -1], [0, -1, -1, -1, 0]], 1),
    "laplace_3x3": ([[0, -1, 0], [-1, 4, -1], [0, -1, 0]], 1),
    "laplace_5x5": ([[1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 24, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1]], 1),
}


def read_kernel(spark, path: str) -> tuple[list[list[float]], float]:
    """A kernel from a text file: a line a row, numbers between spaces, commas or tabs; lines that begin with # are left out. The divisor is 1."""
    lines = [r[0].replace(",", " ").split() for r in spark.read.text(path).collect()]  # a kernel's few lines
    return [[float(v) for v in line] for line in lines if line and not line[0].startswith("#")], 1.0


def kernel_filter(p: Product, band: str, kernel: list[list[float]], divisor: float = 1.0) -> Product:
    """Correlation with a kernel, borders repeated. A missing neighbour counts as the mean of those present; a missing pixel stays missing."""
    given = np.array(kernel, float)
    up, left = (given.shape[0] - 1) // 2, (given.shape[1] - 1) // 2
    h = max(up, left, given.shape[0] - 1 - up, given.shape[1] - 1 - left)
    k = np.zeros((2 * h + 1, 2 * h + 1))
    k[h - up : h - up + given.shape[0], h - left : h - left + given.shape[1]] = given

    def work(grid: np.ndarray) -> np.ndarray:
        v = _views(grid, h)
        filled = np.where(np.isnan(v), _mean(v)[:, :, None], v)
        return np.where(np.isnan(v[:, :, v.shape[2] // 2]), np.nan, (filled * k.ravel()).sum(axis=2) / divisor)

    return tiled(p, band, h, work)


def frost(p: Product, band: str, h: int = 1, damping: float = 2.0) -> Product:
    """Mean of the samples present with weights exp(-k d), d the larger of both distances, k = damping var/mean2."""

    def work(grid: np.ndarray) -> np.ndarray:
        v = _views(grid, h)
        mean, var = _mean(v), _variance(v)
        k = damping * var / np.where(mean == 0, np.nan, mean * mean)
        a = np.abs(np.arange(-h, h + 1))
        w = np.exp(-np.nan_to_num(k)[:, :, None] * np.maximum(a[:, None], a[None, :]).ravel())
        there = np.where(np.isnan(v), 0.0, w).sum(axis=2)
        return np.where(there > 0, np.nansum(v * w, axis=2) / np.where(there > 0, there, 1), np.nan)

    return tiled(p, band, h, work)


def refined_lee(p: Product, band: str, edge_threshold: float = 5000.0) -> Product:
    """Local-statistics filter of 7x7 boxes, on half of the box where it crosses an edge.

    Boxes that reach beyond the border, or whose variance is under the threshold,
    use all their pixels. Otherwise the strongest difference of opposite 3x3
    areas gives the edge, and the half on the centre's side is used. Noise is the
    mean of five low normalised variances of the nine areas (the last whole area
    takes no part in their order). Where all pixels are equal the result is 0.
    """
    rows, columns = np.mgrid[0:7, 0:7]
    # Halves in the order right, upper right, top, upper left, then their opposites.
    halves = np.stack([columns >= 3, columns >= rows, rows <= 3, columns + rows <= 6, columns <= 3, columns <= rows, rows >= 3, columns + rows >= 6]).reshape(8, 49)
    # For each direction: the areas at its two ends, and the halves if the first or the second end is more like the middle.
    directions = [((1, 0), (1, 2), 4, 0), ((0, 2), (2, 0), 1, 5), ((0, 1), (2, 1), 2, 6), ((0, 0), (2, 2), 3, 7)]

    def noise(areas: np.ndarray) -> np.ndarray:
        """areas: (height, width, 9 areas, 9 pixels), missing beyond the border."""
        mean = areas.mean(axis=3)
        ratio = np.where(mean > 0, areas.var(axis=3, ddof=1) / np.where(mean > 0, mean * mean, 1), 0.0)
        whole = ~np.isnan(mean)
        count = whole.sum(axis=2)
        last = 8 - np.argmax(whole[:, :, ::-1], axis=2)
        is_last = np.arange(9) == last[:, :, None]
        head = np.sort(np.where(whole & ~is_last, ratio, np.inf), axis=2)
        tail = np.where(is_last & whole, ratio, 0.0).sum(axis=2)
        used = np.minimum(5, count)
        from_head = np.minimum(used, count - 1)
        total = np.where(np.arange(9) < from_head[:, :, None], head, 0.0).sum(axis=2) + np.where(used > from_head, tail, 0.0)
        return total / np.maximum(used, 1)

    def work(grid: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            v = _views(grid, 3)
            boxes = v.reshape(*v.shape[:2], 7, 7)
            areas = np.stack([boxes[:, :, a : a + 3, b : b + 3].reshape(*v.shape[:2], 9) for a in (0, 2, 4) for b in (0, 2, 4)], axis=2)
            means = areas.mean(axis=3).reshape(*v.shape[:2], 3, 3)
            middle = means[:, :, 1, 1]
            first = np.stack([means[:, :, a[0], a[1]] for a, _, _, _ in directions])
            second = np.stack([means[:, :, b[0], b[1]] for _, b, _, _ in directions])
            way = np.nan_to_num(np.abs(first - second)).argmax(axis=0)
            near_first = np.take_along_axis(np.abs(first - middle) < np.abs(middle - second), way[None], 0)[0]
            half = np.where(near_first, np.array([d[2] for d in directions])[way], np.array([d[3] for d in directions])[way])
            inside = ~np.isnan(v)
            count = inside.sum(axis=2)
            spread = _part_variance(v, inside)[1]
            edge = (count == 49) & (spread >= edge_threshold)
            mean, var = _part_variance(v, inside & (halves[half] | ~edge[:, :, None]))
            sigma = noise(areas)
            gain = np.maximum((var - mean * mean * sigma) / (1 + sigma), 0) / np.where(var > 0, var, 1)
            out = np.where(var == 0, 0.0, mean + gain * (v[:, :, 24] - mean))
            return np.where(inside[:, :, 24], out, np.nan)

    return tiled(p, band, 3, work, mode="constant")


def _part_variance(v: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample variance of part of each box."""
    n = part.sum(axis=2)
    mean = np.where(part, v, 0.0).sum(axis=2) / n
    return mean, np.where(part, (v - mean[:, :, None]) ** 2, 0.0).sum(axis=2) / (n - 1)


def transect(p: Product, band: str, points: DataFrame, h: int = 1) -> DataFrame:
    """Mean and sample deviation of the box around each point of a path (path_idx, y, x)."""
    around = points.withColumn("dy", F.explode(F.sequence(F.lit(-h), F.lit(h)))).withColumn("dx", F.explode(F.sequence(F.lit(-h), F.lit(h))))
    around = around.select("path_idx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return p.pixels.select("y", "x", F.col(band).cast("double").alias("v")).join(around, ["y", "x"]).groupBy("path_idx").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n"))


def line_points(corners: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(path_idx, y, x) of the pixels on a polyline through (x, y) corners."""
    out = []
    for (x1, y1), (x2, y2) in zip(corners, corners[1:], strict=False):
        n = max(abs(x2 - x1), abs(y2 - y1), 1)
        out += [(math.floor(y1 + (y2 - y1) * i / n + 0.5), math.floor(x1 + (x2 - x1) * i / n + 0.5)) for i in range(n)]
    out.append((corners[-1][1], corners[-1][0]))
    return [(i, y, x) for i, (y, x) in enumerate(out)]


def _finer(a: np.ndarray, up: int) -> np.ndarray:
    """Samples along the first axis `up` times as dense, the first one in place: the spectrum of the samples and their mirror image, which meet without a leap, filled up with zeros."""
    n = len(a)
    s = np.fft.fft(np.concatenate([a, a[::-1]]), axis=0)
    wide = np.zeros((2 * n * up, *a.shape[1:]), complex)
    wide[:n], wide[-n:] = s[:n], s[n:]
    if up > 1:
        wide[n] = wide[-n] = s[n] / 2
    return (np.fft.ifft(wide, axis=0) * up)[: n * up]


def oversample(p: Product, band: str, factor: int | tuple = 2, imaginary: str | None = None, centroid: list[float] | None = None, tile: int = TILE, margin: int | None = None) -> Product:
    """More samples by a longer spectrum, in tiles with a margin (half a tile if not given), so a task holds one tile and its result.

    factor: for both axes, or (lines, columns); whole numbers or fractions from 1 on.
    Sample k of the result lies at k / factor. With `imaginary`, band and
    imaginary are a complex pair; centroid gives the middle of its spectrum along a
    column, in cycles a line, as a polynomial of x: the spectrum is filled up half a
    band away from it. Towards a tile's rim the result leans on the mirrored margin;
    at the default it is within a thousandth of the whole raster's. A missing sample
    counts as the mean of its tile, and results next to it (those it is the nearest
    earlier sample of) are missing.
    """
    fy, fx = (Fraction(f).limit_denominator(64) for f in (factor if isinstance(factor, tuple) else (factor, factor)))
    if min(fy, fx) < 1:
        raise ValueError("factors are 1 or more")
    h, height, width = tile // 2 if margin is None else margin, p.height, p.width
    names = [band] if imaginary is None else [band, imaginary]
    new = lambda at, f: -(-at * f.numerator // f.denominator)  # the first sample at or after a source place
    near = lambda c, size: F.sequence(F.floor(F.greatest(F.col(c) - h, F.lit(0)) / tile), F.floor(F.least(F.col(c) + h, F.lit(size - 1)) / tile))
    rows = p.pixels.select("y", "x", *[F.col(b).cast("double").alias(f"v{k}") for k, b in enumerate(names)]).withColumn("ty", F.explode(near("y", height))).withColumn("tx", F.explode(near("x", width)))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(key[0]) * tile, int(key[1]) * tile
        y1, x1 = min(y0 + tile, height), min(x0 + tile, width)
        a, b, c, d = max(y0 - h, 0), max(x0 - h, 0), min(y1 + h, height), min(x1 + h, width)
        grid = np.full((c - a, d - b), np.nan, complex)
        v = pdf["v0"].to_numpy() + (1j * pdf["v1"].to_numpy() if imaginary is not None else 0)
        grid[pdf["y"].to_numpy() - a, pdf["x"].to_numpy() - b] = v
        gone = np.isnan(grid)
        grid[gone] = grid[~gone].mean() if not gone.all() else 0
        yy, xx = np.arange(new(y0, fy), new(y1, fy)), np.arange(new(x0, fx), new(x1, fx))
        shift = 0.0 if centroid is None else np.polyval(centroid[::-1], np.arange(b, d))
        grid = grid * np.exp(-2j * np.pi * shift * np.arange(a, c)[:, None])
        tall = _at(grid, fy, a, yy)
        tall = tall * np.exp(2j * np.pi * shift * np.array([float(k / fy) for k in yy])[:, None])
        out = _at(tall.T, fx, b, xx).T
        lost = gone[np.ix_([int(k / fy) - a for k in yy], [int(k / fx) - b for k in xx])]
        out[lost] = np.nan
        ky, kx = np.repeat(yy, len(xx)), np.tile(xx, len(yy))
        parts = [out.real.ravel()] if imaginary is None else [out.real.ravel(), out.imag.ravel()]
        return pd.DataFrame({"y": ky, "x": kx} | dict(zip(names, parts, strict=True)))

    ship(p.pixels.sparkSession)
    out = rows.groupBy("ty", "tx").applyInPandas(run, "y long, x long, " + ", ".join(f"`{b}` double" for b in names))
    return p.with_pixels(out, height=new(height, fy), width=new(width, fx))


def _at(a: np.ndarray, ratio: Fraction, origin: int, wanted: np.ndarray) -> np.ndarray:
    """Finer samples with the given numbers of a window whose first line is `origin`."""
    return _finer(a, ratio.numerator)[wanted * ratio.denominator - origin * ratio.numerator]
