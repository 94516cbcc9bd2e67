"""Mosaics in the gradient domain: a later raster keeps its differences and takes its level from what lies around it.

Where two rasters overlap, the sought value is the new sample plus a correction
whose discrete Laplacian is zero and which at the overlap's border is what the
border's pixels differ by. The correction is smooth, so it is first solved on
ever coarser grids, the coarsest in one tile, and each finer grid begins with the
coarser one's result. A grid is solved by tiles with wide margins: each round,
all tiles relax their window in red and black sweeps and exchange what they found,
until no pixel moves by more than the threshold. The fixed point is that of the
whole overlap, whatever the tiles. In a narrow overlap what lies a few widths away
has no influence: it needs no coarse grids, its tiles are as wide as it, with margins
of some widths, and are solved by elimination, so about three rounds do, however long it is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..product import Product
from ..session import materialize, ship

TILE, MARGIN = 256, 64
REACH = 8  # widths of a narrow overlap, over which an influence falls to exp(-8 pi), 1e-11
GUESS = 3  # rounds on a coarse grid, whose result is only where the finer one begins


def relax(e: np.ndarray, free: np.ndarray, threshold: float, sweeps: int = 20_000) -> np.ndarray:
    """e with its free cells at the mean of their four neighbours, by over-relaxed sweeps over the red, then the black cells. Free cells lie inside, and their neighbours are all given."""
    e = e.copy()
    rows, cols = np.nonzero(free)
    if not len(rows):
        return e
    size = max(np.ptp(rows), np.ptp(cols)) + 2
    w = 2 / (1 + math.sin(math.pi / size))
    wide, flat = e.shape[1], e.ravel()
    at = rows * wide + cols
    parts = [at[(rows + cols) % 2 == k] for k in (0, 1)]
    for _ in range(sweeps):
        moved = 0.0
        for p in parts:
            if len(p):
                step = w * ((flat[p - 1] + flat[p + 1] + flat[p - wide] + flat[p + wide]) / 4 - flat[p])
                flat[p] += step
                moved = max(moved, float(np.abs(step).max()))
        if moved < threshold:
            break
    return e


def solve(e: np.ndarray, free: np.ndarray) -> np.ndarray:
    """As relax(), but exactly: lines along the window's long side are eliminated one after the other. Its work grows with the long side times the cube of the short one."""
    if np.ptp(np.nonzero(free.any(axis=1))[0]) < np.ptp(np.nonzero(free.any(axis=0))[0]):
        return solve(e.T, free.T).T
    e = e.copy()
    rows, cols = np.flatnonzero(free.any(axis=1)), np.flatnonzero(free.any(axis=0))
    box = slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1)
    inner = free[box].astype(float)
    m, k = inner.shape
    right = np.where(inner > 0, 0.0, e[box])
    right[:, 0] += inner[:, 0] * e[box[0], cols[0] - 1]
    right[:, -1] += inner[:, -1] * e[box[0], cols[-1] + 1]
    right[0] += inner[0] * e[rows[0] - 1, box[1]]
    right[-1] += inner[-1] * e[rows[-1] + 1, box[1]]
    beside = np.eye(k, k=1) + np.eye(k, k=-1)
    inverse = np.empty((m, k, k))
    for i in range(m):
        a = np.diag(np.where(inner[i] > 0, 4.0, 1.0)) - inner[i][:, None] * beside
        if i:
            a -= inner[i][:, None] * inverse[i - 1] * inner[i - 1]
            right[i] += inner[i] * (inverse[i - 1] @ right[i - 1])
        inverse[i] = np.linalg.inv(a)
    out = right
    for i in range(m - 1, -1, -1):
        out[i] = inverse[i] @ (right[i] + inner[i] * out[i + 1] if i + 1 < m else right[i])
    e[box] = np.where(inner > 0, out, e[box])
    return e


def _round(cells: DataFrame, threshold: float, tile: tuple[int, int], margin: tuple[int, int], direct: bool) -> DataFrame:
    """y, x, free, e and moved of the cells after each tile (of so many lines and columns) has relaxed its window, or solved it; cells at a window's rim stay as they are."""
    near = lambda c, t, m: F.explode(F.sequence(F.floor((F.col(c) - m) / t), F.floor((F.col(c) + m) / t)))
    dealt = cells.withColumn("ty", near("y", tile[0], margin[0])).withColumn("tx", near("x", tile[1], margin[1]))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(key[0]) * tile[0], int(key[1]) * tile[1]
        a, b = y0 - margin[0] - 1, x0 - margin[1] - 1
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        core = (y >= y0) & (y < y0 + tile[0]) & (x >= x0) & (x < x0 + tile[1])
        e = np.zeros((tile[0] + 2 * margin[0] + 2, tile[1] + 2 * margin[1] + 2))
        free, given = np.zeros(e.shape, bool), np.zeros(e.shape, bool)
        e[y - a, x - b], free[y - a, x - b], given[y - a, x - b] = pdf["e"].to_numpy(), pdf["free"].to_numpy(), True
        inner = free.copy()
        inner[1:-1, 1:-1] &= given[:-2, 1:-1] & given[2:, 1:-1] & given[1:-1, :-2] & given[1:-1, 2:]
        inner[[0, -1]] = inner[:, [0, -1]] = False
        out = (solve(e, inner) if direct and inner.any() else relax(e, inner, threshold / 16))[y - a, x - b]
        pdf = pdf.assign(moved=np.abs(out - pdf["e"]), e=out)[core]
        return pdf[["y", "x", "free", "e", "moved"]]

    return dealt.groupBy("ty", "tx").applyInPandas(run, "y long, x long, free boolean, e double, moved double")


def laplace(cells: DataFrame, height: int, width: int, threshold: float, rounds: int, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """cells (y, x, e, free; the four neighbours of a free one are there too) with e of the free ones at the mean of its neighbours, to the threshold or the given rounds (on coarse grids GUESS at most); what e of free cells was before is not used."""
    ship(cells.sparkSession)
    short = min(height, width)
    narrow = short <= margin
    tiles, margins = (tile, tile), (margin, margin)
    if narrow:
        along, across = (REACH * tile, REACH * short), (short, 0)
        tiles, margins = zip(*((along, across) if height >= width else (across, along)), strict=True)
    if max(height, width) > tile and not narrow:
        group = cells.groupBy(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"))
        coarse = group.agg(F.avg(F.when(~F.col("free"), F.col("e"))).alias("e"), (F.min("free") & (F.count("*") == 4)).alias("free"))
        coarse = coarse.select("y", "x", F.coalesce("e", F.lit(0.0)).alias("e"), "free")
        # A coarse cell on the border of the free ones may lack neighbours: it is held.
        coarse = laplace(materialize(_held(coarse), "coarse-cells"), -(-height // 2), -(-width // 2), threshold, min(rounds, GUESS), tile, margin)
        guess = coarse.select(F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("e").alias("guess"))
        cells = cells.join(guess, (F.floor(F.col("y") / 2) == F.col("cy")) & (F.floor(F.col("x") / 2) == F.col("cx")), "left").select("y", "x", F.when(F.col("free"), F.coalesce("guess", F.lit(0.0))).otherwise(F.col("e")).alias("e"), "free")
    else:
        cells = cells.select("y", "x", F.when(F.col("free"), F.lit(0.0)).otherwise(F.col("e")).alias("e"), "free")
    for _ in range(rounds):
        cells = materialize(_round(cells.select("y", "x", "free", "e"), threshold, tiles, margins, narrow), "relaxed")
        if (cells.agg(F.max("moved")).first()[0] or 0.0) < threshold:
            break
    return cells.select("y", "x", "e", "free")


def _held(cells: DataFrame) -> DataFrame:
    """cells of which only those stay free that have all four neighbours."""
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    seen = cells.withColumn("d", F.explode(around)).select((F.col("y") + F.col("d.a")).alias("y"), (F.col("x") + F.col("d.b")).alias("x"), F.when((F.col("d.a") == 0) & (F.col("d.b") == 0), F.struct("e", "free")).alias("own"))
    found = seen.groupBy("y", "x").agg(F.max("own").alias("own"), F.count("*").alias("n")).where("own is not null")
    return found.select("y", "x", "own.e", (F.col("own.free") & (F.col("n") == 5)).alias("free"))


def gradient_mosaic(products: list[tuple[Product, int, int]], band: str, threshold: float = 1e-4, rounds: int = 200, normalise: bool = False, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """y, x and the band of rasters laid over each other in the order given, with the offsets (y, x) of their origins.

    A pixel that only one has is taken as it is. Of two, the old value stays where a
    neighbour lacks the new one, and the new sample is taken where a neighbour
    lacks the old one; in between, the differences between neighbours are the new
    raster's, and the level that of the border. Missing samples count as absent.
    With normalise, each raster is first taken to mean 0 and deviation 1.
    """
    whole = None
    for p, dy, dx in products:
        v = F.col(band).cast("double")
        rows = p.pixels.where(F.col(band).isNotNull()).select((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), v.alias("v"))
        if normalise:
            s = rows.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d")).first()
            rows = rows.withColumn("v", (F.col("v") - F.lit(s["m"])) / F.lit(s["d"] or 1.0))
        whole = rows if whole is None else _lay_over(whole, rows, threshold, rounds, tile, margin)
    return whole.select("y", "x", F.col("v").alias(band))


def _lay_over(old: DataFrame, new: DataFrame, threshold: float, rounds: int, tile: int, margin: int) -> DataFrame:
    both = old.withColumnRenamed("v", "o").join(new.withColumnRenamed("v", "n"), ["y", "x"], "full")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    own = (F.col("d.a") == 0) & (F.col("d.b") == 0)
    sent = both.withColumn("d", F.explode(around)).select((F.col("y") + F.col("d.a")).alias("y"), (F.col("x") + F.col("d.b")).alias("x"), F.when(own, F.col("o")).alias("o"), F.when(own, F.col("n")).alias("n"), (~own & F.col("o").isNotNull()).cast("int").alias("no"), (~own & F.col("n").isNotNull()).cast("int").alias("nn"))
    pixels = sent.groupBy("y", "x").agg(F.max("o").alias("o"), F.max("n").alias("n"), F.sum("no").alias("no"), F.sum("nn").alias("nn")).where("o is not null or n is not null")
    free = F.col("o").isNotNull() & F.col("n").isNotNull() & (F.col("no") == 4) & (F.col("nn") == 4)
    value = F.when(F.col("o").isNull(), F.col("n")).when(F.col("n").isNull() | (F.col("nn") < 4), F.col("o")).otherwise(F.col("n"))
    pixels = materialize(pixels.select("y", "x", "o", "n", value.alias("v"), free.alias("free")), "overlaid")
    cells = pixels.where("o is not null and n is not null")
    # The grid begins at the overlap's corner, so that its size is the overlap's.
    size = cells.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count_if("free").alias("free")).first()
    if not size["free"]:
        return pixels.select("y", "x", "v")
    cells = cells.select((F.col("y") - size["y0"]).alias("y"), (F.col("x") - size["x0"]).alias("x"), (F.col("v") - F.col("n")).alias("e"), "free")
    solved = laplace(cells, size["y1"] - size["y0"] + 1, size["x1"] - size["x0"] + 1, threshold, rounds, tile, margin).where("free")
    solved = solved.select((F.col("y") + size["y0"]).alias("y"), (F.col("x") + size["x0"]).alias("x"), F.col("e"))
    return pixels.join(solved, ["y", "x"], "left").select("y", "x", F.when(F.col("free"), F.col("n") + F.col("e")).otherwise(F.col("v")).alias("v"))
