"""Places on irregular grids: swaths whose pixels, or tie points, carry latitude and longitude.

Four neighbouring points make a quad, and blocks of neighbouring quads share their
points. Boxes of blocks are indexed by cells of latitude and longitude whose size
fits the box (a power of two below the whole circle), so a block lies in a few
cells, and targets ask one cell for each size that occurs. Targets are dealt to the
blocks whose box holds them and meet their quads there, by cells again; so a point
or a target is moved as one row, with a few more at the rims. Inside its quad a
target's place follows in closed form. Longitudes are taken relative to the quad,
so the date line is like any other meridian. Quads around a pole are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..product import Product
from ..session import ship
from .joins import resample
from .tie_points import TiePoints, bilinear_at

LEVELS = 24  # of cells; the smallest are 360 / 2**23 degrees wide
EDGE = 1e-9  # a target on a quad's edge belongs to it
SIDE = 64  # lines and columns of quads in a block, at most
BLOCKS = 1024  # that a grid is cut into at least, so that small grids are shared out too
PAIRS = 1 << 19  # of targets and quads that a task compares at once
CORNERS = ("00", "01", "10", "11")  # of a quad: line and column after the first


@dataclass(frozen=True)
class Quads:
    """A grid of height by width points (i, j, py, px, lat, lon): line and column, place and coordinates. A quad without one of its corners, or with a missing coordinate, is left out."""

    points: DataFrame
    height: int
    width: int

    @property
    def side(self) -> int:
        """Lines and columns of quads in a block: a power of two."""
        side = SIDE
        while side > 1 and self.height * self.width < BLOCKS * side * side:
            side //= 2
        return side


def pixel_quads(p: Product, lat: str = "lat", lon: str = "lon") -> Quads:
    """Quads between the centres of pixels that carry their latitude and longitude as bands."""
    c = p.pixels.select(F.col("y").alias("i"), F.col("x").alias("j"), (F.col("y") + 0.5).alias("py"), (F.col("x") + 0.5).alias("px"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return Quads(c, p.height, p.width)


def tie_point_quads(lat: TiePoints, lon: TiePoints) -> Quads:
    """Quads between the points of two grids of the same shape."""
    both = lat.points.withColumnRenamed("v", "lat").join(lon.points.withColumnRenamed("v", "lon"), ["row", "col"])
    c = both.select(F.col("row").alias("i"), F.col("col").alias("j"), (F.col("row") * lat.step_y + lat.offset_y).alias("py"), (F.col("col") * lat.step_x + lat.offset_x).alias("px"), "lat", "lon")
    return Quads(c, lat.rows, lat.cols)


def _dealt_points(q: Quads) -> DataFrame:
    """The points with their block (bi, bj); those at a block's rim are in the blocks before it too."""
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("lat", "lon"))
    c = q.points.where(finite).where(F.col("i").between(0, q.height - 1) & F.col("j").between(0, q.width - 1))
    for point, block, size in (("i", "bi", q.height), ("j", "bj", q.width)):
        first, last = F.floor((F.col(point) - 1) / q.side), F.floor(F.col(point) / q.side)
        c = c.withColumn(block, F.explode(F.sequence(F.greatest(F.lit(0), first), F.least(F.lit((size - 2) // q.side), last)))) if size > 1 else c.where("false").withColumn(block, F.lit(0))
    return c.withColumns({b: F.col(b).cast("int") for b in ("bi", "bj")})


def _indexed(q: Quads) -> DataFrame:
    """Blocks with their box (south, north, west and span of longitudes), and a row for each cell (level, cy, cx) that it touches. Longitudes that fit in no half circle are a whole one."""
    east, turned = F.pmod(F.col("lon"), F.lit(360.0)), F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    box = _dealt_points(q).groupBy("bi", "bj").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min(east).alias("w0"), F.max(east).alias("e0"), F.min(turned).alias("w1"), F.max(turned).alias("e1"))
    pick = lambda a, b, c: F.when(F.expr("e0 - w0 < 180"), a).when(F.expr("e1 - w1 < 180"), b).otherwise(F.lit(c))
    box = box.withColumns({"west": pick(F.col("w0"), F.col("w1"), -180.0), "span": pick(F.expr("e0 - w0"), F.expr("e1 - w1"), 360.0)})
    wide = F.greatest(F.col("span"), F.col("north") - F.col("south"), F.lit(360.0 / 2 ** (LEVELS - 1)))
    box = box.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(F.log2(360.0 / (wide * (1 + 1e-6)))))).cast("int"))
    size, count = 360.0 / F.pow(F.lit(2.0), F.col("level")), F.pow(F.lit(2.0), F.col("level")).cast("long")
    at = lambda c, more: F.floor((c + more) / size)
    columns = F.sequence(at(F.col("west") + 180.0, -2 * EDGE), at(F.col("west") + 180.0 + F.col("span"), 2 * EDGE))
    lines = F.sequence(at(F.col("south") + 90.0, -2 * EDGE), at(F.col("north") + 90.0, 2 * EDGE))
    box = box.withColumn("cx", F.explode(F.array_distinct(F.transform(columns, lambda k: F.pmod(k, count))))).withColumn("cy", F.explode(lines))
    return box.select("level", "cx", "cy", "bi", "bj", "south", "north", "west", "span")


def _pmod(a: np.ndarray, n: float) -> np.ndarray:
    r = np.fmod(a, n)
    return np.where(r < 0, np.fmod(r + n, n), r)


def _turn(lon: np.ndarray) -> np.ndarray:
    """A difference of longitudes in [-180, 180)."""
    return _pmod(lon + 180.0, 360.0) - 180.0


def _cell(level: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """A number of the cell; lat from -90 and lon from -180 on, in cells. Very far latitudes share one."""
    return ((level << 24) + np.mod(lon, 1 << level) << 32) + np.clip(lat, -(2.0**31), 2.0**31 - 1).astype(np.int64) + (1 << 31)


def _block(grid: np.ndarray, first: tuple[int, int]) -> dict:
    """The whole quads of a block's points (lat, lon, py, px; missing: NaN) in arrays, with longitudes relative to the first corner, and the cells that they touch in order."""
    cut = dict(zip(CORNERS, (grid[:, :-1, :-1], grid[:, :-1, 1:], grid[:, 1:, :-1], grid[:, 1:, 1:]), strict=True))
    i, j = np.nonzero(~np.isnan(sum(c[0] for c in cut.values())))
    q = {"qi": i + first[0], "qj": j + first[1], "c": {k: c[:, i, j] for k, c in cut.items()}}
    q["r"] = {k: _turn(c[1] - q["c"]["00"][1]) if k != "00" else np.zeros(len(i)) for k, c in q["c"].items()}
    lats, rel = np.stack([q["c"][k][0] for k in CORNERS]), np.stack([q["r"][k] for k in CORNERS])
    q |= {"south": lats.min(axis=0), "north": lats.max(axis=0), "west": rel.min(axis=0), "east": rel.max(axis=0)}
    wide = np.maximum(np.maximum(q["east"] - q["west"], q["north"] - q["south"]), 360.0 / 2 ** (LEVELS - 1))
    level = np.clip(np.floor(np.log2(360.0 / (wide * (1 + 1e-6)))), 0, LEVELS - 1).astype(np.int64)
    size, start = 360.0 / 2.0**level, q["c"]["00"][1] + 180.0
    x0, x1 = (np.floor((start + q[k] + e) / size).astype(np.int64) for k, e in (("west", -EDGE), ("east", EDGE)))
    y0, y1 = (np.floor((q[k] + 90.0 + e) / size) for k, e in (("south", -EDGE), ("north", EDGE)))
    good = (q["east"] - q["west"] < 180) & (q["north"] - q["south"] <= 360)
    cells, held = [], []
    for b in range(int((y1 - y0)[good].max(initial=-1)) + 1):
        for a in range(int((x1 - x0)[good].max(initial=-1)) + 1):
            k = np.flatnonzero(good & (y0 + b <= y1) & (x0 + a <= x1))
            cells.append(_cell(level[k], y0[k] + b, x0[k] + a))
            held.append(k)
    cells, held = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in (cells, held))
    order = np.argsort(cells, kind="stable")
    return q | {"cells": cells[order], "held": held[order], "levels": np.unique(level[good])}


def _inside(q: dict, k: np.ndarray, lat: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u and v of targets in quads k: the target is b u + c v + d u v from the quad's first corner, by a quadratic in v of which the root in the quad is taken, or else the other."""
    y = {n: q["c"][n][0][k] - q["c"]["00"][0][k] for n in CORNERS[1:]}
    x = {n: q["r"][n][k] for n in CORNERS[1:]}
    hx, hy, bx, by, cx, cy = rel, lat - q["c"]["00"][0][k], x["01"], y["01"], x["10"], y["10"]
    dx, dy = x["11"] - bx - cx, y["11"] - by - cy
    a2, a1, a0 = -(cx * dy - cy * dx), (hx * dy - hy * dx) + (bx * cy - by * cx), hx * by - hy * bx
    root = np.sqrt(np.maximum(a1 * a1 - 4 * a2 * a0, 0.0))
    toward = np.where(a1 >= 0, a1 + root, a1 - root)
    divide = lambda p, r: np.where(r == 0, np.nan, p / r)
    with np.errstate(all="ignore"):
        near, far = divide(-2 * a0, toward), divide(-toward, 2 * a2)
        v = np.where((near >= -EDGE) & (near <= 1 + EDGE) | np.isnan(far), near, far)
        ex, ey = bx + dx * v, by + dy * v
        return divide((hx - cx * v) * ex + (hy - cy * v) * ey, ex * ex + ey * ey), v


def _met(q: dict, lat: np.ndarray, lon: np.ndarray):
    """Targets that quads of the block hold, in parts: their numbers, the first quad (qi, qj) with the place in it, and the least distance to a corner (squared) with its place."""
    for level in q["levels"]:
        size = 360.0 / 2.0**level
        cell = _cell(np.full(len(lat), level), np.floor((lat + 90.0) / size), np.floor(_pmod(lon + 180.0, 360.0) / size).astype(np.int64))
        low, high = np.searchsorted(q["cells"], cell, "left"), np.searchsorted(q["cells"], cell, "right")
        ends = np.cumsum(high - low)
        a = 0
        while a < len(lat):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = (high - low)[a:z]
            t = np.repeat(np.arange(a, z), n)
            k = q["held"][np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) + low[t]]
            rel = _turn(lon[t] - q["c"]["00"][1][k])
            box = (rel >= q["west"][k] - EDGE) & (rel <= q["east"][k] + EDGE) & (lat[t] >= q["south"][k] - EDGE) & (lat[t] <= q["north"][k] + EDGE)
            t, k, rel = t[box], k[box], rel[box]
            u, v = _inside(q, k, lat[t], rel)
            held = (u >= -EDGE) & (u <= 1 + EDGE) & (v >= -EDGE) & (v <= 1 + EDGE)
            t, k, rel, u, v = t[held], k[held], rel[held], u[held], v[held]
            a = z
            if not len(t):
                continue
            c = {n: q["c"][n][:, k] for n in CORNERS}
            sy, sx = ((c["00"][p] * (1 - u) + c["01"][p] * u) * (1 - v) + (c["10"][p] * (1 - u) + c["11"][p] * u) * v for p in (2, 3))
            shrink = np.cos(np.radians(lat[t]))
            apart = np.stack([(lat[t] - c[n][0]) ** 2 + (shrink * (rel - q["r"][n][k])) ** 2 for n in CORNERS])
            ny, nx = (np.stack([c[n][p] for n in CORNERS]) for p in (2, 3))
            first = np.lexsort((q["qj"][k], q["qi"][k], t))
            first = first[np.unique(t[first], return_index=True)[1]]
            near = np.lexsort((nx.ravel(), ny.ravel(), apart.ravel(), np.tile(t, 4)))
            near = near[np.unique(np.tile(t, 4)[near], return_index=True)[1]]
            yield t[first], [q["qi"][k[first]], q["qj"][k[first]], sy[first], sx[first], apart.ravel()[near], ny.ravel()[near], nx.ravel()[near]]


def _dealt(q: Quads, targets: DataFrame, lat: Column, lon: Column, key: tuple[str, ...]) -> DataFrame | None:
    """Points (role 0) and targets (role 1: key, lat, lon) with their blocks (bi, bj); None if there are no points."""
    index = _indexed(q)
    levels = sorted(r[0] for r in index.select("level").distinct().collect())  # at most LEVELS
    if not levels:
        return None
    asked = targets.select(*key, lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    size = 360.0 / F.pow(F.lit(2.0), F.col("level"))
    asked = asked.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    asked = asked.withColumns({"cx": F.pmod(F.floor(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) / size), F.pow(F.lit(2.0), F.col("level")).cast("long")), "cy": F.floor((F.col("lat") + 90.0) / size)})
    met = asked.join(index, ["level", "cx", "cy"])
    met = met.where(F.col("lat").between(F.col("south") - 2 * EDGE, F.col("north") + 2 * EDGE) & (F.pmod(F.col("lon") - F.col("west") + 2 * EDGE, F.lit(360.0)) <= F.col("span") + 4 * EDGE))
    number = lambda c: F.col(c).cast("long").alias(c)
    given = _dealt_points(q).select("bi", "bj", F.lit(0).alias("role"), number("i"), number("j"), F.col("py").cast("double").alias("py"), F.col("px").cast("double").alias("px"), "lat", "lon", *[F.lit(None).cast(targets.schema[k].dataType).alias(f"key_{k}") for k in key])
    wanted = met.select("bi", "bj", F.lit(1).alias("role"), *[F.lit(0).cast("long").alias(c) for c in ("i", "j")], *[F.lit(0.0).alias(c) for c in ("py", "px")], "lat", "lon", *[F.col(k).alias(f"key_{k}") for k in key])
    return given.unionByName(wanted)


def locate(q: Quads, targets: DataFrame, lat: Column, lon: Column, key: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """key, and of each target that a quad holds: sy and sx (its place, between the corners), and near_y and near_x, the corner's place that is nearest (of equally near ones the one with the lesser place).

    Distances are those of latitude and of longitude times the cosine of the
    target's latitude. Where quads overlap, the first one (qi, qj) gives the place.
    Targets outside all quads, or without coordinates, are left out. In a task
    each block's points come first and its targets pass them. Of points that are
    there several times, the greatest (py, px, lat, lon) counts.
    """
    ship(targets.sparkSession)
    dealt = _dealt(q, targets, lat, lon, key)
    if dealt is None:
        empty = "".join(f", cast(null as double) {n}" for n in ("sy", "sx", "near_y", "near_x"))
        return targets.where("false").selectExpr(*key, *empty.removeprefix(", ").split(", "))
    side, names = q.side, ["qi", "qj", "sy", "sx", "nd", "ny", "nx"]

    def run(batches):
        at = grid = quads = None
        for batch in batches:
            block = np.stack([batch.column(c).to_numpy() for c in ("bi", "bj", "role")])
            number = [batch.column(c).to_numpy() for c in ("i", "j")]
            place = [batch.column(c).to_numpy() for c in ("lat", "lon", "py", "px")]
            edges = [0, *(np.flatnonzero((np.diff(block) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if (block[0, a], block[1, a]) != at:
                    at = (block[0, a], block[1, a])
                    first = (int(at[0]) * side, int(at[1]) * side)
                    grid, quads = np.full((4, side + 1, side + 1), np.nan), None
                if block[2, a] == 0:
                    grid[:, number[0][a:z] - first[0], number[1][a:z] - first[1]] = np.stack([p[a:z] for p in place])  # the last one stays
                    continue
                if quads is None:
                    quads = _block(grid, first)
                for t, found in _met(quads, place[0][a:z], place[1][a:z]):
                    keys = [batch.column(f"key_{k}").take(pa.array(t + a)) for k in key]
                    yield pa.record_batch([*keys, *[pa.array(c) for c in found]], [*key, *names])

    dealt = dealt.repartition("bi", "bj").sortWithinPartitions("bi", "bj", "role", "py", "px", "lat", "lon")
    kinds = ", ".join(f"`{k}` {targets.schema[k].dataType.simpleString()}" for k in key)
    met = dealt.mapInArrow(run, f"{kinds}, qi long, qj long, " + ", ".join(f"{n} double" for n in names[2:]))
    found = met.groupBy(*key).agg(F.min(F.struct("qi", "qj", "sy", "sx")).alias("f"), F.min(F.struct("nd", "ny", "nx")).alias("n"))
    return found.select(*key, "f.sy", "f.sx", F.col("n.ny").alias("near_y"), F.col("n.nx").alias("near_x"))


def collocate(source: Product, band: str, q: Quads, target: Product, lat: Column, lon: Column, method: str = "bilinear") -> Product:
    """The source's band on the target's pixels: each target pixel's coordinates are located in the source's quads, and the band is resampled there (nearest: the nearest of the quad's corners). Pixels outside the swath are left out."""
    at = locate(q, target.pixels, lat, lon)
    u, v = (F.col("near_x"), F.col("near_y")) if method == "nearest" else (F.col("sx"), F.col("sy"))
    return Product(resample(source, at, u, v, band, method), target.height, target.width, target.meta)


def _ground_distance(slant: Column, time: Column, records: list[tuple[float, float, list[float]]], reach: float) -> Column:
    """The distance from the record's origin, up to `reach`, whose slant range is given, by halving the interval; missing where the polynomial doesn't take it on. Slant ranges grow with the distance."""
    longest = max(len(c) for _, _, c in records)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(o)).alias("o"), F.array(*[F.lit(float(k)) for k in [*c, *[0.0] * (longest - len(c))]]).alias("c")) for t, o, c in sorted(records)])
    record = F.coalesce(F.try_element_at(F.filter(rows, lambda r: r["t"] <= time), F.lit(-1)), F.get(rows, F.lit(0)))
    value = lambda g: F.aggregate(F.reverse(record["c"]), F.lit(0.0), lambda a, k: a * g + k)
    low, high = record["o"], record["o"] + reach
    half = F.aggregate(F.sequence(F.lit(1), F.lit(52)), F.struct(low.alias("a"), high.alias("b")), lambda s, _: F.when(value((s["a"] + s["b"]) / 2) < slant, F.struct(((s["a"] + s["b"]) / 2).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), ((s["a"] + s["b"]) / 2).alias("b"))))
    return F.when((slant >= value(low)) & (slant <= value(high)), half["a"] - record["o"])


HALF_LIGHT = 299_792_458.0 / 2  # metres a second, there and back


def ellipsoid_correction_gg(source: Product, band: str, lat: TiePoints, lon: TiePoints, slant_range_time: TiePoints, target: DataFrame, height: int, width: int, target_lat: Column, target_lon: Column, range_spacing: float, first_line: float, line_interval: float, method: str = "bilinear", near_left: bool = True, zero_doppler: bool = False, ground_range: list[tuple[float, float, list[float]]] | None = None) -> Product:
    """A SAR raster on a map grid by its geolocation grid.

    A target pixel (y, x) with its coordinates is located in the quads of the tie
    points. There the slant range follows from the grid of two-way times in
    nanoseconds, and the time of zero Doppler from the line (first_line and
    line_interval in seconds); it is moved by the signal's way unless zero_doppler
    says it has no bias. Line and range give the sample: in slant range counted
    from the line's near edge, or with ground_range, the header's records (time,
    origin, [c0, c1, ...] for the slant range c0 + c1 g + ... of a ground distance
    g), by inverting the polynomial of the latest record not after the line's time
    (before all of them, of the first). Places outside the raster's inner samples
    are left out.
    """
    at = locate(tie_point_quads(lat, lon), target, target_lat, target_lon)
    at = at.where((F.col("sx") >= 0) & (F.col("sx") < source.width - 1) & (F.col("sy") >= 0) & (F.col("sy") < source.height - 1))
    at = bilinear_at(slant_range_time, at, F.col("sx"), F.col("sy"), "_ns")
    at = at.withColumn("_slant", F.col("_ns") * 1e-9 * HALF_LIGHT)
    time = first_line + F.col("sy") * line_interval
    at = at.withColumn("_time", time if zero_doppler else time + F.col("_slant") / HALF_LIGHT)
    at = at.withColumn("_line", (F.col("_time") - first_line) / line_interval)
    if ground_range is None:
        edge = 0.5 if near_left else source.width - 0.5
        at = bilinear_at(slant_range_time, at, F.lit(edge), F.floor("_line") + 0.5, "_edge")
        index = (F.col("_slant") - F.col("_edge") * 1e-9 * HALF_LIGHT) / range_spacing
    else:
        index = _ground_distance(F.col("_slant"), F.col("_time"), ground_range, source.width * range_spacing) / range_spacing
    if not near_left:
        index = source.width - 1 - index
    at = at.withColumn("_sample", index)
    inner = (F.col("_sample") >= 0) & (F.col("_sample") < source.width - 1) & (F.col("_line") >= 0) & (F.col("_line") < source.height - 1)
    return Product(resample(source, at.where(inner).select("y", "x", "_sample", "_line"), F.col("_sample") + 0.5, F.col("_line") + 0.5, band, method), height, width, source.meta)
