"""Joins of rasters: by pixel, by offset, by computed coordinates, in time, and overlaps of mosaics."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..product import Product
from ..session import ship


def merge(master: Product, *others: Product) -> Product:
    """The master with the others' bands; a band whose name is taken is left out."""
    pixels = master.pixels
    for p in others:
        if (p.height, p.width) != (master.height, master.width):
            raise ValueError("products differ in size")
        new = [b for b in p.bands if b not in pixels.columns]
        pixels = pixels.join(p.pixels.select("y", "x", *new), ["y", "x"], "left")
    return master.with_pixels(pixels)


def merge_bands(master: Product, sources: list[tuple[Product, dict[str, str], str | None]]) -> Product:
    """The master with chosen bands of others: of each source those that its names rename, and only bands that its pattern (a whole-name regular expression, or None for all) lets in. A name that is taken is left out, as in merge()."""
    others = []
    for p, names, pattern in sources:
        chosen = [b for b in p.bands if pattern is None or re.fullmatch(pattern, b)]
        others.append(p.select(*[F.col(b).alias(names.get(b, b)) for b in chosen]))
    return merge(master, *others)


def geometry_join(p: Product, shapes: DataFrame, points: str, cell: int = 32) -> DataFrame:
    """Pixels with each row of shapes in whose polygon their centre lies; points is an array of corners (x, y), which may be in any number.

    Shapes are dealt to the cells of a grid that their box overlaps within the
    raster, pixels meet those of their own cell, and the parity of the edges to the
    right of the centre decides. A null or empty polygon, or one of under three
    corners, has no pixels; columns of shapes keep their names, bands of the same
    names are left out.
    """
    corner = lambda f, c: f(F.transform(points, lambda q: q[c]))
    cells = lambda c, size: F.sequence(
        F.floor(F.greatest(F.lit(0.0), corner(F.array_min, c)) / cell).cast("long"), F.floor(F.least(F.lit(float(size)), corner(F.array_max, c)) / cell).cast("long")
    )
    some = (F.size(points) > 2) & (corner(F.array_max, "x") >= 0) & (corner(F.array_min, "x") <= p.width) & (corner(F.array_max, "y") >= 0) & (corner(F.array_min, "y") <= p.height)
    dealt = shapes.where(some).withColumn("cell_y", F.explode(cells("y", p.height))).withColumn("cell_x", F.explode(cells("x", p.width)))
    bands = [b for b in p.bands if b not in shapes.columns]
    pixels = p.pixels.select("y", "x", *bands, F.floor(F.col("y") / cell).cast("long").alias("cell_y"), F.floor(F.col("x") / cell).cast("long").alias("cell_x"))
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    crossed = F.zip_with(points, after, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]))
    inside = F.size(F.filter(crossed, lambda c: c)) % 2 == 1
    return pixels.join(dealt, ["cell_y", "cell_x"]).where(inside).drop("cell_y", "cell_x", points)


def at_placemarks(p: Product, marks: DataFrame, lat: Column, lon: Column, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """marks with y and x, the pixel that each lies in on a latitude-longitude grid (upper left corner and step in degrees), and its bands. Marks outside the raster are left out; columns of marks named as a band, y or x are replaced."""
    # places are kept to a millionth of a pixel, so that a mark at a border isn't moved by rounding
    y, x = (F.floor(F.round(c, 6)).cast("long") for c in ((origin[0] - lat) / step[0], (lon - origin[1]) / step[1]))
    placed = marks.withColumns({"_mark_y": y, "_mark_x": x}).drop("y", "x", *p.bands).withColumnsRenamed({"_mark_y": "y", "_mark_x": "x"})
    return placed.join(p.pixels, ["y", "x"])


def stack(master: Product, slave: Product, dy: int, dx: int, extent: str = "master", no_data: float | None = None) -> Product:
    """Slave pixels at the master's pixel plus an offset. Extents: master, minimum (where both are) or maximum (where either is)."""
    names = [f"slv_{b}" for b in slave.bands]
    moved = slave.pixels.select((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), *[F.col(b).alias(n) for b, n in zip(slave.bands, names, strict=True)])
    how = {"master": "left", "minimum": "inner", "maximum": "full"}[extent]
    out = master.pixels.join(moved, ["y", "x"], how)
    if no_data is not None:
        out = out.fillna(float(no_data), names)
    return master.with_pixels(out)


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    return [0.5 * (-t + 2 * t * t - t * t * t), 0.5 * (2 - 5 * t * t + 3 * t * t * t), 0.5 * (t + 4 * t * t - 3 * t * t * t), 0.5 * (-t * t + t * t * t)]


def _sinc(t: np.ndarray) -> list[np.ndarray]:
    """The sinc under a Hann window of half-width 2.5, at five samples. Over a pixel's samples its values don't sum to one."""
    out = []
    for k in (-2, -1, 0, 1, 2):
        angle = math.pi * (t - k)
        out.append(np.where(np.abs(t - k) <= 2.5, np.sinc(t - k) * (1 + np.cos(angle / 3)) / 2, 0.0))
    return out


#: Weights by the place between two samples, the first sample (from the one before the place), and the one that must be there.
KERNELS = {"bilinear": (lambda t: [1 - t, t], 0, None), "cubic": (_cubic, -1, 5), "bicubic": (_cubic, -1, 5), "sinc": (_sinc, -2, 12)}
BLOCK = 128  # lines and columns of source samples that a task holds at once


def resample(source: Product, target: DataFrame, u: Column, v: Column, band: str, method: str = "bilinear") -> DataFrame:
    """The band at source coordinates (u along x, v along y; pixel centres at .5) of each row of target (y, x and what u and v need).

    Methods: nearest, bilinear, cubic (convolution), bicubic (patches between pixel
    centres, of values and central differences) and sinc (windowed, five samples
    each way). Nearest is an equi-join. For the others, samples and target pixels
    are dealt to blocks of the source, the samples at a block's rim to those beside
    it too; in a task each block's samples come first and the target pixels pass
    them, so one row a target pixel is moved, whatever its number of neighbours.
    Neighbours beyond the border are those at it; cubic and bicubic differ there
    only, as a bicubic patch begins inside. Target pixels outside the source are
    left out. Missing samples: bilinear divides by the weights of those present,
    the larger ones take their mean for them and are missing where the pixel at
    their base is; without any sample the result is missing.
    """
    inside = (u >= 0) & (u < source.width) & (v >= 0) & (v < source.height)
    asked = target.where(inside).select("y", "x", u.cast("double").alias("u"), v.cast("double").alias("v"))
    samples = source.pixels.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(band).cast("double").alias("s")).where("s is not null")
    if method == "nearest":
        asked = asked.select("y", "x", F.floor("u").cast("long").alias("sx"), F.floor("v").cast("long").alias("sy"))
        return asked.join(samples, ["sy", "sx"], "left").groupBy("y", "x").agg(F.when(F.count("s") == F.count("*"), F.sum("s")).otherwise(F.avg("s")).alias(band))
    base = KERNELS[method][2]
    found = _taps(source, asked, samples, method).groupBy("y", "x").agg(*[F.sum(c).alias(c) for c in ("total", "weight", "share", "sum", "n", "of")], F.max("based").alias("based"))
    total, weight = F.col("total"), F.col("weight")
    if method == "sinc":
        total, weight = total / F.col("share"), weight / F.col("share")
    if base is not None:
        whole = F.when(F.col("n") == F.col("of"), total).when(F.col("based"), total + (1 - weight) * F.col("sum") / F.col("n"))
    else:
        whole = F.when(F.col("n") == F.col("of"), total).when(weight > 0, total / F.when(weight > 0, weight))
    return found.select("y", "x", whole.alias(band))


def _taps(source: Product, asked: DataFrame, samples: DataFrame, method: str) -> DataFrame:
    """Of each row of asked (y, x, u, v), over the samples around its place: the sums of weighted samples (total), of the weights of those present and of all, of samples, the number of those present and of all, and if the one at the base is there. A sample that is there several times counts as often."""
    spark = asked.sparkSession
    ship(spark)
    kernel, first, base = KERNELS[method]
    taps = len(kernel(np.zeros(1)))
    height, width, last = source.height, source.width, first + taps - 1
    block = lambda c, size: F.floor(F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(F.col(c) - 0.5))) / BLOCK).cast("int")
    blocks = lambda c, size: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - last) / BLOCK)), F.least(F.lit((size - 1) // BLOCK), F.floor((F.col(c) - first) / BLOCK))))
    samples = samples.where(F.col("sy").between(0, height - 1) & F.col("sx").between(0, width - 1)).withColumn("by", blocks("sy", height)).withColumn("bx", blocks("sx", width))
    given = samples.select(F.col("by").cast("int").alias("by"), F.col("bx").cast("int").alias("bx"), F.lit(0).alias("role"), F.col("sy").alias("y"), F.col("sx").alias("x"), F.col("s").alias("u"), F.lit(0.0).alias("v"))
    wanted = asked.select(block("v", height).alias("by"), block("u", width).alias("bx"), F.lit(1).alias("role"), "y", "x", "u", "v")
    dealt = given.unionByName(wanted).repartition("by", "bx").sortWithinPartitions("by", "bx", "role")
    names = ["total", "weight", "share", "sum", "n", "of"]

    def run(batches):
        at = held = total = count = None
        wide = BLOCK + taps - 1
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("by", "bx", "role")])
            one, two = (batch.column(c).to_numpy() for c in ("u", "v"))
            edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if (key[0, a], key[1, a]) != at:
                    at = (key[0, a], key[1, a])
                    held = (int(at[0]) * BLOCK + first, int(at[1]) * BLOCK + first)
                    total, count = np.zeros(wide * wide), np.zeros(wide * wide)
                if key[2, a] == 0:
                    y, x = (batch.column(c).slice(a, z - a).to_numpy() for c in ("y", "x"))
                    place = (y - held[0]) * wide + x - held[1]
                    np.add.at(total, place, one[a:z])
                    np.add.at(count, place, 1.0)
                    continue
                cx, cy = np.floor(one[a:z] - 0.5), np.floor(two[a:z] - 0.5)
                wx, wy = kernel(one[a:z] - 0.5 - cx), kernel(two[a:z] - 0.5 - cy)
                if method == "bicubic":
                    cx, cy = np.clip(cx, 0, width - 1), np.clip(cy, 0, height - 1)
                out = {n: np.zeros(z - a) for n in names}
                for j in range(taps):
                    line = (np.clip(cy + first + j, 0, height - 1).astype(np.int64) - held[0]) * wide
                    for i in range(taps):
                        place = line + np.clip(cx + first + i, 0, width - 1).astype(np.int64) - held[1]
                        w, s, c = wx[i] * wy[j], total[place], count[place]
                        rows = np.maximum(c, 1.0)
                        for n, more in zip(names, (w * s, w * c, w * rows, s, c, rows), strict=True):
                            out[n] += more
                        if j * taps + i == base:
                            based = c > 0
                if base is None:
                    based = out["n"] > 0
                part = batch.slice(a, z - a)
                yield pa.record_batch([part.column("y"), part.column("x"), *[pa.array(out[n]) for n in names], pa.array(based)], ["y", "x", *names, "based"])

    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in ("y", "x"))
    return dealt.mapInArrow(run, f"{kinds}, " + ", ".join(f"`{n}` double" for n in names) + ", based boolean")


def warp(source: Product, band: str, x_terms: list[float], y_terms: list[float], method: str = "bilinear") -> Product:
    """Resampled at polynomials of x and y: terms 1, x, y, x2, xy, y2, x3, x2y, xy2, y3, as far as given."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    terms = [F.lit(1.0), x, y, x * x, x * y, y * y, x * x * x, x * x * y, x * y * y, y * y * y]
    poly = lambda c: sum((float(k) * t for k, t in zip(c, terms, strict=False)), F.lit(0.0))
    return source.with_pixels(resample(source, source.pixels.select("y", "x"), poly(x_terms) + 0.5, poly(y_terms) + 0.5, band, method))


def _edge_weight(p: Product) -> Column:
    return F.least(F.col("x") + 1, F.lit(p.width) - F.col("x"), F.col("y") + 1, F.lit(p.height) - F.col("y")).cast("double")


def mosaic(products: list[tuple[Product, int, int]], band: str, weighted: bool = True, normalise: bool = False) -> DataFrame:
    """y, x and the mean of all products that have the pixel, weighted by the distance to their edges. products: with the offsets (y, x) of their origins. Missing samples don't count."""
    parts = []
    for p, y, x in products:
        v = F.col(band).cast("double")
        rows = p.pixels
        if normalise:
            s = p.pixels.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))  # one row
            rows = rows.join(F.broadcast(s))
            v = (v - F.col("m")) / F.when(F.col("s") > 0, F.col("s"))
        parts.append(rows.select((F.col("y") + y).alias("y"), (F.col("x") + x).alias("x"), v.alias("v"), (_edge_weight(p) if weighted else F.lit(1.0)).alias("w")))
    rows = parts[0]
    for q in parts[1:]:
        rows = rows.unionAll(q)
    return rows.where("v is not null").groupBy("y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(band), F.count("*").alias("count"))


def mosaic_overlap(rows: DataFrame, variables: dict[str, Column], conditions: dict[str, Column], combine: str = "or") -> DataFrame:
    """Blended variables with their counts, and the conditions' sums, over rows (y, x, and bands) of all sources; a row counts if its conditions hold (all, or one)."""
    test = list(conditions.values())
    valid = F.lit(True)
    if test:
        valid = test[0]
        for t in test[1:]:
            valid = valid | t if combine == "or" else valid & t
    aggs = []
    for n, v in variables.items():
        aggs += [F.avg(F.when(valid, v)).alias(n), F.count(F.when(valid, v)).alias(f"{n}_count")]
    aggs += [F.sum(c.cast("long")).alias(n) for n, c in conditions.items()]
    return rows.groupBy("y", "x").agg(*aggs)


def mosaic_update(old: DataFrame, new: DataFrame, names: list[str]) -> DataFrame:
    """Means and counts of a stored mosaic brought up to date with those of new sources."""
    both = old.unionByName(new)
    aggs = []
    for n in names:
        c = F.sum(f"{n}_count")
        aggs += [(F.sum(F.when(F.col(f"{n}_count") > 0, F.col(n) * F.col(f"{n}_count"))) / F.when(c > 0, c)).alias(n), c.alias(f"{n}_count")]
    return both.groupBy("y", "x").agg(*aggs)


def merge_slices(products: list[Product]) -> Product:
    """One below the other: heights add up, the width is the greatest."""
    rows, height = None, 0
    for p in products:
        part = p.pixels.withColumn("y", F.col("y") + height)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        height += p.height
    return Product(rows, height, max(p.width for p in products), products[0].meta)


def coarse_to_fine(fine: Product, coarse: Product, factor: int) -> Product:
    """Bands of a reduced-resolution product at the pixels of a full-resolution one."""
    at = fine.pixels.withColumn("cy", F.floor(F.col("y") / factor).cast("long")).withColumn("cx", F.floor(F.col("x") / factor).cast("long"))
    small = coarse.pixels.select(F.col("y").alias("cy"), F.col("x").alias("cx"), *[F.col(b).alias(f"rr_{b}") for b in coarse.bands])
    return fine.with_pixels(at.join(small, ["cy", "cx"], "left").drop("cy", "cx"))


def bracket(records: DataFrame, samples: DataFrame, time: str, values: list[str], by: list[str] | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """samples with linear interpolations of records between the nearest ones before and after (as-of join).

    Records become intervals to the next record, cut at buckets of time, so the
    join is on (by, bucket) and a range test; a sample outside all intervals is
    left out. Records at the same time: their mean. The next record is looked
    for inside the bucket, and for its last one among the buckets' first ones,
    so only one row a bucket is ever put in order in one task.
    """
    by = by or []
    bucket = lambda c: F.floor(F.unix_micros(c) / (bucket_seconds * 1_000_000)).cast("long")
    records = records.groupBy(*by, time).agg(*[F.avg(v).alias(v) for v in values]).withColumn("bucket", bucket(F.col(time)))
    state = F.struct(time, *values)
    firsts = records.groupBy(*by, "bucket").agg(F.min_by(state, time).alias("head"))
    firsts = firsts.select(*by, "bucket", F.lead("head").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("bucket")).alias("later"))
    inside = F.lead(state).over(Window.partitionBy(*by, "bucket").orderBy(time))
    spans = records.withColumn("inside", inside).join(firsts, [*by, "bucket"])
    spans = spans.select(*by, F.col(time).alias("t0"), *[F.col(v).alias(f"{v}_0") for v in values], F.coalesce("inside", "later").alias("n")).where("n is not null")
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("t0")), bucket(F.col(f"n.{time}")))))
    rows = samples.withColumn("bucket", bucket(F.col(time))).join(spans, [*by, "bucket"]).where((F.col("t0") <= F.col(time)) & (F.col(time) < F.col(f"n.{time}")))
    share = (F.unix_micros(F.col(time)) - F.unix_micros(F.col("t0"))) / (F.unix_micros(F.col(f"n.{time}")) - F.unix_micros(F.col("t0")))
    return rows.select(*samples.columns, *[(F.col(f"{v}_0") + share * (F.col(f"n.{v}") - F.col(f"{v}_0"))).alias(f"{v}_at") for v in values])


def lagrange(times: list[Column], values: list[Column], t: Column) -> Column:
    """Value at t of the polynomial through the given state vectors."""
    total = F.lit(0.0)
    for i, (ti, vi) in enumerate(zip(times, values, strict=True)):
        w = vi
        for j, tj in enumerate(times):
            if j != i:
                w = w * (t - tj) / (ti - tj)
        total = total + w
    return total


def orbit_at(samples: DataFrame, states: DataFrame, time: str, values: list[str], by: list[str] | None = None, n: int = 8) -> DataFrame:
    """samples with <value>_at: the polynomial through the n states nearest in time (all, if fewer; of equally near ones the earlier).

    time is a number (seconds). A product's states, some hundred rows of its header,
    become one array by one aggregate and reach its samples by an equi-join on `by`
    (without: on one key). States at the same time count as their mean. Samples
    without a time get missing values, those without any state are left out.
    """
    by = by or []
    once = states.where(F.col(time).isNotNull()).groupBy(*by, time).agg(*[F.avg(v).alias(v) for v in values])
    table = once.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), *values))).alias("_states")).where(F.size("_states") > 0)
    rows = samples.join(table, by) if by else samples.withColumn("_k", F.lit(1)).join(table.withColumn("_k", F.lit(1)), "_k").drop("_k")
    t = F.col(time).cast("double")
    near = F.slice(F.array_sort(F.transform("_states", lambda s: F.struct(F.abs(s["t"] - t).alias("gap"), s.alias("s")))), 1, n)
    rows = rows.withColumn("_near", F.transform(near, lambda x: x["s"]))

    def through(v: str) -> Column:
        share = lambda a: F.aggregate("_near", F.lit(1.0), lambda p, b: F.when(b["t"] == a["t"], p).otherwise(p * (t - b["t"]) / (a["t"] - b["t"])))
        return F.when(t.isNotNull(), F.aggregate("_near", F.lit(0.0), lambda total, a: total + a[v] * share(a)))

    return rows.select(*[F.col(f"`{c}`") for c in samples.columns], *[through(v).alias(f"{v}_at") for v in values])
