"""Projections, filters and per-pixel operators: everything here is one narrow select, with no shuffle but for global statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import band_math as m
from ..product import Product
from .statistics import histogram


def band_select(p: Product, *bands: str) -> Product:
    return p.select(*bands)


def band_maths(products: list[Product], **targets: Column) -> Product:
    """Bands from expressions over products of one size; bands of the n-th product (from 1, after the first) are named n_band."""
    first = products[0]
    if any((p.height, p.width) != (first.height, first.width) for p in products):
        raise ValueError("products differ in size")
    pixels = first.pixels
    for n, p in enumerate(products[1:], 2):
        pixels = pixels.join(p.pixels.select("y", "x", *[F.col(b).alias(f"{n}_{b}") for b in p.bands]), ["y", "x"])
    return first.with_pixels(pixels.select("y", "x", *[c.alias(n) for n, c in targets.items()]))


def mask_range(band: str, low: float, high: float) -> Column:
    return F.col(band).between(low, high)


def mask_polygon(points: list[tuple[float, float]], x: Column | None = None, y: Column | None = None) -> Column:
    """Inside a polygon of (x, y) corners, by the parity of edges to the right of the pixel's centre."""
    x, y = x if x is not None else m.pixel_x(), y if y is not None else m.pixel_y()
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside = inside != crosses
    return inside


def masked(p: Product, mask: Column, *bands: str) -> Product:
    """Bands (all by default) where the mask holds, missing elsewhere."""
    return p.with_bands(**{b: F.when(mask, F.col(b)) for b in bands or p.bands})


def no_data(p: Product, values: dict[str, float]) -> Product:
    """Samples equal to their band's no-data value become missing, as every operator takes them."""
    return p.with_bands(**{b: F.when(~m.eq(F.col(b), v), F.col(b)) for b, v in values.items()})


def fill_no_data(p: Product, values: dict[str, float]) -> Product:
    """Missing samples become their band's no-data value again."""
    return p.with_bands(**{b: m.fill(F.col(b), v) for b, v in values.items()})


def valid_maths(p: Product, valid: dict[str, Column], uses: dict[str, list[str]], **targets: Column) -> Product:
    """Bands from expressions, missing where a band that one uses is not valid: `valid` has the test of each band that has one, `uses` the bands of each target."""
    test = {t: [F.coalesce(valid[b], F.lit(False)) for b in uses.get(t, []) if b in valid] for t in targets}
    return p.select(*[F.when(reduce(lambda a, b: a & b, test[t], F.lit(True)), c).alias(t) for t, c in targets.items()])


def subset(p: Product, x: int, y: int, width: int, height: int, step_x: int = 1, step_y: int = 1) -> Product:
    """A region, each n-th pixel of it, with its own origin. The range filter reaches the scan."""
    keep = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    if step_x > 1 or step_y > 1:
        keep = keep & ((F.col("x") - x) % step_x == 0) & ((F.col("y") - y) % step_y == 0)
    place = lambda c, at, step: (F.col(c) - at) if step == 1 else F.floor((F.col(c) - at) / step).cast("long")
    pixels = p.pixels.where(keep).select(place("y", y, step_y).alias("y"), place("x", x, step_x).alias("x"), *p.bands)
    return p.with_pixels(pixels, height=-(-height // step_y), width=-(-width // step_x))


def flip(p: Product, horizontal: bool = True, vertical: bool = False) -> Product:
    y = (p.height - 1 - F.col("y")) if vertical else F.col("y")
    x = (p.width - 1 - F.col("x")) if horizontal else F.col("x")
    return p.with_pixels(p.pixels.select(y.alias("y"), x.alias("x"), *p.bands))


def convert(p: Product, band: str, low: int, high: int, scaling: str = "truncate") -> Product:
    """A band as integers in [low, high]: truncate, linear (by its minimum and maximum), clipped (between the 2.5 % and 97.5 % points of a 512-bin histogram) or log."""
    v = F.col(band).cast("double")
    if scaling == "log":
        v = F.when(v > 0, F.log10(F.when(v > 0, v)))
    if scaling != "truncate":
        ends = p.pixels.agg(F.min(v).alias("a"), F.max(v).alias("b")).first()
        a, b = ends["a"], ends["b"]
        if scaling == "clipped" and a is not None and b > a:
            bins = histogram(p, band, a, b, 512).withColumnRenamed("n", "c").collect()  # 512 rows at most
            total, run, width = sum(r["c"] for r in bins), 0, (b - a) / 512
            cut = [None, None]
            for r in sorted(bins, key=lambda r: r["bin"]):
                run += r["c"]
                for k, share in enumerate((0.025, 0.975)):
                    if cut[k] is None and run >= share * total:
                        cut[k] = a + width * (r["bin"] + k)
            a, b = cut
        if a is not None and b > a:
            v = (v - a) / (b - a) * (high - low) + low
    v = F.when(v < low, low).when(v > high, high).otherwise(v)
    return p.with_bands(**{band: F.when(F.isnan(v), 0).otherwise(v.cast("long"))})


def linear_to_db(p: Product, *bands: str) -> Product:
    """10 log10 v; what is under 1e-30 becomes -1e-30."""
    db = lambda c: F.when(c < 1e-30, F.lit(-1e-30)).otherwise(10 * F.log10(F.when(c >= 1e-30, c)))
    return p.with_bands(**{f"{b}_db": db(F.col(b)) for b in bands or p.bands})


def db_to_linear(p: Product, *bands: str) -> Product:
    return p.with_bands(**{b: m.exp10(F.col(b) / 10) for b in bands})


def ndvi(p: Product, upper: str, lower: str, low: float = 0.0, high: float = 1.0) -> Product:
    """(upper-lower)/(upper+lower) with flags 1 (not a number; the value is 0), 2 (under low) and 4 (over high)."""
    raw = m.div(F.col(upper) - F.col(lower), F.col(upper) + F.col(lower))
    bad = F.isnan(raw) | m.is_inf(raw)
    value = F.when(bad, 0.0).otherwise(raw)
    flags = F.when(bad, 1).otherwise(0) + F.when(value < low, 2).otherwise(0) + F.when(value > high, 4).otherwise(0)
    return p.select(value.alias("ndvi"), flags.alias("flags"))


def land_mask(p: Product, elevation: str, keep_land: bool = True, no_data: float = 0.0) -> Product:
    """Bands where an elevation band tells land (over no_data), or sea."""
    land = F.coalesce(F.col(elevation) > no_data, F.lit(False))
    return masked(p, land if keep_land else ~land, *[b for b in p.bands if b != elevation])


def displacement(p: Product, a: float, b: float) -> Product:
    """Offsets of each pixel's centre from a reference point (a, b), and their length."""
    dx, dy = m.pixel_x() - a, m.pixel_y() - b
    return p.select(dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("length"))
