"""Aggregations. All are hash aggregates that are summed in part before the shuffle; histograms have a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..product import Product


def summary(p: Product, band: str, mask: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """min, max, mean, sample and population deviation, count of the valid pixels, for each region of `by`."""
    v = F.col(band).cast("double")
    rows = p.pixels if mask is None else p.pixels.where(mask)
    rows = rows.where(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*by or []).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.stddev_pop(v).alias("sd_pop"), F.count(v).alias("n"))


def looks(p: Product, band: str, intensity: bool = True) -> DataFrame:
    """Coefficient of variation and equivalent number of looks, from the moments that the unit asks for."""
    v = F.col(band).cast("double")
    a, b = (v, v * v) if intensity else (v * v, v * v * v * v)
    m1, m2 = F.avg(a), F.avg(b)
    var = m2 - m1 * m1
    return p.pixels.agg((F.sqrt(F.greatest(var, F.lit(0.0))) / F.when(m1 != 0, m1)).alias("cv"), (m1 * m1 / F.when(var > 0, var)).alias("enl"))


def histogram(p: Product, band: str, low: float, high: float, bins: int = 512) -> DataFrame:
    """bin and n of equal-width bins; the last edge is inside, what is out of range is left out."""
    v = F.col(band).cast("double")
    k = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return p.pixels.where((v >= low) & (v <= high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def percentiles(p: Product, band: str, low: float, high: float, shares: list[float], bins: int = 512) -> DataFrame:
    """share and value: the upper edge of the first bin at which the running count reaches the share."""
    run = Window.orderBy("bin")  # over the histogram: `bins` rows at most
    h = histogram(p, band, low, high, bins).withColumn("run", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    wanted = h.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).where(F.col("run") >= F.col("share") * F.col("total"))
    return wanted.groupBy("share").agg((F.min("bin") + 1).alias("k")).select("share", (low + F.col("k") * ((high - low) / bins)).alias("value"))


def median(p: Product, band: str, low: float, high: float, bins: int = 512) -> DataFrame:
    """Median from the histogram, linear inside its bin."""
    h = histogram(p, band, low, high, bins)
    h = h.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    width = (high - low) / bins
    inside = (F.col("before") < F.col("total") / 2) & (F.col("before") + F.col("n") >= F.col("total") / 2)
    return h.where(inside).select((low + width * (F.col("bin") + (F.col("total") / 2 - F.col("before")) / F.col("n"))).alias("median"))


def density(p: Product, a: str, b: str, low: float, high: float, bins: int = 64) -> DataFrame:
    """Counts of the cells of a scatter plot of two bands."""
    k = lambda c: F.least(F.floor((F.col(c) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    inside = F.col(a).between(low, high) & F.col(b).between(low, high)
    return p.pixels.where(inside).groupBy(k(a).alias("i"), k(b).alias("j")).agg(F.count("*").alias("n"))


def regression(p: Product, a: str, b: str) -> DataFrame:
    """Least squares line b = intercept + slope a, and its coefficient of determination."""
    return p.pixels.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def multilook(p: Product, band: str, range_looks: int, azimuth_looks: int, db: bool = False) -> Product:
    """Means of blocks; dB is averaged in linear power. Rows and columns that fill no block are left out."""
    h, w = p.height // azimuth_looks, p.width // range_looks
    v = F.col(band).cast("double")
    value = F.avg(F.pow(F.lit(10.0), v / 10)) if db else F.avg(v)
    value = 10 * F.log10(value) if db else value
    rows = p.pixels.where((F.col("y") < h * azimuth_looks) & (F.col("x") < w * range_looks))
    block = lambda c, n: F.floor(F.col(c) / n).cast("long")
    return p.with_pixels(rows.groupBy(block("y", azimuth_looks).alias("y"), block("x", range_looks).alias("x")).agg(value.alias(band)), height=h, width=w)


def pyramid(p: Product, band: str, levels: int) -> list[Product]:
    """Overviews, each half the size of the one before."""
    out = []
    for _ in range(levels):
        p = multilook(p, band, 2, 2)
        out.append(p)
    return out


def undersample(p: Product, band: str, step_x: float, step_y: float, kernel: list[list[float]]) -> Product:
    """Weighted means at each target pixel's source (int)(t step + 0.5); the kernel is flipped. Target pixels near the border use what is inside."""
    kh, kw = len(kernel), len(kernel[0])
    total = float(sum(map(sum, kernel))) or 1.0
    weights = F.array(*[F.struct(F.lit(i - kh // 2).alias("dy"), F.lit(j - kw // 2).alias("dx"), F.lit(float(kernel[kh - 1 - i][kw - 1 - j]) / total).alias("k")) for i in range(kh) for j in range(kw)])
    h, w = int(p.height / step_y), int(p.width / step_x)
    rows = p.pixels.withColumn("o", F.explode(weights))
    place = lambda c, d, step: F.round((F.col(c) - F.col(d)) / step).cast("long")
    rows = rows.withColumn("ty", place("y", "o.dy", step_y)).withColumn("tx", place("x", "o.dx", step_x))
    hit = lambda c, d, t, step: F.floor(F.col(t) * step + 0.5) == F.col(c) - F.col(d)
    rows = rows.where(hit("y", "o.dy", "ty", step_y) & hit("x", "o.dx", "tx", step_x) & F.col("ty").between(0, h - 1) & F.col("tx").between(0, w - 1))
    return p.with_pixels(rows.groupBy(F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("o.k") * F.col(band)).alias(band)), height=h, width=w)


def mask_area(p: Product, mask: Column, area: Column) -> DataFrame:
    """Sum, least, greatest and mean area of the pixels of a mask."""
    return p.pixels.where(mask).agg(F.sum(area).alias("total"), F.min(area).alias("least"), F.max(area).alias("most"), F.avg(area).alias("mean"), F.count("*").alias("n"))


def multilook_parameters(range_looks: Column, range_spacing: Column, azimuth_spacing: Column, incidence_deg: Column | None = None) -> tuple[Column, Column, Column]:
    """Range looks, azimuth looks and mean pixel size for square pixels, of each row's sensor; a slant-range spacing is brought to the ground by the incidence angle."""
    ground = range_spacing if incidence_deg is None else range_spacing / F.sin(F.radians(incidence_deg))
    azimuth = range_looks * ground / azimuth_spacing
    along = F.when(azimuth >= 1, range_looks).otherwise(F.floor(azimuth_spacing / ground + 0.5)).cast("int")
    across = F.when(azimuth >= 1, F.floor(azimuth + 0.5)).otherwise(1).cast("int")
    return along, across, (along * ground + across * azimuth_spacing) / 2
