"""Map geometry as closed-form Columns, and operators that follow lines of sight."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.band_math import clip
from ..product import Product
from ..session import ship
from .joins import resample

# WGS 84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def geodetic_to_ecef(lat: Column, lon: Column, height: Column | float = 0.0) -> tuple[Column, Column, Column]:
    height = height if isinstance(height, Column) else F.lit(float(height))
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1 - E2) + height) * F.sin(p)


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height (Bowring's closed form)."""
    b = A * (1 - FLATTENING)
    r = F.sqrt(x * x + y * y)
    t = F.atan2(z * A, r * b)
    lat = F.atan2(z + (A * A - b * b) / b * F.pow(F.sin(t), 3), r - E2 * A * F.pow(F.cos(t), 3))
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), r / F.cos(lat) - n


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * radius * F.asin(clip(F.sqrt(s * s + F.cos(a) * F.cos(b) * t * t), high=1.0))


def geodesic(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, rounds: int = 40) -> DataFrame:
    """df with distance (metres on the ellipsoid), heading and back_heading (degrees clockwise from north, at the first place and from the second one to the first).

    Vincenty's inverse solution (Survey Review 176, 1975). Equal places have
    distance 0 and null headings. Null where a coordinate is, and for places so
    close to antipodes that the series doesn't settle in the rounds given.
    """
    names = [lat1, lon1, lat2, lon2]

    def run(batches):
        for pdf in batches:
            p1, l1, p2, l2 = (np.radians(pdf[c].to_numpy(float)) for c in names)
            u1, u2, span = np.arctan((1 - FLATTENING) * np.tan(p1)), np.arctan((1 - FLATTENING) * np.tan(p2)), l2 - l1
            with np.errstate(all="ignore"):
                lam, change = span, np.full(len(span), np.inf)
                for _ in range(rounds):
                    east = np.cos(u2) * np.sin(lam)
                    north = np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
                    sin_s, cos_s = np.hypot(east, north), np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
                    arc = np.arctan2(sin_s, cos_s)
                    sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s, 0.0)
                    squared = 1 - sin_a**2
                    middle = np.where(squared > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / squared, 0.0)
                    c = FLATTENING / 16 * squared * (4 + FLATTENING * (4 - 3 * squared))
                    new = span + (1 - c) * FLATTENING * sin_a * (arc + c * sin_s * (middle + c * cos_s * (2 * middle**2 - 1)))
                    change, lam = np.abs(new - lam), new
                length, _ = _arc_terms(squared)
                distance = length * (arc - _arc_shift(squared, sin_s, cos_s, middle))
                heading = np.degrees(np.arctan2(east, north)) % 360
                back = np.degrees(np.arctan2(-np.cos(u1) * np.sin(lam), np.sin(u1) * np.cos(u2) - np.cos(u1) * np.sin(u2) * np.cos(lam))) % 360
            same, good = sin_s == 0, (change < 1e-11) & (np.abs(lam) <= 2 * np.pi)
            known = good & ~((cos_s < 0) & same)
            yield pdf.assign(distance=np.where(known, distance, np.nan), heading=np.where(known & ~same, heading, np.nan), back_heading=np.where(known & ~same, back, np.nan))

    return _with_doubles(df, run, ["distance", "heading", "back_heading"])


def travel(df: DataFrame, lat: str, lon: str, distance: str, heading: str, rounds: int = 40) -> DataFrame:
    """df with to_lat, to_lon and back_heading: where one comes by that many metres on the ellipsoid in a direction, and the direction back. Vincenty's direct solution; null where an input is."""
    names = [lat, lon, distance, heading]

    def run(batches):
        for pdf in batches:
            p, lam, way, turn = (pdf[c].to_numpy(float) for c in names)
            p, lam, turn = np.radians(p), np.radians(lam), np.radians(turn)
            u = np.arctan((1 - FLATTENING) * np.tan(p))
            start, sin_a = np.arctan2(np.tan(u), np.cos(turn)), np.cos(u) * np.sin(turn)
            squared = 1 - sin_a**2
            length, _ = _arc_terms(squared)
            arc = way / length
            for _ in range(rounds):
                middle = np.cos(2 * start + arc)
                arc = way / length + _arc_shift(squared, np.sin(arc), np.cos(arc), middle)
            middle = np.cos(2 * start + arc)
            across = np.sin(u) * np.sin(arc) - np.cos(u) * np.cos(arc) * np.cos(turn)
            to = np.arctan2(np.sin(u) * np.cos(arc) + np.cos(u) * np.sin(arc) * np.cos(turn), (1 - FLATTENING) * np.hypot(sin_a, across))
            c = FLATTENING / 16 * squared * (4 + FLATTENING * (4 - 3 * squared))
            east = np.arctan2(np.sin(arc) * np.sin(turn), np.cos(u) * np.cos(arc) - np.sin(u) * np.sin(arc) * np.cos(turn))
            east = east - (1 - c) * FLATTENING * sin_a * (arc + c * np.sin(arc) * (middle + c * np.cos(arc) * (2 * middle**2 - 1)))
            back = np.degrees(np.arctan2(-sin_a, across)) % 360
            yield pdf.assign(to_lat=np.degrees(to), to_lon=(np.degrees(lam + east) + 180) % 360 - 180, back_heading=back)

    return _with_doubles(df, run, ["to_lat", "to_lon", "back_heading"])


def _arc_terms(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres to an arc of one radian and the coefficient of its correction, for the squared cosine of a geodesic's azimuth at the equator."""
    k = squared * E2 / (1 - E2)
    scale = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    return A * (1 - FLATTENING) * scale, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))


def _arc_shift(squared: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, middle: np.ndarray) -> np.ndarray:
    b = _arc_terms(squared)[1]
    return b * sin_s * (middle + b / 4 * (cos_s * (2 * middle**2 - 1) - b / 6 * middle * (4 * sin_s**2 - 3) * (4 * middle**2 - 3)))


def _with_doubles(df: DataFrame, run, names: list[str]) -> DataFrame:
    """df with columns of run() in place of those so named; not a number becomes null."""
    ship(df.sparkSession)
    df = df.drop(*names)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    return df.mapInPandas(run, schema).replace(float("nan"), None, names)


def transverse_mercator(lat: Column, lon: Column, lon0: float, k0: float = 0.9996, east: float = 500000.0, north: float = 0.0) -> tuple[Column, Column]:
    """Easting and northing (series to the sixth order; UTM with its defaults)."""
    ep = E2 / (1 - E2)
    p = F.radians(lat)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    t, c = F.tan(p) * F.tan(p), ep * F.cos(p) * F.cos(p)
    a = F.radians(lon - lon0) * F.cos(p)
    e4, e6 = E2 * E2, E2**3
    m = A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * p - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * p) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * p) - (35 * e6 / 3072) * F.sin(6 * p))
    x = k0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(a, 5) / 120)
    y = k0 * (m + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(a, 6) / 720))
    return east + x, north + y


def sinusoidal(lat: Column, lon: Column, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    return radius * F.radians(lon - lon0) * F.cos(F.radians(lat)), radius * F.radians(lat)


def sinusoidal_inverse(x: Column, y: Column, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    lat = y / radius
    return F.degrees(lat), lon0 + F.degrees(x / (radius * F.cos(lat)))


def albers(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    """Equal-area conic on the sphere."""
    a, b, c = map(math.radians, (lat1, lat2, lat0))
    n = (math.sin(a) + math.sin(b)) / 2
    k = math.cos(a) ** 2 + 2 * n * math.sin(a)
    r, r0 = radius * F.sqrt(k - 2 * n * F.sin(F.radians(lat))) / n, radius * math.sqrt(k - 2 * n * math.sin(c)) / n
    t = n * F.radians(lon - lon0)
    return r * F.sin(t), r0 - r * F.cos(t)


def lambert_conformal(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    """Conformal conic on the sphere."""
    a, b, c = map(math.radians, (lat1, lat2, lat0))
    up = lambda v: math.tan(math.pi / 4 + v / 2)
    n = math.sin(a) if a == b else math.log(math.cos(a) / math.cos(b)) / math.log(up(b) / up(a))
    f = math.cos(a) * up(a) ** n / n
    r = radius * f / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), F.lit(n))
    t = n * F.radians(lon - lon0)
    return r * F.sin(t), radius * f / up(c) ** n - r * F.cos(t)


def stereographic(lat: Column, lon: Column, lat0: float = 90.0, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    p, d, c = F.radians(lat), F.radians(lon - lon0), math.radians(lat0)
    k = 2 * radius / (1 + math.sin(c) * F.sin(p) + math.cos(c) * F.cos(p) * F.cos(d))
    return k * F.cos(p) * F.sin(d), k * (math.cos(c) * F.sin(p) - math.sin(c) * F.cos(p) * F.cos(d))


def transverse_mercator_inverse(x: Column, y: Column, lon0: float, k0: float = 0.9996, east: float = 500000.0, north: float = 0.0) -> tuple[Column, Column]:
    """Latitude and longitude of an easting and northing (footpoint series)."""
    ep, e4, e6 = E2 / (1 - E2), E2 * E2, E2**3
    f = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = (y - north) / k0 / (A * (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256))
    foot = mu + (1.5 * f - 27 * f**3 / 32) * F.sin(2 * mu) + (21 * f**2 / 16 - 55 * f**4 / 32) * F.sin(4 * mu) + 151 * f**3 / 96 * F.sin(6 * mu) + 1097 * f**4 / 512 * F.sin(8 * mu)
    s = F.sin(foot)
    n, r = A / F.sqrt(1 - E2 * s * s), A * (1 - E2) / F.pow(1 - E2 * s * s, F.lit(1.5))
    t, c = F.tan(foot) * F.tan(foot), ep * F.cos(foot) * F.cos(foot)
    d = (x - east) / (n * k0)
    lat = foot - n * F.tan(foot) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * F.pow(d, F.lit(6)) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, F.lit(3)) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * F.pow(d, F.lit(5)) / 120) / F.cos(foot)
    return F.degrees(lat), lon0 + F.degrees(lon)


def albers_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    a, b, c = map(math.radians, (lat1, lat2, lat0))
    n = (math.sin(a) + math.sin(b)) / 2
    k = math.cos(a) ** 2 + 2 * n * math.sin(a)
    down = radius * math.sqrt(k - 2 * n * math.sin(c)) / n - y
    r = F.sqrt(x * x + down * down)
    sine = (k - F.pow(r * n / radius, F.lit(2))) / (2 * n)
    return F.degrees(F.asin(clip(sine, -1.0, 1.0))), lon0 + F.degrees(F.atan2(x, down)) / n


def lambert_conformal_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    a, b, c = map(math.radians, (lat1, lat2, lat0))
    up = lambda v: math.tan(math.pi / 4 + v / 2)
    n = math.sin(a) if a == b else math.log(math.cos(a) / math.cos(b)) / math.log(up(b) / up(a))
    f = math.cos(a) * up(a) ** n / n
    down = radius * f / up(c) ** n - y
    r = F.sqrt(x * x + down * down)
    return F.degrees(2 * F.atan(F.pow(radius * f / r, F.lit(1 / n))) - math.pi / 2), lon0 + F.degrees(F.atan2(x, down)) / n


def stereographic_inverse(x: Column, y: Column, lat0: float = 90.0, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    c0 = math.radians(lat0)
    r = F.sqrt(x * x + y * y)
    c = 2 * F.atan(r / (2 * radius))
    sine = F.cos(c) * math.sin(c0) + F.when(r > 0, y * F.sin(c) * math.cos(c0) / F.when(r > 0, r)).otherwise(0.0)
    lon = F.atan2(x * F.sin(c), r * math.cos(c0) * F.cos(c) - y * math.sin(c0) * F.sin(c))
    return F.degrees(F.asin(clip(sine, -1.0, 1.0))), lon0 + F.degrees(F.when(r > 0, lon).otherwise(0.0))


def mollweide(lat: Column, lon: Column, lon0: float = 0.0, radius: float = A, steps: int = 12) -> tuple[Column, Column]:
    """Equal-area ellipse; the auxiliary angle by a fixed number of Newton's steps from a start that converges at the poles too."""
    p = F.radians(lat)
    goal = math.pi * F.sin(p)
    # 2t + sin 2t = goal; near a pole the root behaves like a cube root
    start = F.signum(p) * (math.pi / 2 - F.pow(0.75 * clip(math.pi - F.abs(goal), 0.0), F.lit(1 / 3)))

    def step(t: Column, _: Column) -> Column:
        slope = 2 + 2 * F.cos(2 * t)
        return t - F.when(slope > 1e-12, (2 * t + F.sin(2 * t) - goal) / F.when(slope > 1e-12, slope)).otherwise(0.0)

    t = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)  # a loop inside the row: as nested Columns the plan would double with each step
    return radius * 2 * math.sqrt(2) / math.pi * F.radians(lon - lon0) * F.cos(t), radius * math.sqrt(2) * F.sin(t)


def mollweide_inverse(x: Column, y: Column, lon0: float = 0.0, radius: float = A) -> tuple[Column, Column]:
    t = F.asin(clip(y / (radius * math.sqrt(2)), -1.0, 1.0))
    lat = F.asin(clip((2 * t + F.sin(2 * t)) / math.pi, -1.0, 1.0))
    return F.degrees(lat), lon0 + F.degrees(math.pi * x / (2 * radius * math.sqrt(2) * F.cos(t)))


def lat_lon(origin: tuple[float, float], step: tuple[float, float]) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel's centre in a grid with its upper left corner at origin (lat, lon); latitudes fall."""
    return origin[0] - (F.col("y") + 0.5) * step[0], origin[1] + (F.col("x") + 0.5) * step[1]


def reproject(source: Product, band: str, origin: tuple[float, float], step: tuple[float, float], inverse, target: DataFrame, height: int, width: int, corner: tuple[float, float], spacing: float, method: str = "bilinear") -> Product:
    """The band of a latitude-longitude grid (origin and step as in lat_lon) on a map grid.

    target has y and x; its pixels lie at eastings and northings from corner
    (upper left) on, spacing apart. inverse takes easting and northing Columns to
    latitude and longitude, as the *_inverse functions do.
    """
    lat, lon = inverse(corner[0] + (F.col("x") + 0.5) * spacing, corner[1] - (F.col("y") + 0.5) * spacing)
    return Product(resample(source, target, (lon - origin[1]) / step[1], (origin[0] - lat) / step[0], band, method), height, width, source.meta)


def elevation_at(points: DataFrame, lat: Column, lon: Column, dem: Product, band: str, origin: tuple[float, float], step: tuple[float, float], method: str = "bilinear") -> DataFrame:
    """points (y, x and what lat and lon need) with the elevation of a latitude-longitude model under them; missing outside it or beside missing samples only."""
    found = resample(dem, points, (lon - origin[1]) / step[1], (origin[0] - lat) / step[0], band, method)
    return points.join(found.select("y", "x", F.col(band).alias("elevation")), ["y", "x"], "left")


def grid(spark, height: int, width: int) -> DataFrame:
    """All (y, x) of a target raster."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("long").alias("y"), (F.col("id") % width).alias("x"))


def simulate(p: Product, elevation: str, spacing: float, look_deg: float) -> Product:
    """Backscatter 0.0118 cos a / (sin a + 0.111 cos a)^3 of slopes along the line of sight (growing x), and a mask: 1 layover (an earlier pixel's slant range is not passed), 2 shadow (hidden behind an earlier pixel), 3 both."""
    look = math.radians(look_deg)
    along = Window.partitionBy("y").orderBy("x")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    z, x = F.col(elevation).cast("double"), F.col("x") * spacing
    slope = F.atan((z - F.coalesce(F.lag(z).over(along), z)) / spacing)
    local = clip(F.lit(look) - slope, 0.0)
    power = 0.0118 * F.cos(local) / F.pow(F.sin(local) + 0.111 * F.cos(local), 3)
    slant, reach = x * math.sin(look) - z * math.cos(look), x * math.cos(look) / math.sin(look) + z
    layover = F.coalesce(slant <= F.max(slant).over(past), F.lit(False))
    hidden = F.coalesce(reach < F.max(reach).over(past), F.lit(False))
    return p.select(power.alias("sigma0"), (layover.cast("int") + 2 * hidden.cast("int")).alias("mask"))


def slant_to_ground(p: Product, band: str, coefficients: list[float], spacing: float, slant_spacing: float, width: int, first_slant: float, method: str = "bilinear") -> Product:
    """Lines resampled at slant ranges that are a polynomial of the ground distance, linearly or by another method of resample()."""
    spots = p.pixels.select("y").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).select("y", F.col("x").cast("long").alias("x"))
    d = F.col("x") * spacing
    slant = sum((F.pow(d, F.lit(i)) * float(c) for i, c in enumerate(coefficients)), F.lit(0.0))
    u = (slant - first_slant) / slant_spacing + 0.5
    return Product(resample(p, spots, u, F.col("y") + 0.5, band, method), p.height, width, p.meta)


def deskew(p: Product, band: str, absolute: int, fraction: float) -> Product:
    """Pixels move down by absolute + round(fraction x); of those that meet, the one from the later line stays."""
    y = F.col("y") + absolute + F.floor(F.col("x") * fraction + 0.5)
    moved = p.pixels.select(y.cast("long").alias("ty"), "x", "y", F.col(band).alias("v")).where(F.col("ty").between(0, p.height - 1))
    return p.with_pixels(moved.groupBy(F.col("ty").alias("y"), "x").agg(F.max_by("v", "y").alias(band)))
