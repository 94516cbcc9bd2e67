"""Terrain correction by a simulated image, with the incidence on the terrain's own facets.

Each cell of an elevation grid has a range and a line in the sensor's geometry. What
the cells send back, by the slope of their facets, is summed up to a simulated
image, which looks like the real one but for the orbit's errors; control points
between both give a polynomial, and through it each cell finds its sample. All
steps are aggregates and joins over cells; the driver holds the polynomial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..product import Product
from ..session import materialize
from .geometry import geodetic_to_ecef, grid
from .joins import resample
from .registration import _terms, ground_control_points, range_doppler, warp_fit

Vector = tuple[Column, Column, Column]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _angle(a: Vector, b: Vector) -> Column:
    """Between two vectors, in degrees; missing where one has no length."""
    size = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / F.when(size > 0, size)))))


def facets(cells: DataFrame) -> DataFrame:
    """cells (y, x, lat, lon, elevation) that have all eight neighbours, with their place (tx, ty, tz) and the normal of their facet (nx, ny, nz), which points up.

    The facet spans the points to the right and left, and above and below, each at
    the mean elevation of the three cells on that side. A cell sends its values to
    its neighbours, so this is one aggregate.
    """
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    sent = cells.where("elevation is not null and lat is not null and lon is not null").withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
    # A value that comes from (a, b) before a cell lies on the opposite side of it.
    sent = sent.select((F.col("y") + F.col("d.a")).alias("y"), (F.col("x") + F.col("d.b")).alias("x"), (-F.col("d.a")).alias("a"), (-F.col("d.b")).alias("b"), "lat", "lon", F.col("elevation").cast("double").alias("h"))
    at = lambda a, b, c: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col(c)))
    sides = {"right": (0, 1), "left": (0, -1), "down": (1, 0), "up": (-1, 0), "own": (0, 0)}
    picked = [at(a, b, c).alias(f"{n}_{c}") for n, (a, b) in sides.items() for c in ("lat", "lon")] + [at(0, 0, "h").alias("own_h")]
    picked += [F.avg(F.when(F.col("b" if b else "a") == (b or a), F.col("h"))).alias(f"{n}_h") for n, (a, b) in sides.items() if n != "own"]
    found = sent.groupBy("y", "x").agg(F.count("*").alias("n"), *picked).where("n = 9")
    for n in sides:
        found = found.withColumns(dict(zip((f"{n}_x", f"{n}_y", f"{n}_z"), geodetic_to_ecef(F.col(f"{n}_lat"), F.col(f"{n}_lon"), F.col(f"{n}_h")), strict=True)))
    point = lambda n: tuple(F.col(f"{n}_{c}") for c in "xyz")
    minus = lambda p, q: tuple(a - b for a, b in zip(p, q, strict=True))
    found = found.withColumns(dict(zip(("mx", "my", "mz"), _cross(minus(point("right"), point("left")), minus(point("down"), point("up"))), strict=True)))
    up = F.when(_dot((F.col("mx"), F.col("my"), F.col("mz")), point("own")) < 0, -1.0).otherwise(1.0)
    return found.select("y", "x", F.col("own_x").alias("tx"), F.col("own_y").alias("ty"), F.col("own_z").alias("tz"), (up * F.col("mx")).alias("nx"), (up * F.col("my")).alias("ny"), (up * F.col("mz")).alias("nz"))


def incidence(t: Vector, n: Vector, p: Vector) -> tuple[Column, Column]:
    """Angles in degrees between the line of sight (from target t to sensor p) and the facet's normal n, and its projection on the plane through target, sensor and the earth's centre."""
    s = tuple(a - b for a, b in zip(p, t, strict=True))
    m = _cross(s, t)
    share = _dot(m, n) / _dot(m, m)
    return _angle(n, s), _angle(tuple(a - share * b for a, b in zip(n, m, strict=True)), s)


def backscatter(incidence_deg: Column) -> Column:
    """0.0118 cos a / (sin a + 0.111 cos a)^3, nothing beyond a right angle."""
    a = F.radians(incidence_deg)
    return F.when(incidence_deg < 90, 0.0118 * F.cos(a) / F.pow(F.sin(a) + 0.111 * F.cos(a), 3)).otherwise(0.0)


def seen(cells: DataFrame, **geometry) -> DataFrame:
    """y, x, u and v (range and line in the sensor's image, pixel centres at .5), incidence and projected (local incidence) of the cells of facets() that the sensor passes; geometry as in range_doppler()."""
    parts = materialize(facets(cells), "facets")
    found = range_doppler(parts, sensor=True, **geometry).join(parts, ["y", "x"])
    own, projected = incidence(tuple(F.col(c) for c in ("tx", "ty", "tz")), tuple(F.col(c) for c in ("nx", "ny", "nz")), tuple(F.col(c) for c in ("px", "py", "pz")))
    return found.select("y", "x", "u", "v", own.alias("incidence"), projected.alias("projected"))


def simulated_image(places: DataFrame, height: int, width: int, band: str) -> Product:
    """What the cells of seen() send back, summed up in each pixel of the sensor's image; 0 where there is none."""
    sums = places.groupBy(F.floor("v").cast("long").alias("y"), F.floor("u").cast("long").alias("x")).agg(F.sum(backscatter(F.col("incidence"))).alias(band))
    whole = grid(places.sparkSession, height, width).join(sums, ["y", "x"], "left")
    return Product(whole.select("y", "x", F.coalesce(band, F.lit(0.0)).alias(band)), height, width)


def sarsim_terrain_correction(image: Product, band: str, cells: DataFrame, height: int, width: int, points: DataFrame | None = None, order: int = 1, method: str = "bilinear", reference_deg: float | Column | None = None, matching: dict | None = None, **geometry) -> Product:
    """The image on the elevation grid (y, x, lat, lon, elevation) of height by width cells, with incidence and projected, the local angles.

    With points (point_id, y, x of the image; options of ground_control_points() in
    `matching`), a simulated image is matched to the real one there, and a
    polynomial of the order takes simulated to real places; without, the geometry is
    trusted. With reference_deg, samples are normalised by the sine of the projected
    local incidence over that of the reference. Cells at the grid's border, without a
    neighbour, or that the sensor doesn't pass, are left out.
    """
    places = materialize(seen(cells, **geometry), "cell-places")
    u, v = F.col("u"), F.col("v")
    if points is not None:
        model = simulated_image(places, image.height, image.width, band)
        model = model.with_pixels(materialize(model.pixels, "simulated"))
        found = ground_control_points(model, image, band, points, **(matching or {}))
        cx, cy = warp_fit(found, order)
        terms = _terms(v - 0.5, u - 0.5, order)
        u, v = (sum((float(k) * t for k, t in zip(c, terms, strict=True)), F.lit(0.5)) for c in (cx, cy))
    out = resample(image, places.select("y", "x", "u", "v"), u, v, band, method).join(places.select("y", "x", "incidence", "projected"), ["y", "x"])
    if reference_deg is not None:
        reference = reference_deg if isinstance(reference_deg, Column) else F.lit(float(reference_deg))
        out = out.withColumn(band, F.col(band) * F.sin(F.radians("projected")) / F.sin(F.radians(reference)))
    return Product(out.select("y", "x", band, "incidence", "projected"), height, width, image.meta)
