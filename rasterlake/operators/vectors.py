"""Vector layers: tables of features with geometries as well-known text, burnt into rasters.

A polygon is burnt line by line: each edge gives the places where it crosses the
centres of the raster's lines, and between the first and second crossing, the third
and fourth, and so on, lies a run of pixels. So the work follows the edges and the
runs, not the pixels of a box, holes and parts need no rule of their own, and no
task holds a geometry's pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..product import Product

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def parts_of(wkt: Column) -> Column:
    """The rings, lines or points of a geometry as arrays of (x, y): its innermost brackets. EMPTY has none; further coordinates than two are left out."""
    inner = F.filter(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda r: F.regexp_like(r, F.lit(r"[0-9]")))
    point = lambda t: F.regexp_extract_all(t, F.lit(f"({_NUMBER})"), F.lit(1))
    pair = lambda t: F.struct(F.get(point(t), F.lit(0)).cast("double").alias("x"), F.get(point(t), F.lit(1)).cast("double").alias("y"))
    return F.transform(inner, lambda r: F.transform(F.split(r, ","), pair))


def kind_of(wkt: Column) -> Column:
    """POINT, LINESTRING or POLYGON, for single ones, rings and collections of many alike."""
    name = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    return F.when(name.endswith("POLYGON"), "POLYGON").when(name.endswith("LINESTRING") | (name == "LINEARRING"), "LINESTRING").when(name.endswith("POINT"), "POINT")


def _segments(features: DataFrame, key: str, wkt: str) -> DataFrame:
    """key, kind and the segments (x0, y0, x1, y1) of each part; a point is one of length 0, a ring is closed."""
    parts = features.select(F.col(key), kind_of(F.col(wkt)).alias("kind"), F.explode(parts_of(F.col(wkt))).alias("p")).where("kind is not null")
    closed = F.when(F.col("kind") == "POLYGON", F.concat("p", F.slice("p", 1, 1))).otherwise(F.col("p"))
    parts = parts.withColumn("p", closed)
    one = F.transform("p", lambda a: F.struct(a.alias("a"), a.alias("b")))
    many = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    s = parts.select(key, "kind", F.explode(F.when((F.col("kind") == "POINT") | (F.size("p") == 1), one).otherwise(many)).alias("s"))
    return s.select(key, "kind", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1")).where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def runs(features: DataFrame, key: str, wkt: str, height: int, width: int) -> DataFrame:
    """key, y, first and last: the runs of pixels that each feature covers inside a raster (x to the right, y down, pixel centres at .5).

    Of a polygon those whose centre is inside (on an edge: to its right or below);
    of a line all that it passes through, of a point the one that holds it. Runs of
    a line's segments can overlap. Features without a geometry give none.
    """
    s = _segments(features, key, wkt)
    # Polygons: an edge crosses the lines whose centres lie in [low, high).
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    top, bottom = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5) - 1, F.lit(height - 1))
    edges = s.where("kind = 'POLYGON' and y0 <> y1").withColumn("y", F.explode(F.when(top <= bottom, F.sequence(top, bottom)).otherwise(F.expr("cast(array() as array<bigint>)"))))
    at = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossings = edges.select(key, "y", at.alias("x")).groupBy(key, "y").agg(F.array_sort(F.collect_list("x")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(c) div 2") - 1), lambda i: F.struct(F.get("c", 2 * i).alias("a"), F.get("c", 2 * i + 1).alias("b")))
    filled = crossings.where("size(c) >= 2").select(key, "y", F.explode(pairs).alias("p")).select(key, "y", F.ceil(F.col("p.a") - 0.5).alias("first"), (F.ceil(F.col("p.b") - 0.5) - 1).alias("last"))
    # Lines and points: the stretch of each segment within each line of pixels it passes through.
    steps = s.where("kind <> 'POLYGON'").withColumn("y", F.explode(F.sequence(F.floor(low), F.floor(high)))).where(F.col("y").between(0, height - 1))
    inside = lambda v: F.greatest(F.least(v, F.col("y") + 1.0), F.col("y").cast("double"))
    along = lambda v: F.when(F.col("y0") == F.col("y1"), F.col("x0")).otherwise(F.col("x0") + (v - F.col("y0")) * F.try_divide(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    a, b = along(inside(F.col("y0"))), F.when(F.col("y0") == F.col("y1"), F.col("x1")).otherwise(along(inside(F.col("y1"))))
    passed = steps.select(key, "y", F.floor(F.least(a, b)).alias("first"), F.floor(F.greatest(a, b)).alias("last"))
    both = filled.unionByName(passed).select(key, F.col("y").cast("long").alias("y"), F.greatest("first", F.lit(0)).cast("long").alias("first"), F.least("last", F.lit(width - 1)).cast("long").alias("last"))
    return both.where("first <= last")


def burn(features: DataFrame, key: str, wkt: str, height: int, width: int) -> DataFrame:
    """key, y and x of the pixels that each feature covers, once each."""
    found = runs(features, key, wkt, height, width)
    by = Window.partitionBy(key, "y").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("first"), F.coalesce(F.max("last").over(by) + 1, F.col("first")))
    found = found.withColumn("from", fresh).where(F.col("from") <= F.col("last"))
    return found.select(key, "y", F.explode(F.sequence("from", "last")).alias("x"))


def mask(p: Product, features: DataFrame, wkt: str, name: str = "mask") -> Product:
    """p with a boolean band that tells whether any of the features covers the pixel."""
    one = features.select(F.lit(0).alias("_k"), F.col(wkt).alias("_w"), F.monotonically_increasing_id().alias("_f"))
    covered = burn(one, "_f", "_w", p.height, p.width).select("y", "x").distinct().withColumn(name, F.lit(True))
    return p.with_pixels(p.pixels.join(covered, ["y", "x"], "left").withColumn(name, F.coalesce(name, F.lit(False))))


# Names of types in the headers of feature tables.
TYPES = {"string": "string", "integer": "int", "int": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "float": "float", "double": "double", "boolean": "boolean", "date": "timestamp", "time": "timestamp"}


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A table of features and its properties.

    The file is text: lines `#name=value` are properties; the first other line names
    the type and then the attributes, each name:type, tab-separated; further lines
    are a feature's id and attributes. A header without the type's name has rows
    without ids, whose feature_id is missing. A type that isn't known (a kind of geometry)
    is text. `[null]` and an empty field are missing, as is what its type can't hold.
    Rows with a wrong number of fields are left out. The result has feature_id and
    the attributes.
    """
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    about = lines.where(F.col("value").startswith("#") & F.col("value").contains("=")).collect()  # some lines of a header
    properties = dict(r[0][1:].split("=", 1) for r in about)
    head = lines.where(~F.col("value").startswith("#") & F.col("value").rlike(r"^[^\t]+(\t[^\t:]+:[^\t]+)+$")).first()  # of the file's lines the first
    if head is None:
        raise ValueError("no header of a feature table")
    named = int(":" not in head[0].split("\t")[0])
    fields = [f.split(":", 1) for f in head[0].split("\t")[named:]]
    cells = F.split("value", "\t", -1)
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != head[0]) & (F.size(cells) == len(fields) + named))
    text = lambda i: F.when(~F.get(cells, F.lit(i)).isin("", "[null]"), F.get(cells, F.lit(i)))
    typed = [text(i + named).try_cast(TYPES[k.lower()]).alias(n) if k.lower() in TYPES else text(i + named).alias(n) for i, (n, k) in enumerate(fields)]
    return rows.select(F.get(cells, F.lit(0)).alias("feature_id") if named else F.lit(None).cast("string").alias("feature_id"), *typed), {k.strip(): v.strip() for k, v in properties.items()}
