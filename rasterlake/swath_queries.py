"""Registered queries of raster files, tie-point grids and swaths, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import mosaic_stream as mosaic_stream_
from .operators import elevation, gradient_mosaic, joins, neighbourhood, products, swath, tie_points, topsar, vectors
from .functions import remote_sensing
from .product import Product, embeddings
from .queries import SQL, query, r6
from .session import shared_dir
from .sources import dimap, raster_files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("with {PX} select y, x, v from px where y between 40 and 260 and x >= 8 and x < 40")
def raster_file_subset(spark, sf_dir):
    """One band of a file of two, of which only the lines and columns asked for are read."""
    p, path = embeddings(spark, sf_dir), _folder(spark, "raster")
    raster_files.write_raster(p, path, {"v": "<f8", "label": ">i2"}, lines=64)
    q = raster_files.read_raster(spark, raster_files.read_layout(spark, path), ["v"], split=64 * 8 * 50)
    return q.pixels.where("y between 40 and 260 and x >= 8 and x < 40")


@query("with {PX} select y, x, case when v > -2 then round(floor((v + 4) * 1000 + 0.5) * 0.001 - 4, 6) end as v, label from px")
def dimap_round_trip(spark, sf_dir):
    """A product with a scaled band of 16 bits, written with its header and read back; -2 and less is no data."""
    p, path = embeddings(spark, sf_dir), _folder(spark, "product") + ".dim"
    band = {"name": "v", "type": "int16", "unit": "1", "scale": 0.001, "offset": -4.0, "no_data": -1}
    p = p.with_pixels(p.with_bands(v=F.when(F.col("v") > -2, F.col("v"))).pixels, meta={"bands": [band]})
    dimap.write_dimap(p, path, {"label": "uint8"})
    return dimap.read_dimap(spark, path).pixels.select("y", "x", r6("v"), F.col("label").cast("int").alias("label"))


def _every(spark, sf_dir, dy: int, dx: int) -> tuple[Product, tie_points.TiePoints]:
    """Tie points from every dy-th line and dx-th column of the dense raster."""
    p = embeddings(spark, sf_dir)
    points = p.pixels.where((F.col("y") % dy == 0) & (F.col("x") % dx == 0)).select(F.expr(f"y div {dy}").alias("row"), F.expr(f"x div {dx}").alias("col"), "v")
    return p, tie_points.TiePoints(points, -(-p.height // dy), -(-p.width // dx), 0.5, 0.5, float(dx), float(dy))


@query("""with {PX}, t as (select y // 16 as r, x // 8 as c, v from px where y % 16 = 0 and x % 8 = 0), n as (select max(r) as r1, max(c) as c1 from t),
q as (select y, x, least(y // 16, r1 - 1) as r, least(x // 8, c1 - 1) as c, r1, c1 from px, n), w as (select *, x / 8.0 - c as wx, y / 16.0 - r as wy from q)
select w.y, w.x, round((a.v * (1 - wx) + b.v * wx) * (1 - wy) + (d.v * (1 - wx) + e.v * wx) * wy, 6) as v from w
join t a on a.r = w.r and a.c = w.c join t b on b.r = w.r and b.c = w.c + 1 join t d on d.r = w.r + 1 and d.c = w.c join t e on e.r = w.r + 1 and e.c = w.c + 1""")
def tie_point_bilinear(spark, sf_dir):
    """A grid of tie points over the whole raster, carried on at its border."""
    p, t = _every(spark, sf_dir, 16, 8)
    return tie_points.over(t, p.height, p.width, "v").select("y", "x", r6("v"))


@query("""with {PX}, t as (select y // 16 as r, cast(x - 28 as double) as u, v from px where y % 16 = 0 and x % 8 = 0), m as (select avg(u * u) as m2 from t),
f as (select r, avg(v) as a, sum(u * v) / sum(u * u) as b, sum((u * u - m2) * v) / sum((u * u - m2) * (u * u - m2)) as c, any_value(m2) as m2 from t, m group by r),
k as (select r, a, b, c, m2, lead(r) over (order by r) as after from f)
select y, x, round(a + b * (x + 0.5 - 28) + c * ((x + 0.5 - 28) * (x + 0.5 - 28) - m2), 6) as v from px join k on k.r = y // 16""")
def tie_point_quadratic(spark, sf_dir):
    """A parabola along each row of tie points, in force for the lines up to the next row; of centred places that lie even, its terms are orthogonal."""
    p, t = _every(spark, sf_dir, 16, 8)
    return tie_points.quadratic_at(t, p.pixels.select("y", "x"), F.col("x") + 0.5, F.col("y") + 0.5, "v").select("y", "x", r6("v"))


# A skewed swath that crosses the date line: places grow evenly with line and column.
_LAT, _LON = "50 - 0.01 * ({y}) - 0.003 * ({x})", "179.5 + 0.02 * ({x}) - 0.005 * ({y})"


def _coordinates(y: str, x: str):
    lon = F.expr(_LON.format(y=y, x=x))
    return F.expr(_LAT.format(y=y, x=x)).cast("double"), F.when(lon >= 180, lon - 360).otherwise(lon).cast("double")


@query("""with {PX}, t as (select y, x, y * 0.5 + 0.25 as fy, x * 0.5 + 0.375 as fx from px), c as (select *, cast(floor(fy) as bigint) as b, cast(floor(fx) as bigint) as a from t)
select c.y, c.x, round((p.v * (1 - fx + c.a) + q.v * (fx - c.a)) * (1 - fy + c.b) + (r.v * (1 - fx + c.a) + s.v * (fx - c.a)) * (fy - c.b), 6) as v
from c join px p on p.y = b and p.x = a join px q on q.y = b and q.x = a + 1 join px r on r.y = b + 1 and r.x = a join px s on s.y = b + 1 and s.x = a + 1""")
def collocate_swath(spark, sf_dir):
    """A band of a skewed swath across the date line on the pixels of another one, by pixel geocoding."""
    p = embeddings(spark, sf_dir)
    lat, lon = _coordinates("y", "x")
    source = p.with_bands(lat=lat, lon=lon)
    lat, lon = _coordinates("y * 0.5 + 0.25", "x * 0.5 + 0.375")
    target = p.with_pixels(p.pixels.select("y", "x", lat.alias("lat"), lon.alias("lon")))
    return swath.collocate(source, "v", swath.pixel_quads(source), target, F.col("lat"), F.col("lon")).pixels.select("y", "x", r6("v"))


@query("""with {PX}, t as (select y, x, y * 0.5 + 0.375 as fy, x * 0.5 + 0.25 as fx from px) select t.y, t.x, p.v from t, sz join px p on p.y = cast(floor(fy + 0.5) as bigint) and p.x = cast(floor(fx + 0.5) as bigint) where fy < h - 1 and fx < w - 1""")
def collocate_swath_nearest(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    lat, lon = (F.expr(e).cast("double") for e in ("10 - 0.02 * y", "20 + 0.02 * x"))
    source = p.with_bands(lat=lat, lon=lon)
    lat, lon = (F.expr(e).cast("double") for e in ("10 - 0.02 * (y * 0.5 + 0.375)", "20 + 0.02 * (x * 0.5 + 0.25)"))
    target = p.with_pixels(p.pixels.select("y", "x", lat.alias("lat"), lon.alias("lon")))
    return swath.collocate(source, "v", swath.pixel_quads(source), target, F.col("lat"), F.col("lon"), "nearest").pixels.select("y", "x", "v")


@query("""with {PX}, t as (select y, x, y * 0.5 + 0.25 as fy, x * 0.5 + 0.375 as fx from px), u as (select t.*, fy + 0.5 + (800000.0 + 10 * fx) / 149896229.0 / 0.01 as line, fx as sample from t, sz where fy + 0.5 < h - 1 and fx + 0.5 < w - 1),
c as (select u.*, cast(floor(line) as bigint) as b, cast(floor(sample) as bigint) as a from u, sz where line < h - 1 and sample < w - 1)
select c.y, c.x, round((p.v * (1 - sample + c.a) + q.v * (sample - c.a)) * (1 - line + c.b) + (r.v * (1 - sample + c.a) + s.v * (sample - c.a)) * (line - c.b), 4) + 0.0 as v
from c join px p on p.y = b and p.x = a join px q on q.y = b and q.x = a + 1 join px r on r.y = b + 1 and r.x = a join px s on s.y = b + 1 and s.x = a + 1""")
def ellipsoid_correction_gg(spark, sf_dir):
    """A slant-range raster on a map grid: tie points of place and two-way time, the time of zero Doppler moved by the signal's way."""
    p = embeddings(spark, sf_dir)
    dy, dx = 20, 9
    rows, cols = -(-p.height // dy) + 1, -(-p.width // dx) + 1
    grid = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), (F.col("id") % cols).alias("col"))

    def made(v) -> tie_points.TiePoints:
        return tie_points.TiePoints(grid.select("row", "col", v.cast("double").alias("v")), rows, cols, 0.5, 0.5, float(dx), float(dy))

    y, x = F.col("row") * dy, F.col("col") * dx
    lat, lon, ns = made(50 - 0.01 * y - 0.003 * x), made(20 + 0.02 * x - 0.005 * y), made((800_000 + 10 * x) / swath.HALF_LIGHT * 1e9)
    ty, tx = F.col("y") * 0.5 + 0.25, F.col("x") * 0.5 + 0.375
    q = swath.ellipsoid_correction_gg(p, "v", lat, lon, ns, p.pixels.select("y", "x"), p.height, p.width, 50 - 0.01 * ty - 0.003 * tx, 20 + 0.02 * tx - 0.005 * ty, 10.0, 0.0, 0.01)
    return q.pixels.select("y", "x", F.round("v", 4).alias("v"))


@query("with {PX} select y, x, round(v, 3) + 0.0 as v from px")
def mosaic_gradient(spark, sf_dir):
    """A part of the raster, with another level, slope and twist, laid over the whole: in the gradient domain its seams, and all of these, vanish."""
    p = embeddings(spark, sf_dir).select("v")
    part = p.with_pixels(p.pixels.where(F.col("y").between(20, p.height - 30) & F.col("x").between(6, 55)))
    part = part.with_bands(v=F.col("v") + 3 + 0.01 * F.col("x") - 0.002 * F.col("y") + 1e-4 * F.col("x") * F.col("y"))
    return gradient_mosaic.gradient_mosaic([(p, 0, 0), (part, 0, 0)], "v", threshold=1e-11).select("y", "x", F.round("v", 3).alias("v"))


@query("with {PX} select 2 * y as y, 3 * x as x, round(v, 6) as v from px where (y * 5 + x) % 11 <> 0")
def oversample_in_place(spark, sf_dir):
    """Oversampling keeps the samples where they were; those beside a missing one are missing."""
    p = embeddings(spark, sf_dir)
    p = p.with_bands(v=F.when((F.col("y") * 5 + F.col("x")) % 11 != 0, F.col("v")))
    q = neighbourhood.oversample(p, "v", (2, 3), tile=128)
    return q.pixels.where("y % 2 = 0 and x % 3 = 0 and v is not null").select("y", "x", r6("v"))


_TOPSAR = """with {PX}, n as (select max(y) + 1 as h, (max(y) + 1) // 50 as b from px), t as (select unnest(range(0, (b - 1) * 40 + 50)) as y, b from n), c as (select unnest(range(0, 64)) as x),
s as (select unnest([1, 2, 3]) as s), k as (select y, x, s, x - 20 * (s - 1) as sx, b from t, c, s where x between 20 * (s - 1) and 20 * (s - 1) + 23),
z as (select *, case when s = 2 then 12 - 0.01 * y else 10 + 0.01 * y + 0.1 * sx end as noise, case when y >= 40 * least(y // 40, b - 1) + 10 or y < 40 then least(y // 40, b - 1) when y > 40 * (least(y // 40, b - 1) - 1) + 45 then least(y // 40, b - 1) else least(y // 40, b - 1) - 1 end as burst from k),
m as (select z.y, z.x, z.s, z.noise, cast(floor(v * 100) as bigint) as i, cast(label as bigint) as q from z join px on px.y = burst * 50 + z.y - burst * 40 and px.x = (20 * (s - 1) + sx) % 64),
r as (select *, row_number() over (partition by y, x order by noise, s) as o, count(*) over (partition by y, x) as cnt from m),
p as (select a.y, a.x, a.i, a.q, b.i as i2, b.q as q2 from r a left join r b on b.y = a.y and b.x = a.x and b.o = 2 where a.o = 1)
select y, x, case when i * i + q * q < 300 and (i2 <> 0 or q2 <> 0) then i2 else i end as i, case when i * i + q * q < 300 and (i2 <> 0 or q2 <> 0) then q2 else q end as q from p"""


@query(_TOPSAR)
def deburst_topsar(spark, sf_dir):
    """Three sub-swaths of the dense raster, in bursts of 50 lines of which 10 overlap in time, and 4 columns in range."""
    p = embeddings(spark, sf_dir)
    n = p.height // 50
    lines = (n - 1) * 40 + 50
    noise = lambda s: [(k, [0.0, 23.0], [12 - 0.01 * k] * 2 if s == 2 else [10 + 0.01 * k, 12.3 + 0.01 * k]) for k in range(0, lines + 60, 60)]
    swaths = [topsar.SubSwath(s, 0.0, float(lines), 20.0 * (s - 1), 20.0 * (s - 1) + 23, 24, 50, 1.0, [(40.0 * b, 40.0 * b + 50) for b in range(n)], noise(s)) for s in (1, 2, 3)]
    own = F.explode(F.array(*[F.struct(F.lit(s).alias("swath"), F.pmod(F.col("x") - 20 * (s - 1), F.lit(64)).alias("sx")) for s in (1, 2, 3)]))
    samples = p.pixels.select(F.col("y").alias("sy"), F.floor(F.col("v") * 100).alias("i"), F.col("label").cast("long").alias("q"), own.alias("s")).select("s.swath", "sy", "s.sx", "i", "q").where("sx < 24")
    return topsar.deburst(samples, topsar.Target(lines, 64, 0.0, 1.0, 0.0, 1.0), swaths)


@query("""with {PX}, n as (select (max(y) + 1) // 16 as tiles from px), s as (select y, x, case when x < 16 and (y // 16) % 5 <> 4 and y < tiles * 16 then floor(v * 1000) else 0 end as s from px, n),
t as (select y, x, cast(floor(y - 0.2) as bigint) as r, cast(floor(x * 0.25 - 0.1) as bigint) as c, 0.8 as wr, x * 0.25 - 0.1 - floor(x * 0.25 - 0.1) as wc from px),
k as (select t.*, i, j from t, (select unnest([0, 1]) as i), (select unnest([0, 1]) as j))
select k.y, k.x, round(sum((case i when 1 then wr else 1 - wr end) * (case j when 1 then wc else 1 - wc end) * coalesce(s.s, 0)), 6) + 0.0 as elevation from k left join s on s.y = r + i and s.x = c + j group by 1, 2""")
def elevation_tiles(spark, sf_dir):
    """Elevations from a store of tiles of 16 by 16 samples, one under the other; each fifth has no file, and is sea, as is all around.

    So that a raster of any length fits on the globe, the tiles go on in columns
    that lie a tile apart; above each column the tile before its first one is repeated.
    """
    p, folder = embeddings(spark, sf_dir), _folder(spark, "tiles")
    n, deep = p.height // 16, 128  # tiles, and of these in a column of 128 degrees
    while deep * deep < n:
        deep *= 2
    degrees = 128 / deep
    column = Product(p.pixels.where(F.col("x") < 16).where(F.col("y") < 16 * n).select("y", "x", F.floor(F.col("v") * 1000).alias("e")), 16 * n, 16)
    raster_files.write_raster(column, f"{folder}/strips", ">i2", lines=16)
    store = elevation.TileStore(folder, degrees, 16, name="{folder}/{ns}{lat:g}{ew}{lon:g}.hgt")
    strips = raster_files.read_layout(spark, f"{folder}/strips").bands[0]
    places = {(k, k // deep, k % deep) for k in range(n)} | {(q * deep - 1, q, -1) for q in range(1, n // deep + 1)}
    targets = {f"t{k}_{q}": (k, store.path(64 - degrees * (d + 1), -170 + 2 * degrees * q)) for k, q, d in sorted(places) if k % 5 != 4}
    tiles = raster_files.Layout(16, 16, [raster_files.Band(t, [[0, strips.files[k][1]]], strips.dtype, 2, 32) for t, (k, _) in targets.items()])
    raster_files.join_strips(spark, tiles, {t: path for t, (_, path) in targets.items()})
    q, line = F.expr(f"y div {16 * deep}"), F.col("y") % (16 * deep)
    lat, lon = 64 - (line + 0.3) * degrees / 16, -170 + 2 * degrees * q + (F.col("x") * 0.25 + 0.4) * degrees / 16
    return elevation.elevation_at(p.pixels.select("y", "x"), lat, lon, store).select("y", "x", r6("elevation"))


@query("""with {PX}, q as (select s_suppkey as id, (s_suppkey * 7) % 50 + 0.25 as x0, (s_suppkey * 13) % 400 + 0.25 as y0, s_suppkey % 5 * 2 + 4.0 as s from supplier)
select id, count(*) as n, round(avg(v), 9) as mean from q join px on x + 0.5 > x0 and x + 0.5 < x0 + s and y + 0.5 > y0 and y + 0.5 < y0 + 2 * s + 1
and ((y + 0.5 < y0 + s and not (x + 0.5 > x0 + 1 and x + 0.5 < x0 + s - 1 and y + 0.5 > y0 + 1 and y + 0.5 < y0 + s - 1)) or (y + 0.5 > y0 + s + 1 and (x + 0.5 - x0) + (y + 0.5 - y0 - s - 1) < s)) group by id""")
def vector_burn(spark, sf_dir):
    """Statistics under multi-polygons given as text: a square with a hole, and a triangle below it."""
    p = embeddings(spark, sf_dir)
    q = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 50 + 0.25).alias("x"), (F.col("s_suppkey") * 13 % 400 + 0.25).alias("y"), (F.col("s_suppkey") % 5 * 2 + 4.0).alias("s"))
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    at = lambda a, b: F.concat_ws(" ", (x + a).cast("string"), (y + b).cast("string"))
    ring = lambda *c: F.concat(F.lit("("), F.concat_ws(", ", *c, c[0]), F.lit(")"))
    square = lambda a, b: ring(at(a, a), at(b, a), at(b, b), at(a, b))
    wkt = F.concat(F.lit("MULTIPOLYGON (("), square(0.0, s), F.lit(", "), square(1.0, s - 1), F.lit("), ("), ring(at(0.0, s + 1), at(s, s + 1), at(0.0, 2 * s + 1)), F.lit("))"))
    covered = vectors.burn(q.select("id", wkt.alias("wkt")), "id", "wkt", p.height, p.width)
    return covered.join(p.pixels, ["y", "x"]).groupBy("id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"))


@query("with {PX} select y, x, round((v + case when y < 200 then 3 * (v + 1) else 0 end + case when x >= 32 then 0.5 * 2 * v else 0 end) / (1 + case when y < 200 then 3 else 0 end + case when x >= 32 then 0.5 else 0 end), 6) + 0.0 as v, cast(1 + case when y < 200 then 3 else 0 end + case when x >= 32 then 0.5 else 0 end as double) as n from px")
def mosaic_stream(spark, sf_dir):
    """Three rasters with weights that arrive one after the other as a stream; the first one's batch is run again afterwards."""
    p, folder = embeddings(spark, sf_dir), _folder(spark, "stream")
    rows = p.pixels.select("y", "x", "v", F.lit(1.0).alias("w"))
    parts = [rows, rows.where("y < 200").select("y", "x", F.col("v") + 1, F.lit(3.0)).toDF("y", "x", "v", "w"), rows.where("x >= 32").select("y", "x", 2 * F.col("v"), F.lit(0.5)).toDF("y", "x", "v", "w")]
    options = {"weight": "w", "tile": 64, "compact": 2}
    for part in parts:  # the stream goes on from its checkpoint with all files of the part as one batch
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("y long, x long, v double, w double").parquet(f"{folder}/in")
        mosaic_stream_.start(stream, f"{folder}/mosaic", f"{folder}/checkpoint", once=True, **options).awaitTermination()
    mosaic_stream_.merge_batch(rows, 0, f"{folder}/mosaic", **options)
    return mosaic_stream_.current(spark, f"{folder}/mosaic").select("y", "x", r6("v"), "n")


@query("with {PX} select y - 30 as y, x - 11 as x, v from px where y between 30 and 89 and x between 11 and 40")
def product_subset_region(spark, sf_dir):
    """A product's part inside a polygon of longitudes and latitudes, with the band asked for alone."""
    p = embeddings(spark, sf_dir)
    p = p.with_bands(lat=50 - (F.col("y") + 0.5) * 0.01, lon=10 + (F.col("x") + 0.5) * 0.02)
    west, east, north, south = 10 + 11 * 0.02, 10 + 41 * 0.02, 50 - 30 * 0.01, 50 - 90 * 0.01
    q, _ = products.product_subset(p, region=f"POLYGON(({west} {south}, {east} {south}, {east} {north}, {west} {north}, {west} {south}))", bands=["v"])
    return q.pixels.select("y", "x", "v")


@query("select c_custkey, round(7000000 + 100 * t - 0.003 * t * t + 0.000001 * t * t * t, 3) as px, round(-50 + 0.25 * t, 6) + 0.0 as vx from (select c_custkey, 40 + c_custkey % 900 * cast(0.97 as double) as t from customer)")
def orbit_nearest_states(spark, sf_dir):
    """Positions and velocities between state vectors ten seconds apart, by the polynomial through the nearest eight; cubic ones come back exactly."""
    t = F.col("id") * 10.0
    states = spark.range(95).select(t.alias("t"), (7000000 + 100 * t - 0.003 * t * t + 0.000001 * t * t * t).alias("px"), (-50 + 0.25 * t).alias("vx"))
    samples = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (40 + F.col("c_custkey") % 900 * 0.97).alias("t"))
    return joins.orbit_at(samples, states, "t", ["px", "vx"]).select("c_custkey", F.round("px_at", 3).alias("px"), F.round("vx_at", 6).alias("vx"))


@query("select y, x, v from (" + SQL["lookup_tables"] + ")")
def lookup_joined(spark, sf_dir):
    """The table of lookup_tables, as rows that are joined."""
    p = embeddings(spark, sf_dir)
    table = spark.range(9).select(F.expr("id div 3").alias("a"), (F.col("id") % 3).alias("b"), (10 * F.expr("id div 3") + (F.col("id") % 3) * (F.col("id") % 3)).alias("s"))
    out = remote_sensing.lookup_joined(p.pixels, table, {"a": [-2, 0, 2], "b": [0, 1, 4]}, "s", {"a": F.col("v"), "b": F.col("label").cast("double")}, "found")
    return out.select("y", "x", F.round("found", 9).alias("v"))
