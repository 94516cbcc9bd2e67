"""Registered queries over the test tables, with the SQL that gives the same rows.

The dense raster is the embeddings table (one line a vector, band v, the label
as region); intensity is v squared. Floats are rounded alike on both sides, as
sums may be taken in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue
from .functions import band_math as m
from .functions import expressions, remote_sensing
from .operators import clusters, geometry, joins, neighbourhood, pixels, radiometry, registration, statistics
from .product import Product, embeddings, product
from .sources import stores

QUERIES: dict = {}
SQL: dict[str, str] = {}

PX = """px as (select vec_id as y, cast(generate_subscripts(embedding, 1) - 1 as bigint) as x, cast(unnest(embedding) as double) as v, label from embeddings),
sz as (select max(y) + 1 as h, max(x) + 1 as w from px), ip as (select y, x, v * v as i from px)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{PX}", PX)
        return f

    return register


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def intensity(spark: SparkSession, sf_dir: str) -> Product:
    p = embeddings(spark, sf_dir)
    return p.with_pixels(p.pixels.select("y", "x", (F.col("v") * F.col("v")).alias("i")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Per-pixel operators


@query("with {PX} select y, x, case when v > 0 then v / (label + 1) else -1 end as t from px")
def bandmaths_ternary(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    q = pixels.band_maths([p], t=F.when(m.gt(F.col("v"), 0.0), m.div(F.col("v"), F.col("label") + 1)).otherwise(-1.0))
    return q.pixels


@query("with {PX} select y, x, case when label = 0 then -9 else v / label end as q, cast(trunc((y + 7) / (label + 2)) as int) as k from px")
def bandmaths_int_division(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    q = m.fill(F.when(~m.is_inf(m.div(F.col("v"), F.col("label"))), m.div(F.col("v"), F.col("label"))), -9)
    return p.select(q.alias("q"), m.int_div(F.col("y") + 7, F.col("label") + 2).alias("k")).pixels


@query("""with {PX} select y, x, floor(v * 10 + 0.5) as r, sign(v) as s, round(2 / (exp(v) + exp(-v)), 9) as sech, round(case when v > 0 then log10(v) else -99 end, 9) as lg,
round(sqrt(v * v + label * label), 9) as ampl, round(atan2(cast(label as double), v), 9) as phase, round(degrees(v), 6) as deg, round(power(10.0, v), 6) as e10, abs(v - 0.1) <= 0.05 as near, v >= -1 and v <= 1 as inr,
least(v, label * 0.1) as lo, greatest(v, label * 0.1) as hi from px""")
def expr_functions(spark, sf_dir):
    p, v, label = embeddings(spark, sf_dir), F.col("v"), F.col("label")
    log = F.when(v > 0, m.log10(v)).otherwise(-99.0)
    return p.select(
        m.round_half_up(v * 10).alias("r"), F.signum(v).alias("s"), F.round(m.sech(v), 9).alias("sech"), F.round(log, 9).alias("lg"), F.round(m.ampl(v, label), 9).alias("ampl"), F.round(m.phase(v, label), 9).alias("phase"),
        F.round(F.degrees(v), 6).alias("deg"), F.round(m.exp10(v), 6).alias("e10"), m.feq(v, 0.1, 0.05).alias("near"), m.inrange([v], [-1.0], [1.0]).alias("inr"), m.minimum(v, label * 0.1).alias("lo"), m.maximum(v, label * 0.1).alias("hi"),
    ).pixels


@query("select p_partkey, (p_size & 5) = 5 as both_set, (p_size & 8) = 8 as high from part")
def flag_predicate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", m.flag(F.col("p_size"), 5).alias("both_set"), m.flag(F.col("p_size"), 8).alias("high"))


@query("with {PX} select label, count(*) as n, round(avg(v), 9) as mean from px where v between -0.5 and 0.5 group by label")
def range_mask(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return p.pixels.where(pixels.mask_range("v", -0.5, 0.5)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"))


@query("with {PX} select y, x, v from px where y + x < 61 and x < 32 and y < 48")
def polygon_mask(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return p.pixels.where(pixels.mask_polygon([(0.0, 0.0), (32.0, 0.0), (32.0, 30.0), (14.0, 48.0), (0.0, 48.0)])).select("y", "x", "v")


@query("with {PX} select y - 10 as y, x - 8 as x, v, label from px where y between 10 and 209 and x between 8 and 39")
def subset_region(spark, sf_dir):
    return pixels.subset(embeddings(spark, sf_dir), 8, 10, 32, 200).pixels


@query("with {PX} select cast(y // 3 as bigint) as y, cast(x // 4 as bigint) as x, v, label from px where y % 3 = 0 and x % 4 = 0")
def subsample(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return pixels.subset(p, 0, 0, p.width, p.height, 4, 3).pixels


@query("with {PX} select y, w - 1 - x as x, v, label from px, sz")
def flip_horizontal(spark, sf_dir):
    return pixels.flip(embeddings(spark, sf_dir)).pixels


@query("with {PX} select h - 1 - y as y, w - 1 - x as x, v, label from px, sz")
def flip_both(spark, sf_dir):
    return pixels.flip(embeddings(spark, sf_dir), True, True).pixels


@query("with {PX} select y, x, cast(trunc(least(greatest(i * 100, 0), 255)) as bigint) as i from ip")
def convert_truncate(spark, sf_dir):
    p = intensity(spark, sf_dir).with_bands(i=F.col("i") * 100)
    return pixels.convert(p, "i", 0, 255).pixels


@query("with {PX}, e as (select min(i) as a, max(i) as b from ip) select y, x, cast(trunc((i - a) / (b - a) * 255) as bigint) as i from ip, e")
def convert_linear(spark, sf_dir):
    return pixels.convert(intensity(spark, sf_dir), "i", 0, 255, "linear").pixels


@query("with {PX} select y, x, i, round(case when i < 1e-30 then -1e-30 else 10 * log10(i) end, 9) as i_db from ip")
def linear_to_db(spark, sf_dir):
    return pixels.linear_to_db(intensity(spark, sf_dir)).pixels.select("y", "x", "i", F.round("i_db", 9).alias("i_db"))


@query("""with {PX}, t as (select y, x, v as u, label * 0.5 - 1 as l from px), q as (select y, x, case when u + l = 0 then null else (u - l) / (u + l) end as raw from t)
select y, x, round(coalesce(raw, 0), 6) as ndvi, (case when raw is null then 1 else 0 end) + (case when coalesce(raw, 0) < 0 then 2 else 0 end) + (case when coalesce(raw, 0) > 1 then 4 else 0 end) as flags from q""")
def ndvi(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    q = pixels.ndvi(p.select("v", (F.col("label") * 0.5 - 1).alias("l")), "v", "l")
    return q.pixels.select("y", "x", r6("ndvi"), "flags")


@query("with {PX} select y, x, case when label > 2 then v end as v from px")
def land_mask(spark, sf_dir):
    return pixels.land_mask(embeddings(spark, sf_dir), "label", True, 2.0).pixels.select("y", "x", "v")


@query("with {PX} select y, x, x + 0.5 - 10 as dx, y + 0.5 - 20 as dy, round(sqrt((x + 0.5 - 10) * (x + 0.5 - 10) + (y + 0.5 - 20) * (y + 0.5 - 20)), 9) as length from px")
def displacement_bands(spark, sf_dir):
    return pixels.displacement(embeddings(spark, sf_dir), 10.0, 20.0).pixels.select("y", "x", "dx", "dy", F.round("length", 9).alias("length"))


# Aggregations


@query("with {PX} select label, min(v) as lo, max(v) as hi, round(avg(v), 9) as mean, round(stddev_samp(v), 9) as sd, round(stddev_pop(v), 9) as sd_pop, count(v) as n from px group by label")
def summary_stats(spark, sf_dir):
    s = statistics.summary(embeddings(spark, sf_dir), "v", by=["label"])
    return s.select("label", "lo", "hi", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "sd_pop")], "n")


@query("select l_returnflag, min(l_extendedprice) as lo, max(l_extendedprice) as hi, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as sd, count(*) as n from lineitem where l_quantity > 10 group by l_returnflag")
def lineitem_stats(spark, sf_dir):
    """The statistics operator over scattered samples; the mask is pushed to the scan."""
    p = Product(table(spark, sf_dir, "lineitem"), 0, 0)
    s = statistics.summary(p, "l_extendedprice", F.col("l_quantity") > 10, ["l_returnflag"])
    return s.select("l_returnflag", "lo", "hi", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


@query("with {PX}, t as (select avg(i) as a, avg(i * i) as b from ip) select round(sqrt(b - a * a) / a, 9) as cv, round(a * a / (b - a * a), 9) as enl from t")
def enl_cv(spark, sf_dir):
    s = statistics.looks(intensity(spark, sf_dir), "i")
    return s.select(F.round("cv", 9).alias("cv"), F.round("enl", 9).alias("enl"))


@query("with {PX} select cast(least(floor((v + 4) / (8.0 / 512)), 511) as bigint) as bin, count(*) as n from px where v >= -4 and v <= 4 group by 1")
def histogram_512(spark, sf_dir):
    return statistics.histogram(embeddings(spark, sf_dir), "v", -4.0, 4.0)


@query("""with {PX}, b as (select cast(least(floor((v + 4) / (8.0 / 512)), 511) as bigint) as bin, count(*) as n from px where v between -4 and 4 group by 1),
r as (select bin, sum(n) over (order by bin) as run, sum(n) over () as total from b), s as (select unnest([0.05, 0.5, 0.95])::double as share)
select share, round(-4 + (min(bin) + 1) * (8.0 / 512), 9) as value from r, s where run >= share * total group by share""")
def percentiles(spark, sf_dir):
    s = statistics.percentiles(embeddings(spark, sf_dir), "v", -4.0, 4.0, [0.05, 0.5, 0.95])
    return s.select("share", F.round("value", 9).alias("value"))


@query("""with {PX}, b as (select cast(least(floor((v + 4) / (8.0 / 512)), 511) as bigint) as bin, count(*) as n from px where v between -4 and 4 group by 1),
r as (select bin, n, coalesce(sum(n) over (order by bin rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from b)
select round(-4 + (8.0 / 512) * (bin + (total / 2.0 - before) / n), 9) as median from r where before < total / 2.0 and before + n >= total / 2.0""")
def histogram_median(spark, sf_dir):
    return statistics.median(embeddings(spark, sf_dir), "v", -4.0, 4.0).select(F.round("median", 9).alias("median"))


@query("""with {PX} select cast(least(floor(a / (16.0 / 64)), 63) as bigint) as i, cast(least(floor(b / (16.0 / 64)), 63) as bigint) as j, count(*) as n
from (select p.i * 4 as a, q.i * 4 as b from ip p join ip q on p.y = q.y and p.x + 1 = q.x) where a between 0 and 16 and b between 0 and 16 group by 1, 2""")
def density_plot(spark, sf_dir):
    p = intensity(spark, sf_dir)
    q = joins.stack(p, p, 0, 1, "minimum")
    return statistics.density(q.with_bands(i=F.col("i") * 4, slv_i=F.col("slv_i") * 4), "i", "slv_i", 0.0, 16.0)


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 9) as r2 from lineitem")
def ols_regression(spark, sf_dir):
    s = statistics.regression(Product(table(spark, sf_dir, "lineitem"), 0, 0), "l_quantity", "l_extendedprice")
    return s.select(r6("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"))


@query("with {PX} select cast(y // 4 as bigint) as y, cast(x // 3 as bigint) as x, round(avg(i), 9) as i from ip, sz where y < h // 4 * 4 and x < w // 3 * 3 group by 1, 2")
def multilook_mean(spark, sf_dir):
    q = statistics.multilook(intensity(spark, sf_dir), "i", 3, 4)
    return q.pixels.select("y", "x", F.round("i", 9).alias("i"))


@query("with {PX} select cast(y // 2 as bigint) as y, cast(x // 2 as bigint) as x, round(10 * log10(avg(power(10.0, v / 10))), 9) as v from px, sz where y < h // 2 * 2 and x < w // 2 * 2 group by 1, 2")
def multilook_db(spark, sf_dir):
    q = statistics.multilook(embeddings(spark, sf_dir), "v", 2, 2, db=True)
    return q.pixels.select("y", "x", F.round("v", 9).alias("v"))


@query("""with {PX}, a as (select y // 2 as y, x // 2 as x, avg(v) as v from px, sz where y < h // 2 * 2 and x < w // 2 * 2 group by 1, 2), s2 as (select max(y) + 1 as h, max(x) + 1 as w from a)
select cast(y // 2 as bigint) as y, cast(x // 2 as bigint) as x, round(avg(v), 9) as v from a, s2 where y < h // 2 * 2 and x < w // 2 * 2 group by 1, 2""")
def pyramid_level_2(spark, sf_dir):
    return statistics.pyramid(embeddings(spark, sf_dir), "v", 2)[1].pixels.select("y", "x", F.round("v", 9).alias("v"))


@query("""with {PX}, t as (select distinct cast(p.y // 2 as bigint) as ty, cast(p.x // 2 as bigint) as tx from px p, sz where p.y < h // 2 * 2 and p.x < w // 2 * 2)
select ty as y, tx as x, round(sum(v * case when y = ty * 2 and x = tx * 2 then 4 when y = ty * 2 or x = tx * 2 then 2 else 1 end / 16), 9) as v
from t join px on px.y between ty * 2 - 1 and ty * 2 + 1 and px.x between tx * 2 - 1 and tx * 2 + 1 group by 1, 2""")
def undersample_kernel(spark, sf_dir):
    q = statistics.undersample(embeddings(spark, sf_dir), "v", 2, 2, [[1, 2, 1], [2, 4, 2], [1, 2, 1]])
    return q.pixels.select("y", "x", F.round("v", 9).alias("v"))


@query("with {PX} select round(sum(a), 6) as total, round(min(a), 9) as least, round(max(a), 9) as most, round(avg(a), 9) as mean, count(*) as n from (select cos(radians((y + 0.5) / 10)) as a from px where v > 0)")
def mask_area(spark, sf_dir):
    s = statistics.mask_area(embeddings(spark, sf_dir), F.col("v") > 0, F.cos(F.radians(m.pixel_y() / 10)))
    return s.select(r6("total"), *[F.round(c, 9).alias(c) for c in ("least", "most", "mean")], "n")


# Neighbourhoods


def _boxes(h: int, band: str = "i", source: str = "ip") -> str:
    """CTE bx: for each pixel the values of its box, borders repeated."""
    side = f"(select unnest(range(-{h}, {h + 1})) as d)"
    return f"""bx as (select p.y, p.x, any_value(p.{band}) as c, avg(q.{band}) as m, stddev_samp(q.{band}) as s, list(q.{band} order by q.{band}) as l
from {source} p cross join sz cross join {side} a cross join {side} b join {source} q on q.y = least(greatest(p.y + a.d, 0), h - 1) and q.x = least(greatest(p.x + b.d, 0), w - 1) group by p.y, p.x)"""


@query(f"with {{PX}}, {_boxes(1)} select y, x, round(m, 9) as i from bx")
def box_mean_3x3(spark, sf_dir):
    return neighbourhood.box_mean(intensity(spark, sf_dir), "i").pixels.select("y", "x", F.round("i", 9).alias("i"))


@query(f"with {{PX}}, {_boxes(1)} select y, x, l[5] as i from bx")
def box_median_3x3(spark, sf_dir):
    return neighbourhood.rank_filter(intensity(spark, sf_dir), "i", "median").pixels


@query(f"with {{PX}}, {_boxes(2)} select y, x, l[25] as i from bx")
def rank_max_5x5(spark, sf_dir):
    return neighbourhood.rank_filter(intensity(spark, sf_dir), "i", "max", 2).pixels


@query(f"with {{PX}}, {_boxes(1)} select y, x, round(s, 6) as i from bx")
def rank_stddev_3x3(spark, sf_dir):
    return neighbourhood.rank_filter(intensity(spark, sf_dir), "i", "stddev").pixels.select("y", "x", r6("i"))


@query(f"with {{PX}}, {_boxes(1)} select y, x, round(case when m = 0 or s / abs(m) <= 0.5 then m else c * (1 - 0.25 / (s / m * s / m)) + m * 0.25 / (s / m * s / m) end, 6) as i from bx")
def lee(spark, sf_dir):
    return neighbourhood.lee(intensity(spark, sf_dir), "i", 1, 4.0).pixels.select("y", "x", r6("i"))


@query(f"""with {{PX}}, {_boxes(1)}, t as (select *, s / nullif(abs(m), 0) as ci from bx), u as (select *, 1.25 / nullif(ci * ci - 0.25, 0) as al from t)
select y, x, round(case when ci is null or ci <= 0.5 then m when ci < sqrt(2) * 0.5 then ((al - 5) * m + sqrt(greatest(m * m * (al - 5) * (al - 5) + 16 * al * m * c, 0))) / (2 * al) else c end, 6) as i from u""")
def gamma_map(spark, sf_dir):
    return neighbourhood.gamma_map(intensity(spark, sf_dir), "i", 1, 4.0).pixels.select("y", "x", r6("i"))


@query("""with {PX}, d as (select unnest(range(-1, 2)) as d), bx as (select p.y, p.x, q.i as i, greatest(abs(a.d), abs(b.d)) as k from ip p cross join sz cross join d a cross join d b
join ip q on q.y = least(greatest(p.y + a.d, 0), h - 1) and q.x = least(greatest(p.x + b.d, 0), w - 1)), s as (select y, x, 2 * var_samp(i) / (avg(i) * avg(i)) as f from bx group by y, x)
select y, x, round(sum(i * exp(-f * k)) / sum(exp(-f * k)), 6) as i from bx join s using (y, x) group by y, x""")
def frost(spark, sf_dir):
    return neighbourhood.frost(intensity(spark, sf_dir), "i", 1, 2.0).pixels.select("y", "x", r6("i"))


@query()
def refined_lee(spark, sf_dir):
    return neighbourhood.refined_lee(intensity(spark, sf_dir), "i").pixels


@query("""with {PX}, d as (select unnest(range(-1, 2)) as d) select p.y, p.x, round(sum(q.v * a.d * (2 - abs(b.d))), 9) as v from px p cross join sz cross join d a cross join d b
join px q on q.y = least(greatest(p.y + a.d, 0), h - 1) and q.x = least(greatest(p.x + b.d, 0), w - 1) group by p.y, p.x""")
def kernel_sobel(spark, sf_dir):
    k, d = neighbourhood.KERNELS["sobel_north"]
    return neighbourhood.kernel_filter(embeddings(spark, sf_dir), "v", k, d).pixels.select("y", "x", F.round("v", 9).alias("v"))


@query("""with {PX}, o as (select a.d as dy, b.d as dx from (select unnest(range(-4, 5)) as d) a, (select unnest(range(-4, 5)) as d) b),
s as (select p.y, p.x, any_value(p.i) as i, avg(q.i) filter (where greatest(abs(dy), abs(dx)) <= 1) as t, avg(q.i) filter (where greatest(abs(dy), abs(dx)) > 2) as m, stddev_pop(q.i) filter (where greatest(abs(dy), abs(dx)) > 2) as s
from ip p cross join o join ip q on q.y = p.y + dy and q.x = p.x + dx group by p.y, p.x) select y, x, i, cast(t > m + 3.090232306167813 * s as int) as detected from s""")
def cfar_detect(spark, sf_dir):
    return neighbourhood.ring_detect(intensity(spark, sf_dir), "i", 1, 2, 4, 1e-3).pixels


@query("""with {PX}, o as (select a.d as dy, b.d as dx from (select unnest(range(-3, 4)) as d) a, (select unnest(range(-3, 4)) as d) b)
select p.y, p.x, any_value(p.i) as i, cast(any_value(p.i) < avg(q.i) / power(10, 0.2) as int) as detected from ip p cross join o join ip q on q.y = p.y + dy and q.x = p.x + dx group by p.y, p.x""")
def oil_spill_detect(spark, sf_dir):
    return neighbourhood.oil_spill(intensity(spark, sf_dir), "i", 3, 2.0).pixels


@query("""with {PX}, g as (select y, x, case when (y * 7 + x * 3) % 11 > 2 then v end as v from px),
f as (select *, last_value(case when v is not null then x end ignore nulls) over lx as xa, last_value(v ignore nulls) over lx as va, first_value(case when v is not null then x end ignore nulls) over rx as xb, first_value(v ignore nulls) over rx as vb,
last_value(case when v is not null then y end ignore nulls) over ly as ya, last_value(v ignore nulls) over ly as wa, first_value(case when v is not null then y end ignore nulls) over ry as yb, first_value(v ignore nulls) over ry as wb from g
window lx as (partition by y order by x rows between unbounded preceding and 1 preceding), rx as (partition by y order by x rows between 1 following and unbounded following),
ly as (partition by x order by y rows between unbounded preceding and 1 preceding), ry as (partition by x order by y rows between 1 following and unbounded following)),
t as (select y, x, v, va + (vb - va) * (x - xa) / (xb - xa) as a, wa + (wb - wa) * (y - ya) / (yb - ya) as b from f)
select y, x, round(coalesce(v, case when a is not null and b is not null then (a + b) / 2 else coalesce(a, b) end), 9) as v from t""")
def fill_hole(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    q = p.select(F.when((F.col("y") * 7 + F.col("x") * 3) % 11 > 2, F.col("v")).alias("v"))
    return neighbourhood.fill_holes(q, "v").pixels.select("y", "x", F.round("v", 9).alias("v"))


@query("""with {PX}, two as (select y, x, i, i + label + 1 as j from px join ip using (y, x)), d as (select unnest(range(-1, 2)) as d),
mm as (select p.y, p.x, any_value(p.i) as i, any_value(p.j) as j, avg(q.i) as mi, avg(q.j) as mj from two p cross join sz cross join d a cross join d b join two q on q.y = least(greatest(p.y + a.d, 0), h - 1) and q.x = least(greatest(p.x + b.d, 0), w - 1) group by p.y, p.x)
select y, x, round(mi * (i / mi + j / mj) / 2, 6) as i, round(mj * (i / mi + j / mj) / 2, 6) as j from mm""")
def multitemporal_speckle(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    q = p.select((F.col("v") * F.col("v")).alias("i"), (F.col("v") * F.col("v") + F.col("label") + 1).alias("j"))
    return neighbourhood.multitemporal_speckle(q, ["i", "j"]).pixels.select("y", "x", r6("i"), r6("j"))


@query("""with {PX}, path as (select unnest(range(0, 41)) as k) select k as path_idx, round(avg(v), 9) as mean, round(stddev_samp(v), 9) as sd, count(v) as n
from path join px on y between 10 + k - 1 and 10 + k + 1 and x between 5 + cast(floor(k / 2 + 0.5) as int) - 1 and 5 + cast(floor(k / 2 + 0.5) as int) + 1 group by 1""")
def transect_profile(spark, sf_dir):
    path = spark.createDataFrame(neighbourhood.line_points([(5, 10), (25, 50)]), "path_idx long, y long, x long")
    s = neighbourhood.transect(embeddings(spark, sf_dir), "v", path)
    return s.select("path_idx", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "n")


@query()
def oversample(spark, sf_dir):
    return neighbourhood.oversample(embeddings(spark, sf_dir), "v").pixels


# Missing samples

_HOLES = "hp as (select y, x, case when (y * 7 + x * 3) % 11 > 2 then v end as v from px)"


def _holed(spark, sf_dir) -> Product:
    p = embeddings(spark, sf_dir)
    return p.select(F.when((F.col("y") * 7 + F.col("x") * 3) % 11 > 2, F.col("v")).alias("v"))


@query(f"with {{PX}}, {_HOLES}, {_boxes(1, 'v', 'hp')} select y, x, round(m, 9) as v from bx")
def box_mean_holes(spark, sf_dir):
    return neighbourhood.box_mean(_holed(spark, sf_dir), "v").pixels.select("y", "x", F.round("v", 9).alias("v"))


@query(f"""with {{PX}}, {_HOLES}, {_boxes(1, 'v', 'hp')}, f as (select y, x, c, s, list_filter(l, lambda e: e is not null) as l from bx)
select y, x, l[len(l) // 2 + 1] as median, l[1] as lo, l[-1] as hi, round(s, 6) as sd from f""")
def rank_holes(spark, sf_dir):
    p, out = _holed(spark, sf_dir), None
    for kind, name in (("median", "median"), ("min", "lo"), ("max", "hi"), ("stddev", "sd")):
        part = neighbourhood.rank_filter(p, "v", kind).pixels.withColumnRenamed("v", name)
        out = part if out is None else out.join(part, ["y", "x"])
    return out.withColumn("sd", r6("sd"))


@query(f"""with {{PX}}, {_HOLES}, {_boxes(1, 'v', 'hp')}, t as (select *, s / nullif(abs(m), 0) as ci from bx)
select y, x, round(case when ci is null or ci <= 0.5 then m else c * (1 - 0.25 / (ci * ci)) + m * 0.25 / (ci * ci) end, 6) as v from t""")
def lee_holes(spark, sf_dir):
    return neighbourhood.lee(_holed(spark, sf_dir), "v", 1, 4.0).pixels.select("y", "x", r6("v"))


@query(f"""with {{PX}}, {_HOLES}, d as (select unnest(range(-1, 2)) as d), b as (select p.y, p.x, any_value(p.v) as c, avg(q.v) as m from hp p cross join sz cross join d a cross join d b
join hp q on q.y = least(greatest(p.y + a.d, 0), h - 1) and q.x = least(greatest(p.x + b.d, 0), w - 1) group by p.y, p.x)
select p.y, p.x, round(sum(case when p.c is not null then coalesce(q.v, p.m) * a.d * (2 - abs(b.d)) end), 6) as v from b p cross join sz cross join d a cross join d b
join hp q on q.y = least(greatest(p.y + a.d, 0), h - 1) and q.x = least(greatest(p.x + b.d, 0), w - 1) group by p.y, p.x""")
def kernel_holes(spark, sf_dir):
    k, d = neighbourhood.KERNELS["sobel_north"]
    return neighbourhood.kernel_filter(_holed(spark, sf_dir), "v", k, d).pixels.select("y", "x", r6("v"))


@query(f"""with {{PX}}, {_HOLES}, uv as (select y, x, x * 0.75 + 1.3 as u, y * 0.5 + 2.2 as v from px), t as (select y, x, floor(u - 0.5) as a, floor(v - 0.5) as b, u - 0.5 - floor(u - 0.5) as s, v - 0.5 - floor(v - 0.5) as t from uv, sz where u >= 0 and u < w and v >= 0 and v < h),
k as (select unnest([0, 1]) as i), n as (select t.y, t.x, least(greatest(a + k.i, 0), w - 1) as sx, least(greatest(b + l.i, 0), h - 1) as sy, (case k.i when 0 then 1 - s else s end) * (case l.i when 0 then 1 - t else t end) as wt from t, sz, k, k l)
select n.y, n.x, round(sum(wt * v) / nullif(sum(case when v is not null then wt end), 0), 6) as v from n join hp p on p.y = sy and p.x = sx group by 1, 2""")
def bilinear_holes(spark, sf_dir):
    p = _holed(spark, sf_dir)
    out = joins.resample(p, p.pixels.select("y", "x"), F.col("x") * 0.75 + 1.3, F.col("y") * 0.5 + 2.2, "v", "bilinear")
    return out.select("y", "x", r6("v"))


# Joins


@query("with {PX} select y, x, v, label, i from px join ip using (y, x)")
def merge_bands(spark, sf_dir):
    return joins.merge(embeddings(spark, sf_dir), intensity(spark, sf_dir)).pixels


@query("with {PX} select p.y, p.x, p.i, coalesce(q.i, -1) as slv_i from ip p left join ip q on q.y = p.y + 5 and q.x = p.x - 3")
def stack_offset(spark, sf_dir):
    p = intensity(spark, sf_dir)
    return joins.stack(p, p, 5, -3, no_data=-1.0).pixels


@query("with {PX} select coalesce(p.y, q.y - 5) as y, coalesce(p.x, q.x + 3) as x, p.i, q.i as slv_i from ip p full join ip q on q.y = p.y + 5 and q.x = p.x - 3")
def stack_maximum(spark, sf_dir):
    p = intensity(spark, sf_dir)
    return joins.stack(p, p, 5, -3, "maximum").pixels


_UV = "uv as (select y, x, x * 0.75 + 1.3 as u, y * 0.5 + 2.2 as v from px)"


def _at(spark, sf_dir, method):
    p = embeddings(spark, sf_dir)
    out = joins.resample(p, p.pixels.select("y", "x"), F.col("x") * 0.75 + 1.3, F.col("y") * 0.5 + 2.2, "v", method)
    return out.select("y", "x", F.round("v", 9).alias("v"))


@query(f"with {{PX}}, {_UV} select t.y, t.x, round(p.v, 9) as v from uv t join px p on p.x = floor(u) and p.y = floor(t.v)")
def resample_nearest(spark, sf_dir):
    return _at(spark, sf_dir, "nearest")


@query(f"""with {{PX}}, {_UV}, t as (select y, x, floor(u - 0.5) as a, floor(v - 0.5) as b, u - 0.5 - floor(u - 0.5) as s, v - 0.5 - floor(v - 0.5) as t from uv, sz where u >= 0 and u < w and v >= 0 and v < h),
k as (select unnest([0, 1]) as i), n as (select t.y, t.x, least(greatest(a + k.i, 0), w - 1) as sx, least(greatest(b + l.i, 0), h - 1) as sy, (case k.i when 0 then 1 - s else s end) * (case l.i when 0 then 1 - t else t end) as wt from t, sz, k, k l)
select n.y, n.x, round(sum(wt * v), 9) as v from n join px p on p.y = sy and p.x = sx group by 1, 2""")
def resample_bilinear(spark, sf_dir):
    return _at(spark, sf_dir, "bilinear")


@query(f"""with {{PX}}, {_UV}, t as (select y, x, floor(u - 0.5) as a, floor(v - 0.5) as b, u - 0.5 - floor(u - 0.5) as s, v - 0.5 - floor(v - 0.5) as t from uv, sz where u >= 0 and u < w and v >= 0 and v < h),
k as (select unnest([0, 1, 2, 3]) as i), n as (select t.y, t.x, least(greatest(a + k.i - 1, 0), w - 1) as sx, least(greatest(b + l.i - 1, 0), h - 1) as sy,
 (case k.i when 0 then -s + 2*s*s - s*s*s when 1 then 2 - 5*s*s + 3*s*s*s when 2 then s + 4*s*s - 3*s*s*s else -s*s + s*s*s end) / 2 * (case l.i when 0 then -t + 2*t*t - t*t*t when 1 then 2 - 5*t*t + 3*t*t*t when 2 then t + 4*t*t - 3*t*t*t else -t*t + t*t*t end) / 2 as wt from t, sz, k, k l)
select n.y, n.x, round(sum(wt * v), 9) as v from n join px p on p.y = sy and p.x = sx group by 1, 2""")
def resample_cubic(spark, sf_dir):
    return _at(spark, sf_dir, "cubic")


@query(f"""with {{PX}}, {_UV}, t as (select y, x, greatest(0, least(w - 1, floor(u - 0.5))) as a, greatest(0, least(h - 1, floor(v - 0.5))) as b, u - 0.5 - floor(u - 0.5) as s, v - 0.5 - floor(v - 0.5) as t from uv, sz where u >= 0 and u < w and v >= 0 and v < h),
k as (select unnest([0, 1, 2, 3]) as i), n as (select t.y, t.x, least(greatest(a + k.i - 1, 0), w - 1) as sx, least(greatest(b + l.i - 1, 0), h - 1) as sy,
 (case k.i when 0 then -s + 2*s*s - s*s*s when 1 then 2 - 5*s*s + 3*s*s*s when 2 then s + 4*s*s - 3*s*s*s else -s*s + s*s*s end) / 2 * (case l.i when 0 then -t + 2*t*t - t*t*t when 1 then 2 - 5*t*t + 3*t*t*t when 2 then t + 4*t*t - 3*t*t*t else -t*t + t*t*t end) / 2 as wt from t, sz, k, k l)
select n.y, n.x, round(sum(wt * v), 9) as v from n join px p on p.y = sy and p.x = sx group by 1, 2""")
def resample_bicubic(spark, sf_dir):
    return _at(spark, sf_dir, "bicubic")


@query(f"""with {{PX}}, {_UV}, t as (select y, x, floor(u - 0.5) as a, floor(v - 0.5) as b, u - 0.5 - floor(u - 0.5) as s, v - 0.5 - floor(v - 0.5) as t from uv, sz where u >= 0 and u < w and v >= 0 and v < h),
k as (select unnest([-2, -1, 0, 1, 2]) as i), e as (select t.*, k.i as i, l.i as j, s - k.i as p, t - l.i as q from t, k, k l),
f as (select *, case when p = 0 then 1 when abs(p) <= 2.5 then sin(pi() * p) / (pi() * p) * (1 + cos(pi() * p / 3)) / 2 else 0 end * case when q = 0 then 1 when abs(q) <= 2.5 then sin(pi() * q) / (pi() * q) * (1 + cos(pi() * q / 3)) / 2 else 0 end as wt from e),
n as (select y, x, least(greatest(a + i, 0), w - 1) as sx, least(greatest(b + j, 0), h - 1) as sy, wt from f, sz)
select n.y, n.x, round(sum(wt * v) / sum(wt), 9) as v from n join px p on p.y = sy and p.x = sx group by 1, 2""")
def resample_sinc(spark, sf_dir):
    return _at(spark, sf_dir, "sinc")


@query("with {PX}, n as (select y, x, least(greatest(x + 2, 0), w - 1) as sx, y as sy from px, sz where x + 2.5 < w) select n.y, n.x, p.v from n join px p on p.y = sy and p.x = sx")
def warp_shift(spark, sf_dir):
    return joins.warp(embeddings(spark, sf_dir), "v", [2.0, 1.0], [0.0, 0.0, 1.0], "nearest").pixels


@query("""with {PX}, e as (select y, x, i, cast(least(x + 1, w - x, y + 1, h - y) as double) as k from ip, sz), a as (select y, x, i, k from e union all select y + 100, x + 20, i, k from e)
select y, x, round(sum(k * i) / sum(k), 9) as i, count(*) as count from a group by y, x""")
def mosaic_weighted(spark, sf_dir):
    p = intensity(spark, sf_dir)
    return joins.mosaic([(p, 0, 0), (p, 100, 20)], "i").select("y", "x", F.round("i", 9).alias("i"), "count")


@query("""with {PX}, s as (select avg(i) as m, stddev_samp(i) as d from ip), a as (select y, x, (i - m) / d as i from ip, s union all select y + 100, x + 20, (i - m) / d from ip, s)
select y, x, round(avg(i), 6) as i, count(*) as count from a group by y, x""")
def mosaic_normalised(spark, sf_dir):
    p = intensity(spark, sf_dir)
    return joins.mosaic([(p, 0, 0), (p, 100, 20)], "i", weighted=False, normalise=True).select("y", "x", r6("i"), "count")


@query("""with {PX}, a as (select y, x, v, label from px union all select y + 30, x + 10, v, label from px)
select y, x, round(avg(case when v > 0 or label = 1 then v end), 9) as m, count(case when v > 0 or label = 1 then v end) as m_count, cast(sum(cast(v > 0 as bigint)) as bigint) as pos, cast(sum(cast(label = 1 as bigint)) as bigint) as one from a group by y, x""")
def mosaic_conditions(spark, sf_dir):
    a = embeddings(spark, sf_dir).pixels
    rows = a.unionByName(a.withColumns({"y": F.col("y") + 30, "x": F.col("x") + 10}))
    out = joins.mosaic_overlap(rows, {"m": F.col("v")}, {"pos": F.col("v") > 0, "one": F.col("label") == 1})
    return out.withColumn("m", F.round("m", 9))


@query("""with {PX}, a as (select y, x, v from px union all select y + 30, x, v from px union all select y, x + 10, v from px) select y, x, round(avg(v), 9) as v, count(*) as v_count from a group by y, x""")
def mosaic_update(spark, sf_dir):
    """A stored mosaic of two sources, brought up to date with a third."""
    a = embeddings(spark, sf_dir).pixels.select("y", "x", "v")
    part = lambda df: joins.mosaic_overlap(df, {"v": F.col("v")}, {})
    old, new = part(a.unionByName(a.withColumn("y", F.col("y") + 30))), part(a.withColumn("x", F.col("x") + 10))
    return joins.mosaic_update(old, new, ["v"]).withColumn("v", F.round("v", 9))


@query("with {PX} select y, x, i from ip union all select y + h, x, i from ip, sz")
def merge_slices(spark, sf_dir):
    p = intensity(spark, sf_dir)
    return joins.merge_slices([p, p]).pixels


@query("with {PX}, c as (select y // 4 as cy, x // 4 as cx, avg(i) as m from ip, sz where y < h // 4 * 4 and x < w // 4 * 4 group by 1, 2) select p.y, p.x, p.i, round(m, 9) as rr_i from ip p left join c on cy = p.y // 4 and cx = p.x // 4")
def coarse_to_fine(spark, sf_dir):
    p = intensity(spark, sf_dir)
    out = joins.coarse_to_fine(p, statistics.multilook(p, "i", 4, 4), 4).pixels
    return out.withColumn("rr_i", F.round("rr_i", 9))


@query("""with r as (select ts as t, avg(value) as v from events where event_type = 'click' group by 1), s as (select t as t0, v as v0, lead(t) over (order by t) as t1, lead(v) over (order by t) as v1 from r)
select event_id, round(v0 + (epoch_us(ts) - epoch_us(t0)) / cast(epoch_us(t1) - epoch_us(t0) as double) * (v1 - v0), 6) as value_at from events e join s on s.t0 <= e.ts and e.ts < s.t1 where event_type = 'purchase'""")
def asof_orbit(spark, sf_dir):
    """Values of one kind of event as state vectors, interpolated at the times of another kind."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("t"), "value")
    records = e.where("event_type = 'click'").select("t", "value")
    out = joins.bracket(records, e.where("event_type = 'purchase'").select("event_id", "t"), "t", ["value"])
    return out.select("event_id", r6("value_at"))


@query("""with b as (select user_id, cast(epoch_us(ts) // 86400000000 as bigint) as day, value as i, value / 2 as q, row_number() over (partition by user_id, epoch_us(ts) // 86400000000 order by value * value + value * value / 4 desc, value desc) as k from events)
select user_id, day, i, q from b where k = 1""")
def deburst_peak(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).cast("long").alias("day"), F.col("value").alias("i"), (F.col("value") / 2).alias("q"))
    return radiometry.deburst_peak(e, ["user_id", "day"], "i", "q")


@query("with {PX} select y, x, round(10 * log10(greatest(i * sin(radians(30 + x * 0.1)) / 1000, 1e-30)), 6) as sigma0_db, round(i * sin(radians(30 + x * 0.1)) / 1000 / cos(radians(30 + x * 0.1)), 12) as gamma0 from ip")
def calibrate(spark, sf_dir):
    p = intensity(spark, sf_dir)
    angle = 30 + F.col("x") * 0.1
    s = radiometry.sigma0_asar(F.col("i"), angle, 1000.0)
    return p.select(F.round(radiometry.to_db(s), 6).alias("sigma0_db"), F.round(radiometry.gamma0(s, angle), 12).alias("gamma0")).pixels


# Geometry

_ANGLES = "g as (select c_custkey, (c_custkey * 37 % 1600) / 10.0 - 79.95 as lat, (c_custkey * 53 % 3600) / 10.0 - 179.95 as lon from customer)"


def _places(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 1600) / 10.0 - 79.95).alias("lat"), ((F.col("c_custkey") * 53 % 3600) / 10.0 - 179.95).alias("lon"))


@query(f"with {_ANGLES}, n as (select *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(radians(lat)) * sin(radians(lat))) as n from g) select c_custkey, round(n * cos(radians(lat)) * cos(radians(lon)), 3) as ex, round(n * cos(radians(lat)) * sin(radians(lon)), 3) as ey, round(n * (1 - 0.0066943799901413165) * sin(radians(lat)), 3) as ez from n")
def geodetic_to_ecef(spark, sf_dir):
    x, y, z = geometry.geodetic_to_ecef(F.col("lat"), F.col("lon"))
    return _places(spark, sf_dir).select("c_custkey", F.round(x, 3).alias("ex"), F.round(y, 3).alias("ey"), F.round(z, 3).alias("ez"))


@query(f"with {_ANGLES} select c_custkey, round(6378137.0 * radians(lon - 10) * cos(radians(lat)), 3) as e, round(6378137.0 * radians(lat), 3) as n from g")
def sinusoidal_projection(spark, sf_dir):
    e, n = geometry.sinusoidal(F.col("lat"), F.col("lon"), 10.0)
    return _places(spark, sf_dir).select("c_custkey", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


@query(f"""with {_ANGLES}, g2 as (select c_custkey, radians(lat) as p, radians(lon / 60) as d, 0.0066943799901413165 as e2 from g), c as (select *, e2 / (1 - e2) as ep, 6378137.0 / sqrt(1 - e2 * sin(p) * sin(p)) as n, tan(p) * tan(p) as t, e2 / (1 - e2) * cos(p) * cos(p) as c, d * cos(p) as a,
6378137.0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * power(e2, 3) / 256) * p - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * power(e2, 3) / 1024) * sin(2 * p) + (15 * e2 * e2 / 256 + 45 * power(e2, 3) / 1024) * sin(4 * p) - (35 * power(e2, 3) / 3072) * sin(6 * p)) as m from g2)
select c_custkey, round(500000 + 0.9996 * n * (a + (1 - t + c) * power(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * power(a, 5) / 120), 2) as e,
round(0.9996 * (m + n * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * power(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * power(a, 6) / 720)), 2) as n, true as exact from c""")
def utm_round_trip(spark, sf_dir):
    """Positions in the zone around 9 degrees east, and the error of a trip to earth-centred coordinates and back."""
    g = _places(spark, sf_dir).withColumn("lon", F.col("lon") / 60 + 9)
    e, n = geometry.transverse_mercator(F.col("lat"), F.col("lon"), 9.0)
    lat, lon, h = geometry.ecef_to_geodetic(*geometry.geodetic_to_ecef(F.col("lat"), F.col("lon")))
    return g.select("c_custkey", F.round(e, 2).alias("e"), F.round(n, 2).alias("n"), ((F.abs(lat - F.col("lat")) < 1e-7) & (F.abs(lon - F.col("lon")) < 1e-7) & (F.abs(h) < 1e-2)).alias("exact"))


@query(f"with {_ANGLES}, d as (select c_custkey, sin(radians(lat - 45) / 2) as s, sin(radians(lon - 7) / 2) as t, lat from g) select c_custkey, round(2 * 6371008.8 * asin(least(1, sqrt(s * s + cos(radians(45)) * cos(radians(lat)) * t * t))), 2) as metres from d")
def great_circle(spark, sf_dir):
    return _places(spark, sf_dir).select("c_custkey", F.round(geometry.great_circle(F.lit(45.0), F.lit(7.0), F.col("lat"), F.col("lon")), 2).alias("metres"))


@query(f"""with recursive {_ANGLES}, c as (select c_custkey, 1 / 298.257223563 as f, atan((1 - 1 / 298.257223563) * tan(radians(45))) as u, atan((1 - 1 / 298.257223563) * tan(radians(lat))) as v, radians(lon - 7) as l from g),
t as (select c_custkey, f, u, v, l, l as lam, 0 as k from c union all
 select c_custkey, f, u, v, l, l + (1 - cc) * f * sa * (acos(cs) + cc * sqrt(1 - cs * cs) * (m + cc * cs * (2 * m * m - 1))), k + 1 from
 (select *, f / 16 * (1 - sa * sa) * (4 + f * (4 - 3 * (1 - sa * sa))) as cc, cs - 2 * sin(u) * sin(v) / (1 - sa * sa) as m from
  (select *, cos(u) * cos(v) * sin(lam) / sqrt(1 - cs * cs) as sa from (select *, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) as cs from t where k < 25)))),
r as (select *, cs - 2 * sin(u) * sin(v) / q as m, q * 0.0066943799901413165 / (1 - 0.0066943799901413165) as e from
 (select *, 1 - power(cos(u) * cos(v) * sin(lam) / sqrt(1 - cs * cs), 2) as q from (select *, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) as cs from t where k = 25))),
d as (select *, e / 1024 * (256 + e * (-128 + e * (74 - 47 * e))) as b, sqrt(1 - cs * cs) as sn from r)
select c_custkey, round(6378137.0 * (1 - f) * (1 + e / 16384 * (4096 + e * (-768 + e * (320 - 175 * e)))) * (acos(cs) - b * sn * (m + b / 4 * (cs * (2 * m * m - 1) - b / 6 * m * (4 * sn * sn - 3) * (4 * m * m - 3)))), 2) as metres,
round(((degrees(atan2(cos(v) * sin(lam), cos(u) * sin(v) - sin(u) * cos(v) * cos(lam))) % 360) + 360) % 360, 6) as heading, true as exact from d where abs(l) < radians(170)""")
def geodesic(spark, sf_dir):
    """Distance and direction from a place to others, and whether the way so described leads there."""
    g = _places(spark, sf_dir).where(F.abs(F.col("lon") - 7) < 170).withColumns({"lat1": F.lit(45.0), "lon1": F.lit(7.0)})
    g = geometry.travel(geometry.geodesic(g, "lat1", "lon1", "lat", "lon"), "lat1", "lon1", "distance", "heading")
    turn = F.abs(F.col("to_lon") - F.col("lon"))
    exact = (F.abs(F.col("to_lat") - F.col("lat")) < 1e-7) & (F.least(turn, 360 - turn) < 1e-7)
    return g.select("c_custkey", F.round("distance", 2).alias("metres"), F.round("heading", 6).alias("heading"), exact.alias("exact"))


@query("""with {PX}, z as (select y, x, i * 20 as z from ip), s as (select y, x, z, atan((z - coalesce(lag(z) over (partition by y order by x), z)) / 10.0) as sl, x * 10 * sin(radians(40)) - z * cos(radians(40)) as sr, x * 10 * cos(radians(40)) / sin(radians(40)) + z as sh from z),
t as (select y, x, greatest(radians(40) - sl, 0) as a, coalesce(sr <= max(sr) over w, false) as lay, coalesce(sh < max(sh) over w, false) as hid from s window w as (partition by y order by x rows between unbounded preceding and 1 preceding))
select y, x, round(0.0118 * cos(a) / power(sin(a) + 0.111 * cos(a), 3), 6) as sigma0, cast(lay as int) + 2 * cast(hid as int) as mask from t""")
def sar_simulation(spark, sf_dir):
    p = intensity(spark, sf_dir).with_bands(z=F.col("i") * 20)
    return geometry.simulate(p, "z", 10.0, 40.0).pixels.select("y", "x", r6("sigma0"), "mask")


@query("""with {PX}, t as (select y, x, 100 + 0.6 * x + 0.001 * x * x as sl from px where x < 60), u as (select y, x, (sl - 100) / 1.0 as s from t), v as (select y, x, floor(s) as a, s - floor(s) as f from u, sz where s + 0.5 < w)
select v.y, v.x, round((1 - f) * p.i + f * q.i, 9) as i from v cross join sz join ip p on p.y = v.y and p.x = a join ip q on q.y = v.y and q.x = least(a + 1, w - 1)""")
def slant_to_ground(spark, sf_dir):
    q = geometry.slant_to_ground(intensity(spark, sf_dir), "i", [100.0, 0.6, 0.001], 1.0, 1.0, 60, 100.0)
    return q.pixels.select("y", "x", F.round("i", 9).alias("i"))


@query("with {PX} select y + 4 + cast(floor(x * 0.1 + 0.5) as bigint) as y, x, i from ip, sz where y + 4 + floor(x * 0.1 + 0.5) < h")
def deskew(spark, sf_dir):
    return geometry.deskew(intensity(spark, sf_dir), "i", 4, 0.1).pixels


# Clusters


def _bands(spark, sf_dir) -> Product:
    p = embeddings(spark, sf_dir)
    q = joins.stack(p.select("v"), p.select("v"), 0, 1, "minimum")
    return q


@query()
def kmeans(spark, sf_dir):
    return clusters.kmeans(_bands(spark, sf_dir), ["v", "slv_v"], 4, 10)[0].pixels


_ROUND = """a{r} as (select b.*, arg_min(k, struct_pack(d := (a - ma) * (a - ma) + (b - mb) * (b - mb), k := k)) as k from b, m{r} group by all),
m{n} as (select m.k, coalesce(avg(a), any_value(ma)) as ma, coalesce(avg(b), any_value(mb)) as mb from m{r} m left join a{r} using (k) group by m.k),
"""


@query("with {PX}, b as (select p.y, p.x, p.v as a, q.v as b from px p join px q on q.y = p.y and q.x = p.x + 1), m0 as (select * from (values (0, -1.0, -1.0), (1, 0.5, 0.0), (2, 2.0, 1.5)) t(k, ma, mb)),\n" + "".join(_ROUND.format(r=r, n=r + 1) for r in range(4)) + """n as (select k, count(*) as n from a3 group by k), o as (select k, row_number() over (order by n desc, k) - 1 as class from n),
l as (select b.*, arg_min(k, struct_pack(d := (a - ma) * (a - ma) + (b - mb) * (b - mb), k := class)) as k from b, m4 join o using (k) group by all)
select y, x, cast(class as int) as class from l join o using (k)""")
def kmeans_given_means(spark, sf_dir):
    """Four rounds from given means."""
    return clusters.kmeans(_bands(spark, sf_dir), ["v", "slv_v"], 3, 4, means=[[-1.0, -1.0], [0.5, 0.0], [2.0, 1.5]])[0].pixels


@query()
def em_clusters(spark, sf_dir):
    return clusters.gaussian_mixture(_bands(spark, sf_dir), ["v", "slv_v"], 2, 5)[0].pixels


@query("""with {PX}, b as (select p.y, p.x, p.v as a, q.v as b from px p join px q on q.y = p.y and q.x = p.x + 1), c as (select covar_pop(a, a) as aa, covar_pop(a, b) as ab, covar_pop(b, b) as bb from b),
l as (select *, (aa + bb) / 2 + sqrt(power((aa - bb) / 2, 2) + ab * ab) as top from c), u as (select ab / sqrt(ab * ab + power(top - aa, 2)) as x, (top - aa) / sqrt(ab * ab + power(top - aa, 2)) as y from l),
s as (select x * g as x, y * g as y, -y * k as x2, x * k as y2 from (select x, y, case when abs(x) >= abs(y) then sign(x) else sign(y) end as g, case when abs(y) >= abs(x) then sign(-y) else sign(x) end as k from u)),
t as (select b.y, b.x, a * s.x + b * s.y as p, a * s.x2 + b * s.y2 as q from b, s) select y, x, round(p - min(p) over (), 6) as pc0, round(q - min(q) over (), 6) as pc1 from t""")
def pca(spark, sf_dir):
    return clusters.pca(_bands(spark, sf_dir), ["v", "slv_v"], 2)[0].pixels.select("y", "x", r6("pc0"), r6("pc1"))


@query("""with {PX}, b as (select p.y, p.x, case when (p.y * 7 + p.x) % 13 <> 0 then p.v end as a, q.v as b from px p join px q on q.y = p.y and q.x = p.x + 1), c as (select covar_pop(a, a) as aa, covar_pop(a, b) as ab, covar_pop(b, b) as bb from b where a is not null),
l as (select *, (aa + bb) / 2 + sqrt(power((aa - bb) / 2, 2) + ab * ab) as top from c), u as (select ab / sqrt(ab * ab + power(top - aa, 2)) as x, (top - aa) / sqrt(ab * ab + power(top - aa, 2)) as y from l),
s as (select x * g as x, y * g as y, -y * k as x2, x * k as y2 from (select x, y, case when abs(x) >= abs(y) then sign(x) else sign(y) end as g, case when abs(y) >= abs(x) then sign(-y) else sign(x) end as k from u)),
t as (select b.y, b.x, a * s.x + b * s.y as p, a * s.x2 + b * s.y2 as q from b, s) select y, x, round(p - min(p) over (), 6) as pc0, round(q - min(q) over (), 6) as pc1 from t""")
def pca_holes(spark, sf_dir):
    """Principal components of pixels of which some lack a band: they stay, and are missing."""
    p = _bands(spark, sf_dir)
    p = p.with_bands(v=F.when((F.col("y") * 7 + F.col("x")) % 13 != 0, F.col("v")))
    return clusters.pca(p, ["v", "slv_v"], 2)[0].pixels.select("y", "x", r6("pc0"), r6("pc1"))


@query("""with {PX} select p.y, p.x, round((p.v + q.v) / 2 + (p.v - q.v) / 2, 9) as abundance0, round((p.v + q.v) / 2 - (p.v - q.v) / 2, 9) as abundance1 from px p join px q on q.y = p.y and q.x = p.x + 1""")
def unmixing(spark, sf_dir):
    import numpy as np

    q = clusters.unmix(_bands(spark, sf_dir), ["v", "slv_v"], np.eye(2))
    return q.pixels.select("y", "x", F.round("abundance0", 9).alias("abundance0"), F.round("abundance1", 9).alias("abundance1"))


@query("""with recursive {PX}, o as (select y, x from ip where i > 0.06), p as (select y, x, y * w + x as id from o, sz), e as (select a.id as u, b.id as v from p a join p b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1),
r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u) select p.y, p.x, min(v) as label from p join r on r.u = p.id group by 1, 2""")
def components(spark, sf_dir):
    return clusters.components(intensity(spark, sf_dir), F.col("i") > 0.06)


_LABELS = """with recursive {PX}, o as (select y, x, i from ip where CONDITION), p as (select y, x, i, y * w + x as id from o, sz), e as (select a.id as u, b.id as v from p a join p b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1),
r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u), l as (select p.y, p.x, any_value(p.i) as i, min(v) as label from p join r on r.u = p.id group by 1, 2)"""


@query(_LABELS.replace("CONDITION", "i > 0.06") + """, b as (select label, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1, count(*) as n, round(sum(i), 6) as total from l group by label)
select *, round(sqrt((y1 - y0 + 1) * (y1 - y0 + 1) + (x1 - x0 + 1) * (x1 - x0 + 1)), 9) as diagonal from b where sqrt((y1 - y0 + 1) * (y1 - y0 + 1) + (x1 - x0 + 1) * (x1 - x0 + 1)) between 2 and 60""")
def object_discrimination(spark, sf_dir):
    found = clusters.objects(intensity(spark, sf_dir), F.col("i") > 0.06, "i", 2.0, 60.0)
    return found.withColumn("total", r6("total")).withColumn("diagonal", F.round("diagonal", 9))


# Catalogue


@query("""select o_orderkey, o_orderdate, o_orderstatus, c_mktsegment from orders join customer on o_custkey = c_custkey
where o_orderstatus in ('O', 'F') and c_mktsegment like 'B%' and o_orderdate between timestamp '1994-01-01' and timestamp '1996-12-31' and not o_orderpriority like '5%' and o_totalprice > 50000""")
def catalog_query(spark, sf_dir):
    q = catalogue.Query(any_of={"o_orderstatus": ["O", "F"]}, prefixes={"c_mktsegment": ["B"]}, not_under={"o_orderpriority": ["5"]}, between={"o_orderdate": (F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))}, where="o_totalprice > 50000")
    products = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    meta = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return catalogue.select(products, q, meta).select("o_orderkey", "o_orderdate", "o_orderstatus", "c_mktsegment")


@query("select distinct c_mktsegment from customer")
def catalog_distinct(spark, sf_dir):
    return catalogue.distinct(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def catalog_by_nation(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select l_orderkey as y, cast(l_linenumber as bigint) as x, round(avg(l_quantity), 6) as quantity, round(avg(l_discount), 9) as discount from lineitem group by 1, 2")
def grid_samples(spark, sf_dir):
    """Scattered samples gridded to a sparse two-band product."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("y"), F.col("l_linenumber").cast("long").alias("x")).agg(r6(F.avg("l_quantity"), "quantity"), F.round(F.avg("l_discount"), 9).alias("discount"))
    return product(rows, 0, 0).pixels


@query()
def wind_field(spark, sf_dir):
    p = intensity(spark, sf_dir)
    return registration.wind_field(p.with_bands(i=F.col("i") * 0.1), "i", 30.0, 16)


@query()
def gcp_selection(spark, sf_dir):
    """Control points on a grid, between the raster and itself moved by two lines and a column."""
    p = embeddings(spark, sf_dir).select("v")
    q = p.with_pixels(p.pixels.select((F.col("y") + 2).alias("y"), (F.col("x") + 1).alias("x"), "v"))
    points = geometry.grid(spark, p.height // 32, p.width // 16).select((F.col("y") * 1000 + F.col("x")).alias("point_id"), (F.col("y") * 32 + 16).alias("y"), (F.col("x") * 16 + 8).alias("x"))
    return registration.ground_control_points(p, q, "v", points, half=8)


@query()
def terrain_correction(spark, sf_dir):
    """The raster as a slant-range image, on a grid of targets abeam of a straight flight."""
    p = embeddings(spark, sf_dir).select("v")
    # a state each ten lines, from before the first line to beyond the last one
    states = [(float(t), (0.0, 10.0 * t, 5000.0), (0.0, 10.0, 0.0)) for t in range(-10, p.height + 20, 10)]
    targets = p.pixels.select("y", "x", (F.lit(3000.0) + F.col("x") * 10).alias("tx"), (F.col("y") * 10.0).alias("ty"), (F.col("v") * 5).alias("tz"))
    out = registration.terrain_correction(p, "v", targets, p.height, p.width, states=states, first_line=0.0, line_time=1.0, near_range=5830.0, range_spacing=6.0)
    return out.pixels


# More of the inventory


@query("with {PX} select case when y < ceil(h / 2.0) then 0 else 2 end + case when x < ceil(w / 2.0) then 0 else 1 end as tile, count(*) as n, round(sum(v), 6) as total from px, sz group by 1")
def tile_writer(spark, sf_dir):
    """What each of four sub-products of the tile writer holds."""
    p = embeddings(spark, sf_dir)
    return p.pixels.groupBy(stores.tile_name(p, 4).alias("tile")).agg(F.count("*").alias("n"), r6(F.sum("v"), "total"))


@query("""with {PX}, b as (select y, x, cast(greatest(0, least(255, floor((v + 4) / 8 * 256))) as int) as r, cast(greatest(0, least(255, floor(v * v / 8 * 256 + 128))) as int) as g from px)
select y, sum(r) as red, sum(g) as green, count(*) * 3 as n from b group by y""")
def rgb_lines(spark, sf_dir):
    """Sums of the red and green bytes of each line of an image, from its bands."""
    p = embeddings(spark, sf_dir).select("v", (F.col("v") * F.col("v")).alias("i"))
    rows = stores.image_rows(p, "v", "i", "v", -4.0, 4.0)
    at = lambda k: F.aggregate(F.filter("rgb", lambda x, i: i % 3 == k), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("y", at(0).alias("red"), at(1).alias("green"), F.size("rgb").cast("long").alias("n"))


@query("with {PX} select y, x, round(power(10.0, v / 10), 9) as v from px")
def db_to_linear(spark, sf_dir):
    p = pixels.db_to_linear(embeddings(spark, sf_dir).select("v"), "v")
    return p.pixels.withColumn("v", F.round("v", 9))


@query("with {PX} select p.y, p.x, p.i, q.i as slv_i from ip p join ip q on q.y = p.y - 7 and q.x = p.x + 2")
def stack_minimum(spark, sf_dir):
    p = intensity(spark, sf_dir)
    return joins.stack(p, p, -7, 2, "minimum").pixels


@query("""with e as (select user_id, event_type, cast(epoch_us(ts) // 86400000000 as bigint) as day, case when value < 10 then 0 else value end as v from events),
g as (select user_id from e group by 1 having avg(case when v = 0 then 1.0 else 0 end) <= 0.2) select day, event_type, round(avg(v), 6) as v from e where v <> 0 and user_id in (select user_id from g) group by 1, 2""")
def deburst_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).cast("long").alias("day"), F.when(F.col("value") < 10, 0.0).otherwise(F.col("value")).alias("v"))
    return radiometry.deburst_mean(e, ["day", "event_type"], "user_id", "v", 0.0, 0.2).withColumn("v", r6("v"))


@query("""with b as (select k as burst, k * 50.0 as first, k * 50.0 + 70 as last from (select unnest(range(0, (select max(vec_id) // 50 + 1 from embeddings))) as k)), {PX}, l as (select distinct y from px), h as (select y, list({burst: burst, first: first, last: last} order by first) as b from l join b on first <= y and y < last group by y)
select y, case when len(b) > 1 and y > (b[1].last + b[2].first) / 2 then b[2].burst else b[1].burst end as burst from h""".replace("{burst: burst, first: first, last: last}", "struct_pack(burst := burst, first := first, last := last)"))
def burst_lines(spark, sf_dir):
    """Which of overlapping bursts each line comes from."""
    lines = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"))
    bursts = spark.range(embeddings(spark, sf_dir).height // 50 + 1).select(F.col("id").alias("burst"), (F.col("id") * 50.0).alias("first"), (F.col("id") * 50.0 + 70).alias("last"))
    return radiometry.burst_of_line(lines, bursts, "y")


@query(f"""with {_ANGLES}, t as (select c_custkey, radians(lat) as p, radians(lon - 10) as d from g)
select c_custkey, round(2 * 6378137.0 / (1 + sin(radians(50)) * sin(p) + cos(radians(50)) * cos(p) * cos(d)) * cos(p) * sin(d), 2) as e,
round(2 * 6378137.0 / (1 + sin(radians(50)) * sin(p) + cos(radians(50)) * cos(p) * cos(d)) * (cos(radians(50)) * sin(p) - sin(radians(50)) * cos(p) * cos(d)), 2) as n from t where 1 + sin(radians(50)) * sin(p) + cos(radians(50)) * cos(p) * cos(d) > 0.1""")
def stereographic_projection(spark, sf_dir):
    g = _places(spark, sf_dir)
    p, d, c = F.radians("lat"), F.radians(F.col("lon") - 10), F.radians(F.lit(50.0))
    e, n = geometry.stereographic(F.col("lat"), F.col("lon"), 50.0, 10.0)
    return g.where(1 + F.sin(c) * F.sin(p) + F.cos(c) * F.cos(p) * F.cos(d) > 0.1).select("c_custkey", F.round(e, 2).alias("e"), F.round(n, 2).alias("n"))


@query(f"""with {_ANGLES}, k as (select (sin(radians(30)) + sin(radians(60))) / 2 as n, cos(radians(30)) * cos(radians(30)) as c), t as (select c_custkey, 6378137.0 * sqrt(c + 2 * n * sin(radians(30)) - 2 * n * sin(radians(lat))) / n as r, 6378137.0 * sqrt(c + 2 * n * sin(radians(30)) - 2 * n * sin(radians(45))) / n as r0, n * radians(lon - 10) as t from g, k where lat > -20)
select c_custkey, round(r * sin(t), 2) as e, round(r0 - r * cos(t), 2) as n from t""")
def albers_projection(spark, sf_dir):
    e, n = geometry.albers(F.col("lat"), F.col("lon"), 30.0, 60.0, 45.0, 10.0)
    return _places(spark, sf_dir).where("lat > -20").select("c_custkey", F.round(e, 2).alias("e"), F.round(n, 2).alias("n"))


@query("""with {PX} select cast(p.y // 8 as bigint) as cy, round(sqrt(power(sum(p.v * q.v + p.v * p.v * q.v * q.v), 2) + power(sum(p.v * p.v * q.v - p.v * q.v * q.v), 2)) / sqrt(sum(p.v * p.v + power(p.v, 4)) * sum(q.v * q.v + power(q.v, 4))), 6) as coherence
from px p join px q on p.y = q.y and q.x = p.x + 1 group by 1""")
def coherence(spark, sf_dir):
    """Coherence of v + i v squared with its neighbour, by blocks of lines."""
    q = _bands(spark, sf_dir).pixels.select(F.floor(F.col("y") / 8).cast("long").alias("cy"), "v", (F.col("v") ** 2).alias("w"), "slv_v", (F.col("slv_v") ** 2).alias("slv_w"))
    return registration.coherence(q, ["cy"], "v", "w", "slv_v", "slv_w").withColumn("coherence", r6("coherence"))


@query("""with s as (select event_type, ts, value, row_number() over (partition by event_type order by ts) as k from events), a as (select event_type, max(case when k = 1 then value end) as v1, max(case when k = 2 then value end) as v2, max(case when k = 3 then value end) as v3 from s where k <= 3 group by 1)
select event_type, round(v1 * 0.375 + v2 * 0.75 - v3 * 0.125, 6) as v from a""")
def lagrange_states(spark, sf_dir):
    """The parabola through each kind's first three values, at places 0, 1, 2, half way between the first two."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("event_type").orderBy("ts"))
    e = table(spark, sf_dir, "events").withColumn("k", k).where("k <= 3").groupBy("event_type").agg(*[F.max(F.when(F.col("k") == i, F.col("value"))).alias(f"v{i}") for i in (1, 2, 3)])
    v = joins.lagrange([F.lit(0.0), F.lit(1.0), F.lit(2.0)], [F.col("v1"), F.col("v2"), F.col("v3")], F.lit(0.5))
    return e.select("event_type", r6(v, "v"))


@query(_LABELS.replace("CONDITION", "i < 0.0005") + """, c as (select label, count(*) as n from l group by label having count(*) >= 3) select y, x, label, n from l join c using (label)""")
def oil_spill_clusters(spark, sf_dir):
    return clusters.drop_small(intensity(spark, sf_dir), F.col("i") < 0.0005, 3)


# Expressions as text, validity, formulas


@query("""with {PX} select y, x, case when v > 0.5 and not (label = 2 or v > 1) then v * 2 + 1 else -v end as a, 2 + 3 * label - 1 as b, case when label = 0 then -5 else v / label end as c, cast(trunc((y + 7) / (label + 2)) as int) as d,
(label & 3) = 3 as e, abs(v - 0.1) <= 0.05 as f, not (abs(v - 0.1) <= 0.05) as g, v >= -1 and v <= 1 as h, round(sqrt(v * v + label * label), 9) as i from px""")
def expr_text(spark, sf_dir):
    """Band expressions as SQL text: precedence, conditions, quotients of doubles and ints, flags, ranges."""
    q = expressions.band_maths(
        embeddings(spark, sf_dir), a="IF(v > 0.5 AND NOT (label = 2 OR v > 1), v * 2 + 1, -v)", b="2 + 3 * label - 1", c="IF(inf(bm_div(v, label)), -5, bm_div(v, label))", d="bm_idiv(int(y + 7), int(label + 2))",
        e="flag(label, 3)", f="feq(v, 0.1, 0.05)", g="fneq(v, 0.1, 0.05)", h="inrange(v, -1, 1)", i="round(ampl(v, label), 9)",
    )
    return q.pixels


@query("""with {PX}, n as (select y, x, case when label <> 1 then v end as v from px) select y, x, 1 / v as a, case when v > 0 then 'Infinity'::double when v < 0 then '-Infinity'::double when v = 0 then 'NaN'::double end as b,
case when v is not null then cast(trunc(cast(trunc(v * 10) as int) / 3.0) as int) end as c, 1 / v as d, cast(null as double) as e from n""")
def expr_text_missing(spark, sf_dir):
    """Quotients of missing samples are missing, by zero too."""
    p = embeddings(spark, sf_dir)
    p = p.with_bands(v=F.when(F.col("label") != 1, F.col("v")))
    p = p.with_bands(d=m.div(1.0, F.col("v")))
    return expressions.band_maths(p, a="bm_div(1, v)", b="bm_div(v, 0)", c="bm_idiv(int(v * 10), 3)", d="d", e="bm_div(1, null)").pixels


@query("""with {PX}, n as (select y, x, case when v < -1 then 'NaN'::double else v end as v from px)
select y, x, not isnan(v) and v < 0 as lt, not isnan(v) and v >= 0 as ge, not isnan(v) and v = v as eq, isnan(v) or abs(v) > 0.5 as ne from n""")
def expr_text_nan(spark, sf_dir):
    p = embeddings(spark, sf_dir).select(F.when(F.col("v") < -1, float("nan")).otherwise(F.col("v")).alias("v"))
    return expressions.band_maths(p, lt="bm_lt(v, 0)", ge="bm_ge(v, 0)", eq="bm_eq(v, v)", ne="fneq(v, 0, 0.5)").pixels


@query("with {PX} select y, x, case when v > -1 and label <> 1 then v + label end as a, case when v > -1 then v * 2 end as b, label + 1 as c from px")
def valid_mask_propagation(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    q = pixels.valid_maths(p, {"v": F.col("v") > -1, "label": F.col("label") != 1}, {"a": ["v", "label"], "b": ["v"]}, a=F.col("v") + F.col("label"), b=F.col("v") * 2, c=F.col("label") + 1)
    return q.pixels


@query("with {PX} select label, count(case when label <> 2 then v end) as n, round(avg(case when label <> 2 then v end), 9) as mean, sum(case when label = 2 then 1 else 0 end) as filled from px group by label")
def no_data_values(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    coded = p.with_bands(v=F.when(F.col("label") == 2, -999.0).otherwise(F.col("v")))
    clean = pixels.no_data(coded, {"v": -999.0})
    back = pixels.fill_no_data(clean.select("v", "label", F.col("v").alias("w")), {"w": -999.0})
    return back.pixels.groupBy("label").agg(F.count("v").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.sum((F.col("w") == -999.0).cast("long")).alias("filled"))


@query(f"""with {_ANGLES} select c_custkey, round((lat + 90) * pi() / (1500 * cos(radians(40))), 9) as refl, 90 - lat as elev, round(1013 * exp(-9.80665 * 1.26895 * 0.01 * (lon + 180) / 1013), 6) as press, round(7.84 / (lon + 200), 9) as depth,
round(lat + degrees(1000 * tan(radians(30)) * cos(radians(60)) / 6370997.0), 9) as clat, round(lon + degrees(1000 * tan(radians(30)) * sin(radians(60)) / (6370997.0 * cos(radians(lat)))), 9) as clon from g""")
def rs_formulas(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    clat, clon = remote_sensing.view_corrected(lat, lon, F.lit(1000.0), F.lit(30.0), F.lit(60.0))
    return _places(spark, sf_dir).select(
        "c_custkey", F.round(remote_sensing.reflectance(lat + 90, F.lit(40.0), 1500.0), 9).alias("refl"), remote_sensing.elevation_of_zenith(lat).alias("elev"), F.round(remote_sensing.pressure_at(F.lit(1013.0), lon + 180), 6).alias("press"),
        F.round(remote_sensing.koschmieder(lon + 200), 9).alias("depth"), F.round(clat, 9).alias("clat"), F.round(clon, 9).alias("clon"),
    )


@query("""with {PX}, t as (select y, x, least(greatest(v, -2), 2) as a, least(greatest(label * 1.0, 0), 4) as b from px), c as (select *, case when a < 0 then 0 else 1 end as i, case when b < 1 then 0 else 1 end as j from t),
s as (select *, case when i = 0 then (a + 2) / 2 else a / 2 end as s, case when j = 0 then b else (b - 1) / 3 end as t from c)
select y, x, round((1 - s) * (1 - t) * (10 * i + j * j) + (1 - s) * t * (10 * i + (j + 1) * (j + 1)) + s * (1 - t) * (10 * (i + 1) + j * j) + s * t * (10 * (i + 1) + (j + 1) * (j + 1)), 9) as v,
cast(greatest(0, least(15, floor((a + 2) / 4 * 16))) as int) as level, round(1 + 2 * a + 3 * b + 0.5 * a * b, 9) as surface from s""")
def lookup_tables(spark, sf_dir):
    """A table over two axes with uneven knots, a quantiser and a polynomial surface."""
    v = remote_sensing.lookup([[-2, 0, 2], [0, 1, 4]], [10 * i + j * j for i in range(3) for j in range(3)], F.col("v"), F.col("label").cast("double"))
    a, b = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("v"))), F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.col("label").cast("double")))
    surface = remote_sensing.polynomial_surface(a, b, [1, 2, 3, 0, 0.5])
    return embeddings(spark, sf_dir).select(F.round(v, 9).alias("v"), remote_sensing.quantise(F.col("v"), -2.0, 2.0, 16).alias("level"), F.round(surface, 9).alias("surface")).pixels


@query("""with {PX}, p as (select y, x, i * 100 as i from ip) select y, x, round(i * sin(radians(35)) / 50 * 2 / 9, 9) as asar, round(i * power(10.0, -8.3), 12) as alos, round(0.7 * (i - 0.1) * sin(radians(35)), 9) as tsx, round((i + 5) / (x + 1), 9) as rs2,
round(i / (4 * 3) * power(800, 2) * sin(radians(30)), 6) as csk from p""")
def calibrate_missions(spark, sf_dir):
    """The calibration models of five missions; one brings its gains as a table by column."""
    p = intensity(spark, sf_dir).with_bands(i=F.col("i") * 100)
    gains = spark.range(p.width).select(F.col("id").alias("x"), (F.col("id") + 1.0).alias("gain"))
    angle = F.lit(35.0)
    parts = {
        "asar": radiometry.calibrate(p, "i", "ENVISAT", angle, 50.0, gain=F.lit(3.0), spread=F.lit(2.0)),
        "alos": radiometry.calibrate(p, "i", "ALOS", angle, -83.0),
        "tsx": radiometry.calibrate(p, "i", "TSX-1", angle, 0.7, noise=F.lit(0.1)),
        "rs2": radiometry.calibrate(p, "i", "RS2", angle, gains=gains, offset=5.0),
        "csk": radiometry.calibrate(p, "i", "CSK", angle, 3.0, rescale=2.0, reference_range=800.0, reference_deg=30.0),
    }
    out, digits = None, {"alos": 12, "csk": 6}
    for n, df in parts.items():
        df = df.select("y", "x", F.round("sigma0", digits.get(n, 9)).alias(n))
        out = df if out is None else out.join(df, ["y", "x"])
    return out


@query("with {PX} select y, x, round(case when x % 8 <> 0 then (i + 5) / (x + 1) end, 9) as rs2 from ip")
def calibrate_missing_gain(spark, sf_dir):
    """Columns of the image without a gain stay, and are missing."""
    p = intensity(spark, sf_dir)
    gains = spark.range(p.width).where("id % 8 <> 0").select(F.col("id").alias("x"), (F.col("id") + 1.0).alias("gain"))
    return radiometry.calibrate(p, "i", "RS2", F.lit(35.0), gains=gains, offset=5.0).select("y", "x", F.round("sigma0", 9).alias("rs2"))


@query("with {PX} select y, x, round(i / cos(radians(30)), 9) as gamma0, round(i / sin(radians(30)), 9) as beta0, round(i * 9 / 2, 9) as unpatterned from ip")
def radiometric_forms(spark, sf_dir):
    i, a = F.col("i"), F.lit(30.0)
    return intensity(spark, sf_dir).select(F.round(radiometry.gamma0(i, a), 9).alias("gamma0"), F.round(radiometry.beta0(i, a), 9).alias("beta0"), F.round(radiometry.remove_antenna_pattern(i, F.lit(3.0), F.lit(2.0)), 9).alias("unpatterned")).pixels


@query(f"with {_ANGLES}, p as (select c_custkey, round(lat * 0.5 + 41, 5) as lat, round(lon / 60 + 9, 5) as lon from g) select c_custkey, " + ", ".join(f"lat as {n}_lat, lon as {n}_lon" for n in ("utm", "albers", "lambert", "stereo", "sinus", "moll")) + " from p")
def projection_round_trips(spark, sf_dir):
    """Each projection and its inverse give the place back."""
    lat, lon = F.col("lat") * 0.5 + 41, F.col("lon") / 60 + 9
    g = geometry
    there_and_back = {
        "utm": g.transverse_mercator_inverse(*g.transverse_mercator(lat, lon, 9.0), 9.0),
        "albers": g.albers_inverse(*g.albers(lat, lon, 30.0, 60.0, 45.0, 10.0), 30.0, 60.0, 45.0, 10.0),
        "lambert": g.lambert_conformal_inverse(*g.lambert_conformal(lat, lon, 30.0, 60.0, 45.0, 10.0), 30.0, 60.0, 45.0, 10.0),
        "stereo": g.stereographic_inverse(*g.stereographic(lat, lon, 50.0, 10.0), 50.0, 10.0),
        "sinus": g.sinusoidal_inverse(*g.sinusoidal(lat, lon, 10.0), 10.0),
        "moll": g.mollweide_inverse(*g.mollweide(lat, lon, 10.0), 10.0),
    }
    return _places(spark, sf_dir).select("c_custkey", *[F.round(p[i], 5).alias(f"{n}_{c}") for n, p in there_and_back.items() for i, c in enumerate(("lat", "lon"))])


@query(f"""with {_ANGLES}, k as (select ln(cos(radians(30)) / cos(radians(60))) / ln(tan(pi() / 4 + radians(60) / 2) / tan(pi() / 4 + radians(30) / 2)) as n), f as (select n, cos(radians(30)) * power(tan(pi() / 4 + radians(30) / 2), n) / n as f from k),
t as (select c_custkey, 6378137.0 * f / power(tan(pi() / 4 + radians(lat) / 2), n) as r, 6378137.0 * f / power(tan(pi() / 4 + radians(45) / 2), n) as r0, n * radians(lon - 10) as t from g, f where lat > -20) select c_custkey, round(r * sin(t), 2) as e, round(r0 - r * cos(t), 2) as n from t""")
def lambert_projection(spark, sf_dir):
    e, n = geometry.lambert_conformal(F.col("lat"), F.col("lon"), 30.0, 60.0, 45.0, 10.0)
    return _places(spark, sf_dir).where("lat > -20").select("c_custkey", F.round(e, 2).alias("e"), F.round(n, 2).alias("n"))


@query("""with {PX}, t as (select y, x, (50 - (y + 0.5) * 0.01 * 1.3) as lat, 20000 + (x + 0.5) * radians(0.013) * 6378137.0 as e from px), u as (select y, x, lat, 10 + degrees(e / (6378137.0 * cos(radians(lat)))) as lon from t),
s as (select y, x, cast(floor((50 - lat) / 0.01) as bigint) as sy, cast(floor((lon - 10.2) / 0.02) as bigint) as sx from u) select s.y, s.x, p.v from s join px p on p.y = sy and p.x = sx""")
def reproject_sinusoidal(spark, sf_dir):
    """A latitude-longitude grid on a sinusoidal map, by the projection's inverse."""
    import math

    p = embeddings(spark, sf_dir).select("v")
    metre = math.radians(0.013) * geometry.A
    q = geometry.reproject(p, "v", (50.0, 10.2), (0.01, 0.02), lambda e, n: geometry.sinusoidal_inverse(e, n, 10.0), p.pixels.select("y", "x"), p.height, p.width, (20000.0, math.radians(50.0) * geometry.A), metre, "nearest")
    return q.pixels


@query("""with {PX}, g as (select y, x, 50 - (y + 0.5) * 0.01 as lat, 10 + (x + 0.5) * 0.02 as lon from px), t as (select y, x, (lon - 10.1) / 0.05 as u, (50.02 - lat) / 0.03 as v from g),
c as (select y, x, floor(u - 0.5) as a, floor(v - 0.5) as b, u - 0.5 - floor(u - 0.5) as s, v - 0.5 - floor(v - 0.5) as t from t, sz where u >= 0 and u < w and v >= 0 and v < h), k as (select unnest([0, 1]) as i),
n as (select c.y, c.x, least(greatest(a + k.i, 0), w - 1) as sx, least(greatest(b + l.i, 0), h - 1) as sy, (case k.i when 0 then 1 - s else s end) * (case l.i when 0 then 1 - t else t end) as wt from c, sz, k, k l),
e as (select n.y, n.x, round(sum(wt * i), 6) as elevation from n join ip p on p.y = sy and p.x = sx group by 1, 2) select px.y, px.x, elevation from px left join e using (y, x)""")
def dem_lookup(spark, sf_dir):
    """Elevations of a coarser latitude-longitude model under each pixel; missing outside it."""
    p = embeddings(spark, sf_dir)
    lat, lon = geometry.lat_lon((50.0, 10.0), (0.01, 0.02))
    out = geometry.elevation_at(p.pixels.select("y", "x"), lat, lon, intensity(spark, sf_dir), "i", (50.02, 10.1), (0.03, 0.05))
    return out.select("y", "x", r6("elevation"))


@query("""with {PX} select p.y, p.x, round(p.v - coalesce(q.v, 0), 9) as v from px p cross join sz left join px q on q.y = least(p.y + 1, h - 1) and q.x = least(p.x + 1, w - 1)""")
def kernel_roberts(spark, sf_dir):
    """A kernel of an even size."""
    k, d = neighbourhood.KERNELS["roberts_north_west"]
    return neighbourhood.kernel_filter(embeddings(spark, sf_dir), "v", k, d).pixels.select("y", "x", F.round("v", 9).alias("v"))


@query("""with {PX}, b as (select p.y, p.x, p.v as a, q.v as b from px p join px q on q.y = p.y and q.x = p.x + 1), t as (select y, x, a, b, ((a - 0.5) * 1.5 + (b - 2) * -1.0) / (1.5 * 1.5 + 1) as s from b) select y, x, round(least(greatest(s, 0), 1), 6) as abundance0, round(1 - least(greatest(s, 0), 1), 6) as abundance1 from t""")
def unmixing_full(spark, sf_dir):
    """Two members, not negative and summing to one: the place on the segment between them that is nearest."""
    import numpy as np

    q = clusters.unmix_fully(_bands(spark, sf_dir), ["v", "slv_v"], np.array([[2.0, 1.0], [0.5, 2.0]]))
    return q.pixels.select("y", "x", r6("abundance0"), r6("abundance1"))


@query("""with {PX}, b as (select p.y, p.x, p.v as a, q.v as b from px p join px q on q.y = p.y and q.x = p.x + 1) select y, x, round((2 * a - 0.5 * b) / 3.5, 6) as abundance0, round((2 * b - 1 * a) / 3.5, 6) as abundance1 from b""")
def unmixing_members(spark, sf_dir):
    """Least squares with two members that are not at right angles: two bands, so the solution is exact."""
    import numpy as np

    q = clusters.unmix(_bands(spark, sf_dir), ["v", "slv_v"], np.array([[2.0, 1.0], [0.5, 2.0]]))
    return q.pixels.select("y", "x", r6("abundance0"), r6("abundance1"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then -1.0 else o_totalprice end as o_totalprice from orders where o_orderkey % 5 <> 0")
def catalog_changes(spark, sf_dir):
    """A catalogue with some rows replaced, some added again and some removed."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = rows.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(-1.0))
    return catalogue.remove(catalogue.upsert(rows, new, "o_orderkey"), rows.where("o_orderkey % 5 = 0"), "o_orderkey")


@query("""select p_partkey, case when l * g / a >= 1 then l else cast(floor(a / g + 0.5) as int) end as range_looks, case when l * g / a >= 1 then cast(floor(l * g / a + 0.5) as int) else 1 end as azimuth_looks
from (select p_partkey, p_size % 4 + 1 as l, (p_size % 7 + 1) / sin(radians(30)) as g, p_partkey % 5 + 2.0 as a from part)""")
def multilook_derivation(spark, sf_dir):
    """Looks for square pixels from slant-range spacings, of made-up sensors."""
    size = F.col("p_size")
    along, across, _ = statistics.multilook_parameters(size % 4 + 1, size % 7 + 1.0, F.col("p_partkey") % 5 + 2.0, F.lit(30.0))
    return table(spark, sf_dir, "part").select("p_partkey", along.alias("range_looks"), across.alias("azimuth_looks"))


@query("""with {PX}, b as (select unnest(range(0, 40)) as id), q as (select id, (id * 7) % 50 + 0.25 as x0, (id * 13) % 400 + 0.25 as y0, (id % 5) * 4 + 3.0 as s from b)
select q.id, count(*) as n, round(avg(v), 9) as mean from q join px on x + 0.5 > x0 and x + 0.5 < x0 + s and y + 0.5 > y0 and y + 0.5 < y0 + 3 * s and (x + 0.5 - x0) + (y + 0.5 - y0) / 3 < s group by q.id""")
def geometry_mask_join(spark, sf_dir):
    """Statistics of the pixels inside each of a table of polygons (triangles that overlap)."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    q = spark.range(40).select("id", (F.col("id") * 7 % 50 + 0.25).alias("x"), (F.col("id") * 13 % 400 + 0.25).alias("y"), (F.col("id") % 5 * 4 + 3.0).alias("s"))
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    q = q.select("id", F.array(at(x, y), at(x + s, y), at(x, y + 3 * s)).alias("points"))
    inside = joins.geometry_join(embeddings(spark, sf_dir), q, "points")
    return inside.groupBy("id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"))


@query("with {PX} select px.y, px.x, px.v, i as power, label as zone from px join ip using (y, x)")
def merge_renamed(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return joins.merge_bands(p.select("v"), [(intensity(spark, sf_dir), {"i": "power"}, None), (p, {"label": "zone"}, "lab.*")]).pixels


@query("""with {PX}, t as (select c_custkey % 64 as x0, c_custkey % 97 as y0 from customer), g as (select distinct x0, y0 from t)
select y0 as y, x0 as x, round(v, 9) as v from g join px on px.y = y0 and px.x = x0""")
def placemark_values(spark, sf_dir):
    """Band values under placemarks, which are rows with map places."""
    marks = table(spark, sf_dir, "customer").select((50.0 - (F.col("c_custkey") % 97 + 0.5) * 0.01).alias("lat"), (10.0 + (F.col("c_custkey") % 64 + 0.5) * 0.02).alias("lon")).distinct()
    out = joins.at_placemarks(embeddings(spark, sf_dir), marks, F.col("lat"), F.col("lon"), (50.0, 10.0), (0.01, 0.02))
    return out.select("y", "x", F.round("v", 9).alias("v"))
