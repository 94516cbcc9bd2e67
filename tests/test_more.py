"""Files as other programs write them, reference systems by text, orbits, tables and noise."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.functions import remote_sensing
from rasterlake.operators import clusters, crs, joins, radiometry
from rasterlake.product import product
from rasterlake.sources import stores
from test_operators import back


def test_grid_file(spark, tmp_path):
    grid = np.arange(12.0).reshape(4, 3)
    body = "\n".join(" ".join(str(v) for v in line) for line in grid)
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 4\nXLLCENTER 10.5\nyllcenter 20.5\ncellsize 1\nNODATA_value 5.0\n" + body + "\n")
    p = stores.read_grid_file(spark, str(tmp_path / "a.asc"))
    assert np.allclose(back(p), np.where(grid == 5, np.nan, grid), equal_nan=True) and p.meta == {"corner": (10.0, 20.0), "cell": 1.0}
    (tmp_path / "b.asc").write_text("ncols 3\r\nnrows 4\r\nxllcorner 0\r\nyllcorner 0\r\ncellsize 2\r\n" + body.replace("\n", "\r\n"))
    assert (back(stores.read_grid_file(spark, str(tmp_path / "b.asc"))) == grid).all()
    with pytest.raises(ValueError):
        (tmp_path / "c.asc").write_text("1 2 3\n")
        stores.read_grid_file(spark, str(tmp_path / "c.asc"))


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {k} {'x' * (k % 50)}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 7000)
    try:
        lines = stores.numbered_lines(spark, str(tmp_path / "t.txt"))
        got = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["n"], int(r["value"].split()[1])) for r in got) == [(k, k) for k in range(5000)]


def test_csv_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("#sceneRasterWidth=121\n# mission = x=1\nname:string\tlat:float\tn:int\ttime:time\na\t1.5\t7\t2010-06-01T12:45:00\nb\t\t[null]\t\nc\tbad\t3\t2010-06-01T12:48:00\nd\t1\n")
    df, about = stores.read_csv_file(spark, str(tmp_path / "p.csv"))
    assert about == {"sceneRasterWidth": "121", "mission": "x=1"}
    assert [tuple(r)[:3] for r in df.orderBy("name").collect()] == [("a", 1.5, 7), ("b", None, None), ("c", None, 3)]
    assert dict(df.dtypes) == {"name": "string", "lat": "float", "n": "int", "time": "timestamp"}


ALBERS = 'PROJCS["a", GEOGCS["WGS 84", DATUM["d", SPHEROID["s", 6378137, 298.25]], UNIT["degree", 0.0174532925199433]], PROJECTION["Albers_Conic_Equal_Area"], PARAMETER["central_meridian", 10], PARAMETER["latitude_of_origin", 45.0], PARAMETER["standard_parallel_1", 30], PARAMETER["standard_parallel_2", 60], PARAMETER["false_easting", 1000], UNIT["km", 1000.0]]'


@pytest.mark.parametrize("text", ["EPSG:4326", "epsg:32632", "EPSG:32732", ALBERS, ALBERS.replace("Albers_Conic_Equal_Area", "Lambert_Conformal_Conic_2SP"), 'PROJCS["m", PROJECTION["Mollweide"], PARAMETER["central_meridian", 5]]', 'PROJCS["t", PROJECTION["Transverse_Mercator"], PARAMETER["central_meridian", 9], PARAMETER["scale_factor", 0.9996], PARAMETER["false_easting", 500000], UNIT["m", 1]]'])
def test_projection_texts(spark, text):
    p = crs.projection(text)
    df = spark.createDataFrame([(48.0, 11.0), (41.5, 8.25)], "lat double, lon double")
    x, y = p.forward(F.col("lat"), F.col("lon"))
    df = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    a, b = p.inverse(F.col("x"), F.col("y"))
    for r in df.select("*", a.alias("a"), b.alias("b")).collect():
        assert (r["a"], r["b"]) == pytest.approx((r["lat"], r["lon"]), abs=1e-6)
    if text == ALBERS:
        from rasterlake.operators import geometry

        e, n = geometry.albers(F.col("lat"), F.col("lon"), 30.0, 60.0, 45.0, 10.0)
        assert all((r["x"], r["y"]) == pytest.approx((r["e"] / 1000 + 1000, r["n"] / 1000)) for r in df.select("*", e.alias("e"), n.alias("n")).collect())
    if text.startswith("PROJCS[\"t"):
        utm = crs.projection("EPSG:32632").forward(F.col("lat"), F.col("lon"))
        assert all((r["x"], r["y"]) == pytest.approx((r["u"], r["w"])) for r in df.select("*", utm[0].alias("u"), utm[1].alias("w")).collect())


@pytest.mark.parametrize("text", ["EPSG:1", "north", 'PROJCS["x", PROJECTION["Bonne"]]'])
def test_unknown_projections(text):
    with pytest.raises(ValueError):
        crs.projection(text)


def test_orbit_of_eight_states(spark):
    f = lambda t: 7e6 + 100 * t - 3 * t**2 + 0.01 * t**3 - 1e-5 * t**7
    rows = [(k, 10.0 * i + k, f(10.0 * i + k), float(i)) for k in (1, 2) for i in range(20)] + [(1, 1.0, f(1.0), 0.0)]
    states = spark.createDataFrame(rows, "product int, t double, px double, n double")
    samples = spark.createDataFrame([(1, 55.5), (1, 1.0), (2, 199.0), (1, 240.0), (1, None), (3, 5.0)], "product int, t double")
    got = {(r["product"], r["t"]): r for r in joins.orbit_at(samples, states, "t", ["px", "n"], ["product"]).collect()}
    assert (3, 5.0) not in got and got[1, None]["px_at"] is None
    for p, t in ((1, 55.5), (1, 1.0), (2, 199.0), (1, 240.0)):
        assert got[p, t]["px_at"] == pytest.approx(f(t), rel=1e-9)  # a polynomial of the seventh degree comes back exactly
    few = joins.orbit_at(samples.where("t = 55.5"), states.where("n < 2 and product = 1"), "t", ["px"]).first()
    assert few["px_at"] == pytest.approx(f(1.0) + (f(11.0) - f(1.0)) * 54.5 / 10)


def test_joined_table(spark):
    axes = {"a": [0.0, 1.0, 4.0, 9.0], "b": [-1.0, 0.0, 2.0], "c": [0.0, 10.0]}
    f = lambda a, b, c: a * a + 3 * b - a * b + c
    rows = [(i, j, k, f(axes["a"][i], axes["b"][j], axes["c"][k])) for i, j, k in itertools.product(range(4), range(3), range(2))]
    table = spark.createDataFrame(rows, "a int, b int, c int, v double")
    rng = np.random.default_rng(1)
    places = [tuple(map(float, p)) for p in rng.uniform([-1, -2, -3], [10, 3, 12], (50, 3))]
    df = spark.createDataFrame([(*p, k) for k, p in enumerate(places)] + [(None, 0.0, 0.0, 99)], "x double, y double, z double, k int")
    at = {"a": F.col("x"), "b": F.col("y"), "c": F.col("z")}
    plain = remote_sensing.lookup([axes[n] for n in "abc"], [r[3] for r in rows], *at.values())
    got = remote_sensing.lookup_joined(df, table, axes, "v", at, "v").join(df.select("k", plain.alias("w")), "k").where("k < 99").collect()
    assert len(got) == 50 and all(r["v"] == pytest.approx(r["w"]) for r in got)


def test_noise_by_record(spark):
    records = [(10.0, 1.0, [2.0, 1.0]), (0.0, 0.0, [1.0]), (20.0, 1.0, [4.0, 0.0, 2.0])]
    df = spark.createDataFrame([(-5.0, 3.0), (5.0, 3.0), (10.0, 3.0), (15.0, 2.0), (30.0, 3.0), (None, 1.0)], "t double, s double")
    got = [r[0] for r in df.select(radiometry.noise_by_record(records, F.col("t"), F.col("s"))).collect()]
    assert got == [1.0, pytest.approx(1.0 + (4.0 - 1.0) / 2), 4.0, pytest.approx((3.0 + 6.0) / 2), 12.0, None]


def test_unmixing_with_many_members(spark):
    rng = np.random.default_rng(3)
    e = rng.uniform(0, 1, (9, 6))
    v = rng.uniform(-0.3, 1.3, (400, 6))
    v[:9], v[9] = e, e.mean(axis=0)
    a = clusters.simplex_fit(v, e)
    assert np.allclose(a.sum(axis=1), 1) and a.min() >= 0 and np.allclose(((a @ e)[:10] - v[:10]), 0, atol=1e-6)
    slope = (a @ e - v) @ e.T  # at the best point no member's slope is under that of those in use
    level = (slope * a).sum(axis=1)
    assert (slope - level[:, None]).min() > -1e-8 and np.abs((slope - level[:, None])[a > 1e-9]).max() < 1e-7
    rows = [(0, k, *map(float, r)) for k, r in enumerate(v[:60])] + [(1, 0, None, *[0.5] * 5)]
    bands = [f"b{k}" for k in range(6)]
    p = product(spark.createDataFrame(rows, "y long, x long, " + ", ".join(f"{b} double" for b in bands)))
    got = clusters.unmix_fully(p, bands, e).pixels.orderBy("y", "x").collect()
    assert np.allclose([[r[f"abundance{k}"] for k in range(9)] for r in got[:60]], a[:60]) and got[60]["abundance0"] is None
    few = clusters.unmix_fully(p, bands, e[:4]).pixels.where("y = 0").orderBy("x").collect()
    assert np.allclose([[r[f"abundance{k}"] for k in range(4)] for r in few], clusters.simplex_fit(v[:60], e[:4]), atol=1e-6)


def test_missing_stays_missing(spark):
    """Limits don't turn a missing value into one of them."""
    from rasterlake.functions import band_math as m
    from rasterlake.operators import geometry

    c = F.col("a")
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    cells = [m.minimum(c, F.col("b")), m.maximum(F.col("b"), c), m.clip(c, 0.0, 1.0), radiometry.to_db(c), remote_sensing.quantise(c, 0.0, 1.0), remote_sensing.lookup([[0, 1]], [5, 6], c)]
    cells += [geometry.great_circle(c, F.col("b"), F.col("b"), F.col("b")), *geometry.albers_inverse(c, c, 30.0, 60.0), *geometry.stereographic_inverse(c, c, 50.0, 10.0)[:1], *geometry.mollweide_inverse(c, c), m.div(c, F.lit(0.0)), m.mod(c, F.lit(0.0)), m.int_div(c, F.lit(2))]
    assert list(df.select(*[v.alias(f"c{k}") for k, v in enumerate(cells)]).first()) == [None] * len(cells)
    assert df.select(m.clip(F.col("b") * 5, 0.0, 2.0)).first()[0] == 2.0
    assert spark.createDataFrame([(-2147483648, -1, 7)], "i int, j int, k int").select(m.int_div(F.col("i"), F.col("j")), m.int_div(F.col("k"), F.col("j"))).first()[:] == (-2147483648, -7)
