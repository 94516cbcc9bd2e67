"""Queries on tables that are longer than the test tables, or odd, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from rasterlake import swath_queries  # noqa: F401
from rasterlake.operators import gradient_mosaic, joins, mosaic_stream
from rasterlake.product import embeddings
from rasterlake.queries import QUERIES, SQL
from rasterlake.sources import raster_files


def vectors(folder, lines, seed=1, ids=None, **cells):
    """A table of embeddings of so many lines."""
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.125, (lines, 64)).astype("f4")
    for k, x in cells.items():
        v[int(k[1:])] = x
    ids = list(range(lines)) if ids is None else ids
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float32())), "label": pa.array(rng.integers(0, 10, lines), pa.int32())}), folder / "embeddings.parquet")
    return str(folder)


def differ(spark, folder, name):
    """Rows of the query, and those on either side that the other lacks."""
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    df = QUERIES[name](spark, folder)
    found = df.toArrow()
    c.sql(f"create table wanted as {SQL[name]}")
    columns = ", ".join(f'"{n}"' for n in df.columns)
    return found.num_rows, c.sql(f"(select {columns} from found except all select {columns} from wanted) union all (select {columns} from wanted except all select {columns} from found)").fetchall()


def test_quotients_of_signed_zeros_and_repeated_lines(spark, tmp_path):
    folder = vectors(tmp_path, 8, ids=[0, 1, 2, 3, 4, 5, 5, None], r2=-0.0, r3=0.0)
    assert differ(spark, folder, "expr_text_missing") == (512, [])


def test_bursts_of_a_long_scan(spark, tmp_path):
    folder = vectors(tmp_path, 6003)
    rows, odd = differ(spark, folder, "deburst_topsar")
    assert rows == ((6003 // 50 - 1) * 40 + 50) * 64 and odd == []


def test_elevations_of_more_tiles_than_a_column_holds(spark, tmp_path):
    folder = vectors(tmp_path, 16 * 129 + 5)
    assert differ(spark, folder, "elevation_tiles") == ((16 * 129 + 5) * 64, [])


@pytest.mark.parametrize("method", ["bilinear", "cubic", "bicubic", "sinc"])
def test_resampling_moves_a_row_a_pixel(spark, tmp_path, method):
    folder = vectors(tmp_path, 300, ids=[*range(298), 131, 131])
    assert differ(spark, folder, f"resample_{method}")[1] == []
    p = embeddings(spark, vectors(tmp_path, 300))
    asked = p.pixels.where("y < 290").select("y", "x", (F.col("x") * 0.75 + 1.3).alias("u"), (F.col("y") + 2.2).alias("v"))
    taps = joins._taps(p, asked, p.pixels.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").alias("s")), method)
    assert taps.count() == 290 * 64 and taps.agg(F.min("n")).first()[0] in (4, 16, 25)


@pytest.mark.parametrize("name", ["collocate_swath", "collocate_swath_nearest"])
def test_collocation_moves_points_and_not_quads(spark, tmp_path, name):
    folder = vectors(tmp_path, 2000)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, none, None)
        return {(found.apply(k).stageId(), found.apply(k).attemptId()): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    old = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were large
    try:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(v for k, v in shuffled().items() if k not in old)
    assert 0 < moved < 200 * 2000 * 64


def test_a_narrow_overlap_needs_few_rounds(spark, tmp_path, monkeypatch):
    rounds = []
    one = gradient_mosaic._round
    monkeypatch.setattr(gradient_mosaic, "_round", lambda *a: rounds.append(1) or one(*a))
    folder = vectors(tmp_path, 5000)
    assert differ(spark, folder, "mosaic_gradient") == (5000 * 64, [])
    assert len(rounds) <= 3


def test_elimination_equals_relaxation():
    rng = np.random.default_rng(3)
    for shape in ((30, 9), (7, 40), (3, 3)):
        free = rng.random(shape) < 0.8
        free[[0, -1]] = free[:, [0, -1]] = False
        free[1, 1] = True
        e = rng.normal(size=shape)
        assert np.allclose(gradient_mosaic.solve(e, free), gradient_mosaic.relax(e, free, 1e-13), atol=1e-9)


def test_no_task_writes_more_than_its_strips(spark):
    rows = spark.range(40_000 * 64).select(F.expr("id div 64").alias("y"), (F.col("id") % 64).alias("x"))
    held = raster_files.in_strips(rows, 40_000, 64, raster_files.PIXELS // 64, 1).groupBy(F.spark_partition_id()).count()
    assert held.agg(F.max("count"), F.sum("count")).first() == (raster_files.PIXELS, 40_000 * 64)


def test_a_mosaic_is_summed_by_tiles_before_it_is_summed_by_pixels(spark, tmp_path):
    folder = str(tmp_path / "mosaic")
    rows = spark.range(64 * 4096, numPartitions=1).select(F.expr("id div 64").alias("y"), (F.col("id") % 64).alias("x"), F.lit(1.0).alias("v"))
    mosaic_stream.merge_batch(rows, 0, folder, tile=64)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        held = mosaic_stream.current(spark, folder).groupBy(F.spark_partition_id()).count()
        assert held.count() > 8 and held.agg(F.sum("count")).first()[0] == 64 * 4096
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
