"""A mosaic that grows: batches, repeats, bases and regions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.operators import mosaic_stream as m
from test_operators import raster


def values(df):
    return {(r["y"], r["x"]): (r["v"], r["n"]) for r in df.collect()}


@pytest.mark.parametrize("compact", [2, 100])
def test_batches_and_repeats(spark, tmp_path, compact):
    path = str(tmp_path / "mosaic")
    assert m.current(spark, path).collect() == []
    rng = np.random.default_rng(1)
    total, n = np.zeros((6, 9)), np.zeros((6, 9))
    for batch in range(5):
        grid = rng.normal(size=(6, 9))
        grid[rng.random((6, 9)) < 0.3] = np.nan
        rows = raster(spark, grid).pixels.withColumn("w", F.when(F.col("x") == 3, F.lit(0.0)).otherwise(F.col("y") + 1.0))
        for _ in range(1 + batch % 2):  # some are run twice
            m.merge_batch(rows, batch, path, weight="w", tile=4, compact=compact)
        w = np.where(np.isnan(grid) | (np.arange(9) == 3), 0, np.arange(6)[:, None] + 1.0)
        total, n = total + np.nan_to_num(grid) * w, n + w
        got = values(m.current(spark, path))
        assert set(got) == {(y, x) for y, x in zip(*np.nonzero(n), strict=True)}
        assert all(v == pytest.approx(total[p] / n[p]) and c == n[p] for p, (v, c) in got.items())
    assert m._base(spark, path) == (3 if compact == 2 else -1)
    m.merge_batch(raster(spark, np.full((6, 9), 99.0)).pixels, 1, path, tile=4, compact=compact) if compact == 2 else None
    assert values(m.current(spark, path)) == got
    part = m.current(spark, path, F.col("tile_x") == 1)
    assert set(values(part)) == {p for p in got if 4 <= p[1] < 8} and "tile_x" in part._jdf.queryExecution().toString()


def test_stream_and_restart(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(3):
        raster(spark, np.full((3, 4), float(k))).pixels.coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("y long, x long, v double").option("maxFilesPerTrigger", 1).parquet(source)
    m.start(stream(), path, check, once=True, compact=2).awaitTermination()
    assert set(values(m.current(spark, path)).values()) == {(1.0, 3.0)}
    raster(spark, np.full((3, 4), 9.0)).pixels.coalesce(1).write.mode("append").parquet(source)
    m.start(stream(), path, check, once=True, compact=2).awaitTermination()
    assert set(values(m.current(spark, path)).values()) == {(3.0, 4.0)}
