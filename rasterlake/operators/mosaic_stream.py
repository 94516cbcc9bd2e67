"""A mosaic that grows as rasters arrive.

The mosaic is kept as sums and counts of its pixels. Each micro-batch writes its
own sums by tile, to a folder that is named after the batch: a batch that is run
again overwrites what it wrote, so nothing counts twice. From time to time the
batches so far are summed up to a base; a base is in force once a mark for it is
written, last. Readers add the newest marked base and the batches after it, and a
region's tiles are the only ones they open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TILE, COMPACT = 256, 16
ROWS = "tile_y long, tile_x long, y long, x long, total double, n double"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _base(spark: SparkSession, path: str) -> int:
    """The last batch of the newest marked base; -1 if there is none."""
    if not _exists(spark, f"{path}/marks"):
        return -1
    found = spark.read.schema("upto long").parquet(f"{path}/marks").agg(F.max("upto")).first()[0]
    return -1 if found is None else found


def _pixels(rows: DataFrame) -> DataFrame:
    """Sums and counts by pixel. Tiles are dealt to as many tasks as shuffles have partitions before anything is summed, so no task holds what a large file, or a few merged partitions, have."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tile_y", "tile_x").groupBy("tile_y", "tile_x", "y", "x").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _parts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Sums and counts of the newest base and of the batches after it (up to one, if given)."""
    base = _base(spark, path)
    parts = []
    if base >= 0:
        parts.append(spark.read.schema(ROWS + ", upto long").parquet(f"{path}/bases").where(F.col("upto") == base).drop("upto"))
    if _exists(spark, f"{path}/batches"):
        later = spark.read.schema(ROWS + ", batch long").parquet(f"{path}/batches").where(F.col("batch") > base)
        parts.append((later if upto is None else later.where(F.col("batch") <= upto)).drop("batch"))
    whole = spark.createDataFrame([], ROWS)
    for p in parts:
        whole = whole.unionByName(p)
    return whole


def merge_batch(rows: DataFrame, batch: int, path: str, value: str = "v", weight: str | None = None, tile: int = TILE, compact: int = COMPACT) -> None:
    """Add rows (y, x, value and perhaps a weight) to the mosaic at path, as batch number `batch`; to do so again changes nothing. Missing values and weights, and weights of 0 or less, don't count."""
    spark = rows.sparkSession
    if batch <= _base(spark, path):
        return  # summed up already
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    counted = rows.where(F.col(value).isNotNull()).select(F.floor(F.col("y") / tile).alias("tile_y"), F.floor(F.col("x") / tile).alias("tile_x"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.col(value).cast("double") * w).alias("total"), w.alias("n")).where("n > 0")
    by_tile = lambda df: _pixels(df).sortWithinPartitions("tile_y", "tile_x", "y", "x")
    by_tile(counted).write.mode("overwrite").partitionBy("tile_y", "tile_x").parquet(f"{path}/batches/batch={batch}")
    if (batch + 1) % compact == 0:
        by_tile(_parts(spark, path, batch)).write.mode("overwrite").partitionBy("tile_y", "tile_x").parquet(f"{path}/bases/upto={batch}")
        spark.createDataFrame([(batch,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/marks")


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Run merge_batch for each micro-batch of a stream of rows; with once, up to what is there now. The checkpoint remembers which rows a batch had, so after a failure it is repeated as it was."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: merge_batch(rows, batch, path, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str, region: Column | None = None) -> DataFrame:
    """y, x, v (the weighted mean) and n (the sum of weights) of the mosaic as it is now; region is a condition on y, x, tile_y and tile_x, of which those on tiles leave files out."""
    rows = _parts(spark, path)
    rows = rows if region is None else rows.where(region)
    return _pixels(rows).select("y", "x", (F.col("total") / F.col("n")).alias("v"), "n")
