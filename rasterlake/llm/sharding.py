"""Operator 1: sharding along a Hilbert curve.

Several metadata columns are quantised to a grid, the grid's cells are put in
Hilbert order, and the sequence of rows is cut into runs of equal length. Rows
of one shard are close in every dimension, so a reader can skip shards by the
minima and maxima of several columns at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, ship


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims) of a grid with 2**bits cells a side (Skilling's transform)."""
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _ordered(df: DataFrame, name: str) -> Column:
    """A column that keeps the dimension's order: strings whole, as they are, numbers and times as doubles."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(f"`{name}`")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_seconds(F.col(f"`{name}`").cast("timestamp")).cast("double")
    return F.col(f"`{name}`").cast("double")


def string_cuts(rows: DataFrame, name: str, steps: int) -> list[str]:
    """The strings at 1/steps, 2/steps, ... of a column's rows in order, exactly; null ones apart.

    Distinct values are dealt to ranges, which are written with their numbers. What
    earlier ranges hold is one row a range; the running sum inside a range then tells
    which of its values, steps - 1 in all ranges together, are cuts.
    """
    values = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(values.repartitionByRange(parts, "value").withColumn("range", F.spark_partition_id()), "ranged-values")
    totals = ranged.groupBy("range").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    totals = totals.select("range", before.alias("before"), F.sum("m").over(Window.partitionBy(F.lit(0))).alias("total"))
    running = F.sum("n").over(Window.partitionBy("range").orderBy("value"))
    placed = ranged.withColumn("upto", running).join(totals, "range").withColumn("upto", F.col("upto") + F.col("before"))
    # A value is a cut if the running sum reaches i/steps of all rows with it and not before it, for some i from 1 to steps - 1.
    cuts = placed.where(f"least((upto * {steps}) div total, {steps - 1}) > ((upto - n) * {steps}) div total")
    return sorted((r[0] for r in cuts.select("value").collect()), key=lambda v: v.encode())


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, bits: int = 4, rows_per_group: int = 50_000) -> DataFrame:
    """df with hilbert (long), shard (int, 0 to shards-1) and slot (long, gapless from 0 in its shard).

    Law `rows`: the shards' row counts differ by one at most. Dimensions are cut
    at their quantiles into 2**bits intervals (strings by whole strings); null is the
    lowest. The grid has
    2**(bits*len(dims)) cells, whatever the input, so the table of cells that is
    joined by broadcast is bounded. A cell that holds many rows is split by a
    hash into groups of about rows_per_group rows, ranked apart; nothing is ever
    sorted in one task. Repeated rows take neighbouring slots, in any order. An
    empty table gives an empty table. Columns of df that are called hilbert,
    shard or slot are replaced.
    """
    if bits * len(dims) > 16:
        raise ValueError("the grid has more than 65,536 cells")
    df = df.drop("hilbert", "shard", "slot")
    names = df.columns
    steps = 1 << bits
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), *[_ordered(df, d).alias(f"d{i}") for i, d in enumerate(dims)])
    shares = [i / steps for i in range(1, steps)]
    texts = [i for i, d in enumerate(dims) if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [i for i in range(len(dims)) if i not in texts]
    found = row.agg(*[F.percentile_approx(f"d{i}", shares, 1000).alias(f"c{i}") for i in numbers]).first() if numbers else []
    cuts = {i: found[f"c{i}"] for i in numbers} | {i: string_cuts(row, f"d{i}", steps) for i in texts}

    def cell(i: int) -> Column:
        number = F.lit(0)
        for cut in dict.fromkeys(cuts[i] or ()):
            number = number + F.when(F.col(f"d{i}") >= F.lit(cut), 1).otherwise(0)
        return number.cast("int").alias(f"q{i}")

    q = [f"q{i}" for i in range(len(dims))]
    spread = F.pmod(F.xxhash64("r"), F.lit(1 << 30))
    row = row.select("r", *[cell(i) for i in range(len(dims))], spread.alias("spread"))

    def index(batches):
        for pdf in batches:
            yield pdf.assign(hilbert=hilbert_index(pdf[q].to_numpy(), bits) if len(pdf) else pd.Series(dtype="int64"))

    ship(row.sparkSession)
    cells = row.groupBy(*q).agg(F.count("*").alias("n")).mapInPandas(index, schema=", ".join(f"{c} int" for c in q) + ", n long, hilbert long")
    cells = cells.withColumn("groups", F.ceil(F.col("n") / rows_per_group).cast("long"))
    row = row.join(F.broadcast(cells.select(*q, "hilbert", "groups")), q)
    row = row.select("r", "hilbert", F.pmod("spread", "groups").alias("g"))
    # One row a group: its start is the cell's start and what earlier groups of the cell hold.
    groups = row.groupBy("hilbert", "g").agg(F.count("*").alias("n"))
    in_cell = Window.partitionBy("hilbert").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each cell of the grid
    starts = cells.select("hilbert", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    groups = groups.withColumn("inside", F.coalesce(F.sum("n").over(in_cell), F.lit(0))).join(F.broadcast(starts), "hilbert")
    groups = groups.select("hilbert", "g", (F.col("before") + F.col("inside")).alias("start"), "total")
    rank = F.row_number().over(Window.partitionBy("hilbert", "g").orderBy("r")) - 1
    row = row.withColumn("i", rank).join(groups, ["hilbert", "g"]).withColumn("i", F.col("i") + F.col("start"))
    shard = F.expr(f"i * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return row.withColumn("shard", shard).withColumn("slot", F.col("i") - first).select("r.*", "hilbert", F.col("shard").cast("int"), F.col("slot").cast("long"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in curve order, for readers that prune by folder and by the files' statistics."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = hilbert_shards(docs, ["source", "lang", "size"], 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
