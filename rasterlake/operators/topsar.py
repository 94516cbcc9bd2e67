"""Joining the bursts and sub-swaths of a progressive scan.

A sub-swath's lines lie burst after burst and overlap in time, its columns overlap
those of its neighbours. What the header says of a sub-swath becomes tables
of bursts and noise vectors, which lines of the target meet in buckets of time;
columns meet columns, once for each two noise vectors that follow each other. Both
meet by equi-join as the pixels that each sub-swath can give; these fetch their
samples by another one, and a target pixel chooses among its own by the lower
noise, unless that one's sample is all but empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

EMPTY = 300.0  # intensity under which the other sub-swath's sample is taken


@dataclass
class SubSwath:
    """Times in one unit for lines, and in one for slant range. bursts: (first, last) line times in order; noise: (line, pixels, values) of each vector, lines of the target counted from noise_start."""

    number: int
    first_line: float
    last_line: float
    near: float
    far: float
    samples: int
    lines_per_burst: int
    line_interval: float
    bursts: list[tuple[float, float]]
    noise: list[tuple[int, list[float], list[float]]] = field(default_factory=list)
    noise_start: float = 0.0


@dataclass
class Target:
    height: int
    width: int
    first_line: float
    line_interval: float
    near: float
    slant_step: float


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def _gaps(spark: SparkSession, swaths: list[SubSwath]) -> DataFrame:
    """Of each sub-swath the stretches of lines between noise vectors, numbered k, from the vector's line a to before the next one's, b. Before the first vector a is missing, after the last b is."""
    rows = []
    for s in swaths:
        at = [int(v[0]) for v in s.noise]
        rows += [(s.number, k, a, b) for k, (a, b) in enumerate(zip([None, *at], [*at, None], strict=True))] if at else []
    return spark.createDataFrame(rows, "swath int, k int, a long, b long")


def line_map(spark: SparkSession, target: Target, swaths: list[SubSwath]) -> DataFrame:
    """y, swath, sy, k and wy of each sub-swath that has the line's time. sy is missing between bursts; k is the stretch between noise vectors that the line is in (-1 without vectors), wy the weight of its second one.

    Of two bursts that hold a time, the second is taken after the middle of their
    overlap. Lines meet bursts in buckets of time, and noise vectors in buckets of lines.
    """
    heads = spark.createDataFrame([(s.number, float(s.first_line), float(s.last_line), s.lines_per_burst, float(s.line_interval), float(s.noise_start), bool(s.noise)) for s in swaths], "swath int, first double, last double, per int, step double, start double, noisy boolean")
    longest = max((b - a for s in swaths for a, b in s.bursts), default=1.0) or 1.0
    bucket = lambda c: F.floor(c / longest).cast("long")
    rows = [(s.number, k, float(a), float(b)) for s in swaths for k, (a, b) in enumerate(s.bursts)]
    bursts = spark.createDataFrame(rows, "swath int, burst int, a double, b double").withColumn("bucket", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("b")))))
    lines = spark.range(target.height).select(F.col("id").alias("y"), (F.lit(target.first_line) + F.col("id") * target.line_interval).alias("t"))
    asked = lines.join(F.broadcast(heads)).where((F.col("t") >= F.col("first")) & (F.col("t") <= F.col("last")))
    hits = asked.withColumn("bucket", bucket(F.col("t"))).join(bursts, ["swath", "bucket"]).where((F.col("t") >= F.col("a")) & (F.col("t") < F.col("b")))
    held = hits.groupBy("y", "swath").agg(F.array_sort(F.collect_list(F.struct("burst", "a", "b"))).alias("h"))
    one, two = F.get("h", F.lit(0)), F.get("h", F.lit(1))
    chosen = F.when(two.isNotNull() & (F.col("t") > (one["b"] + two["a"]) / 2), two).otherwise(one)
    asked = asked.join(held, ["y", "swath"], "left").withColumn("c", chosen)
    sy = F.col("c.burst") * F.col("per") + _round((F.col("t") - F.col("c.a")) / F.col("step"))
    asked = asked.select("y", "swath", sy.alias("sy"), "noisy", ((F.col("t") - F.col("start")) / target.line_interval).cast("long").alias("n"))

    size = max(1, target.height // max(1, max((len(s.noise) for s in swaths), default=1)))
    edge = asked.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    gaps = _gaps(spark, swaths).join(F.broadcast(edge)).withColumns({"low": F.coalesce("a", F.least("b", "least")), "high": F.coalesce(F.col("b") - 1, F.greatest("a", "most"))}).where("low <= high and low is not null")
    gaps = gaps.select("swath", "k", "a", "b", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / size).cast("long"), F.floor(F.col("high") / size).cast("long"))).alias("bucket"))
    met = asked.where("noisy").withColumn("bucket", F.floor(F.col("n") / size).cast("long")).join(gaps, ["swath", "bucket"]).where(F.col("n").between(F.col("low"), F.col("high")))
    share = F.coalesce(F.try_divide((F.col("n") - F.col("a")).cast("double"), F.col("b") - F.col("a")), F.lit(0.0))
    met = met.select("y", "swath", "sy", "k", share.alias("wy"))
    return met.unionByName(asked.where("not noisy").select("y", "swath", "sy", F.lit(-1).alias("k"), F.lit(0.0).alias("wy")))


def column_map(spark: SparkSession, target: Target, swaths: list[SubSwath]) -> DataFrame:
    """x, swath, sx, k, n0 and n1 of each sub-swath that has the column's slant range: n0 and n1 are the values at sx of the noise vectors at stretch k's ends (at its only one, both)."""
    ship(spark)
    x = np.arange(target.width)
    time = target.near + x * target.slant_step
    rows, vectors = [], []
    for s in swaths:
        sx = np.clip(np.floor((time - s.near) / target.slant_step + 0.5), 0, s.samples - 1).astype(int)
        rows += [(int(k), s.number, int(sx[k])) for k in np.flatnonzero((time >= s.near) & (time <= s.far))]
        ends = [s.noise[0], *s.noise, s.noise[-1]] if s.noise else []
        vectors += [(s.number, k, *(list(map(float, c)) for v in (a, b) for c in v[1:])) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        if not s.noise:
            vectors.append((s.number, -1, [], [], [], []))
    columns = spark.createDataFrame(rows, "x long, swath int, sx long")
    noise = spark.createDataFrame(vectors, "swath int, k int, p0 array<double>, v0 array<double>, p1 array<double>, v1 array<double>")

    @F.pandas_udf("double")
    def at(sx: pd.Series, p: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([float(np.interp(s, a, b)) if len(a) else None for s, a, b in zip(sx, p, v, strict=True)], dtype="float64")

    return noise.join(F.broadcast(columns), "swath").select("x", "swath", "sx", "k", at("sx", "p0", "v0").alias("n0"), at("sx", "p1", "v1").alias("n1"))


def deburst(samples: DataFrame, target: Target, swaths: list[SubSwath], empty: float = EMPTY) -> DataFrame:
    """y, x, i and q of all target pixels that a sub-swath has, from samples (swath, sy, sx, i, q).

    Of two sub-swaths (of more, the first two by number) that have a pixel, the one
    with less noise gives it, the first if they are equal; if its intensity is under
    `empty` and the other's sample isn't zero, the other does. A sample that is
    absent counts as zero. Where the chosen sub-swath has no burst, there is no row.
    """
    spark = samples.sparkSession
    noise = F.col("n0") + (F.col("n1") - F.col("n0")) * F.col("wy")
    asked = line_map(spark, target, swaths).join(column_map(spark, target, swaths), ["swath", "k"]).select("y", "x", "swath", "sy", "sx", noise.alias("noise"))
    found = asked.join(samples.select("swath", "sy", "sx", "i", "q"), ["swath", "sy", "sx"], "left")
    one = F.struct("swath", F.col("sy").isNotNull().alias("there"), "noise", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("q", F.lit(0)).alias("q"))
    rows = found.groupBy("y", "x").agg(F.array_sort(F.collect_list(one)).alias("h"))
    # Of a sample that is there more than once, the greatest counts.
    rows = rows.select("y", "x", F.filter("h", lambda e, k: F.coalesce(F.get("h", k + 1)["swath"] != e["swath"], F.lit(True))).alias("h"))
    s0, s1 = F.get("h", F.lit(0)), F.get("h", F.lit(1))
    second = F.coalesce(s0["noise"] > s1["noise"], F.lit(False))
    got = rows.select("y", "x", F.when(second, s1).otherwise(s0).alias("a"), F.when(second, s0).otherwise(s1).alias("b")).where("a.there")
    weak = F.col("a.i") * F.col("a.i") + F.col("a.q") * F.col("a.q") < empty
    use = F.when(weak & ((F.col("b.i") != 0) | (F.col("b.q") != 0)), F.col("b")).otherwise(F.col("a"))
    return got.select("y", "x", use.alias("u")).select("y", "x", "u.i", "u.q")
