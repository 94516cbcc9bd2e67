"""Product catalogue: products joined with their metadata, and queries as conjunctions of optional predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Query:
    """What is set must hold. any_of: values of a column; equal: exact matches; prefixes: starts of a text column; not_under: excluded path prefixes; between: (low, high), either may be None; where: a free Column or SQL text; box: (west, south, east, north) over lon and lat columns."""

    any_of: dict[str, list] = field(default_factory=dict)
    equal: dict[str, object] = field(default_factory=dict)
    prefixes: dict[str, list[str]] = field(default_factory=dict)
    not_under: dict[str, list[str]] = field(default_factory=dict)
    between: dict[str, tuple] = field(default_factory=dict)
    where: Column | str | None = None
    box: tuple[float, float, float, float] | None = None
    lon: str = "lon"
    lat: str = "lat"

    def predicate(self) -> Column:
        tests = [F.col(c).isin(v) for c, v in self.any_of.items() if v]
        tests += [F.col(c) == v for c, v in self.equal.items()]
        starts = lambda c, ps: reduce(lambda a, b: a | b, [F.col(c).startswith(p) for p in ps])
        tests += [starts(c, ps) for c, ps in self.prefixes.items() if ps]
        tests += [~starts(c, ps) for c, ps in self.not_under.items() if ps]
        for c, (low, high) in self.between.items():
            tests += [F.col(c) >= low] * (low is not None) + [F.col(c) <= high] * (high is not None)
        if self.box:
            west, south, east, north = self.box
            tests += [F.col(self.lon).between(west, east) & F.col(self.lat).between(south, north)]
        if self.where is not None:
            tests.append(F.expr(self.where) if isinstance(self.where, str) else self.where)
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def select(products: DataFrame, query: Query, metadata: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Products that match, with their metadata; predicates on one side are pushed to its scan."""
    rows = products if metadata is None else products.join(metadata, key)
    return rows.where(query.predicate())


def select_area(products: DataFrame, query: Query) -> DataFrame:
    """Like select, but an area of a single point that nothing matches selects all that the other predicates do."""
    found = select(products, query)
    if query.box and query.box[0] == query.box[2] and query.box[1] == query.box[3] and found.isEmpty():
        return select(products, Query(**{**query.__dict__, "box": None}))
    return found


def distinct(products: DataFrame, column: str) -> DataFrame:
    return products.select(column).distinct().orderBy(column)


def scan(spark, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as catalogue rows: path, name, bytes and time of change. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def upsert(products: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """products with new rows added and those of a known key replaced; null keys are always new."""
    return products.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def remove(products: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """products without the rows of the given keys."""
    return products.join(gone.select(key), key, "left_anti")
