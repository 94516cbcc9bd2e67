"""A product: an aligned stack of bands as a DataFrame keyed by (y, x), with its size and metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Product:
    """pixels has columns y and x (from 0) and one column per band; a missing sample is null. Operators return new products; those that iterate, or need a statistic to build their plan, run jobs for it."""

    pixels: DataFrame
    height: int
    width: int
    meta: dict = field(default_factory=dict)

    @property
    def bands(self) -> list[str]:
        return [c for c in self.pixels.columns if c not in ("y", "x")]

    def with_pixels(self, pixels: DataFrame, **changes) -> Product:
        return replace(self, pixels=pixels, **changes)

    def with_bands(self, **bands: Column) -> Product:
        return self.with_pixels(self.pixels.withColumns(bands))

    def select(self, *columns) -> Product:
        return self.with_pixels(self.pixels.select("y", "x", *columns))


def product(pixels: DataFrame, height: int | None = None, width: int | None = None, **meta) -> Product:
    """A product of a DataFrame with y and x; its size is looked up if it isn't given."""
    if height is None or width is None:
        top = pixels.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
        height, width = (0 if top["y"] is None else int(top["y"]) + 1), (0 if top["x"] is None else int(top["x"]) + 1)
    return Product(pixels, height, width, meta)


def from_arrays(df: DataFrame, row: str, values: str, band: str = "v", *others: str) -> Product:
    """A product whose lines are the rows of a table with an array column; `others` become bands that are constant along a line."""
    top = df.agg(F.max(F.size(values)).alias("w"), F.max(row).alias("y")).first()
    pixels = df.select(F.col(row).cast("long").alias("y"), *others, F.posexplode(values).alias("x", "s"))
    pixels = pixels.select("y", F.col("x").cast("long").alias("x"), F.col("s").cast("double").alias(band), *others)
    return product(pixels, width=max(int(top["w"] or 0), 0), height=0 if top["y"] is None else int(top["y"]) + 1)


def embeddings(spark: SparkSession, sf_dir: str) -> Product:
    """The dense raster of the test tables: line vec_id, column position, band v, and the line's label as region."""
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "v", "label")
