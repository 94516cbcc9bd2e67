"""Readers and writers of products.

The native form is Parquet with a JSON side file. Raw rasters (ENVI, generic
binary, elevation tiles) are read by the source of raster_files, by ranges of
lines; CSV products and feature tables by Spark's CSV source.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..product import Product
from .raster_files import interleaved, read_raster


def write_product(p: Product, path: str, tile: int | None = None) -> None:
    """pixels as Parquet under path/pixels (by tile of so many pixels a side, if given, so that region filters prune folders), size and metadata under path/header."""
    spark = p.pixels.sparkSession
    if tile:
        p.pixels.withColumn("tile_y", F.floor(F.col("y") / tile)).withColumn("tile_x", F.floor(F.col("x") / tile)).repartition("tile_y", "tile_x").sortWithinPartitions("y", "x").write.partitionBy("tile_y", "tile_x").parquet(f"{path}/pixels")
    else:
        p.pixels.write.parquet(f"{path}/pixels")
    header = json.dumps({"height": p.height, "width": p.width, "meta": p.meta})
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/header")


def read_product(spark: SparkSession, path: str) -> Product:
    header = json.loads(spark.read.text(f"{path}/header").first()[0])
    pixels = spark.read.parquet(f"{path}/pixels").drop("tile_y", "tile_x")
    return Product(pixels, header["height"], header["width"], header["meta"])


def tile_name(p: Product, n: int) -> Column:
    """Which of n sub-products (the square of a number a side; 2 means two lines of one) a pixel belongs to."""
    side = max(1, int(n**0.5))
    rows = n // side
    th, tw = -(-p.height // rows), -(-p.width // side)
    return (F.floor(F.col("y") / th) * side + F.floor(F.col("x") / tw)).cast("int")


def write_tiles(p: Product, path: str, n: int) -> None:
    p.pixels.withColumn("tile", tile_name(p, n)).write.partitionBy("tile").parquet(path)


def write_csv(df: DataFrame, path: str, properties: dict[str, str] | None = None) -> None:
    """Tab-separated, a header name:type, properties beside the data as #name=value lines."""
    kinds = {"bigint": "long", "int": "int", "double": "double", "float": "float", "string": "string", "timestamp": "time", "boolean": "boolean", "smallint": "short"}
    named = df.select(*[F.col(c).alias(f"{c}:{kinds.get(t, 'string')}") for c, t in df.dtypes])
    named.write.option("sep", "\t").option("header", True).csv(f"{path}/rows")
    lines = [(f"#{k}={v}",) for k, v in (properties or {}).items()]
    df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.text(f"{path}/properties")


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows with a typed header, and properties. Rows with a wrong number of fields are skipped."""
    kinds = {"time": "timestamp", "short": "smallint", "long": "bigint"}
    names = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(f"{path}/rows").columns
    schema = ", ".join(f"`{n.split(':')[0]}` {kinds.get(k, k) if (k := (n.split(':') + ['string'])[1]) else 'string'}" for n in names)
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).option("comment", "#").option("mode", "DROPMALFORMED").csv(f"{path}/rows")
    lines = [r[0] for r in spark.read.text(f"{path}/properties").collect()]  # a header, of a few lines
    return rows, dict(x[1:].split("=", 1) for x in lines if x.startswith("#") and "=" in x)


# ENVI data type codes.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def read_raw(spark: SparkSession, path: str, height: int, width: int, dtype: str, bands: list[str], interleave: str = "bsq", offset: int = 0) -> Product:
    """A raw raster, bands after each other (bsq), line by line (bil) or pixel by pixel (bip), read by ranges of lines. Complex samples become <band>_i and <band>_q."""
    return read_raster(spark, interleaved(path, height, width, dtype, bands, interleave, offset))


def read_envi(spark: SparkSession, header: str, data: str) -> Product:
    """An ENVI header and its data file."""
    text = "\n".join(r[0] for r in spark.read.text(header).collect())
    fields, key = {}, None
    for line in text.splitlines():
        if "=" in line and (key is None or fields[key].count("{") == fields[key].count("}")):
            key, value = (x.strip() for x in line.split("=", 1))
            key = key.lower()
            fields[key] = value
        elif key:
            fields[key] += " " + line.strip()
    bands = [b.strip() for b in fields.get("band names", "").strip("{} ").split(",") if b.strip()] or [f"band_{i + 1}" for i in range(int(fields.get("bands", 1)))]
    order = ">" if int(fields.get("byte order", 0)) else "<"
    return read_raw(spark, data, int(fields["lines"]), int(fields["samples"]), order + ENVI_TYPES[int(fields["data type"])], bands, fields.get("interleave", "bsq").lower(), int(fields.get("header offset", 0)))


def write_ascii_grid(p: Product, band: str, path: str, corner: tuple[float, float] = (0.0, 0.0), cell: float = 1.0, no_data: float = -9999.0) -> None:
    """An ASCII grid: path/header (size, lower left corner (x, y), cell size and no-data value) and path/rows, a text line for each raster line with its number before it, as Spark writes lines in no order. Pixels that are absent get the no-data value too."""
    head = [f"ncols {p.width}", f"nrows {p.height}", f"xllcorner {corner[0]}", f"yllcorner {corner[1]}", f"cellsize {cell}", f"NODATA_value {no_data}"]
    p.pixels.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/header")
    sample = F.struct(F.col("x").cast("long").alias("x"), F.coalesce(F.col(band).cast("double"), F.lit(float(no_data))).alias("s"))
    lines = p.pixels.groupBy("y").agg(F.collect_list(sample).alias("present"))
    lines = p.pixels.sparkSession.range(p.height).withColumnRenamed("id", "y").join(lines, "y", "left").withColumn("present", F.coalesce("present", F.expr("cast(array() as array<struct<x: long, s: double>>)")))
    absent = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(p.width - 1).cast("long")), F.transform("present", lambda q: q["x"]))
    whole = F.array_sort(F.concat("present", F.transform(absent, lambda x: F.struct(x.alias("x"), F.lit(float(no_data)).alias("s")))))
    lines = lines.select("y", F.array_join(F.transform(whole, lambda q: q["s"].cast("string")), " ").alias("line"))
    lines.select(F.concat_ws(" ", F.col("y").cast("string"), "line").alias("value")).write.text(f"{path}/rows")


def read_ascii_grid(spark: SparkSession, path: str, band: str = "v") -> Product:
    """What write_ascii_grid() wrote; the no-data value becomes missing. Corner and cell size are in the metadata."""
    head = dict(line.split(None, 1) for row in spark.read.text(f"{path}/header").collect() for line in row[0].splitlines())  # six lines
    head = {k.lower(): float(v) for k, v in head.items()}
    parts = F.split(F.trim("value"), " +")
    rows = spark.read.text(f"{path}/rows").select(F.get(parts, F.lit(0)).cast("long").alias("y"), F.slice(parts, 2, F.size(parts)).alias("s"))
    rows = rows.select("y", F.posexplode("s").alias("x", "s")).select("y", F.col("x").cast("long").alias("x"), F.col("s").cast("double").alias(band))
    rows = rows.withColumn(band, F.when(F.col(band) != head.get("nodata_value", -9999.0), F.col(band)))
    return Product(rows, int(head["nrows"]), int(head["ncols"]), {"corner": (head["xllcorner"], head["yllcorner"]), "cell": head["cellsize"]})


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0, in the file's order) and value of a text file's lines. Each of its splits numbers its own lines; the splits' counts, a row each, say where it begins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("i", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1)
    counts = lines.groupBy("block").agg(F.count("*").alias("c"))
    starts = counts.withColumn("start", F.coalesce(F.sum("c").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "start")
    return lines.join(starts, "block").select((F.col("start") + F.col("i")).alias("n"), "value")


def read_grid_file(spark: SparkSession, path: str, band: str = "v") -> Product:
    """An ASCII grid as other programs write it: ncols, nrows, xllcorner or xllcenter, yllcorner or yllcenter, cellsize and perhaps NODATA_value, a line each in any case, then a line for each raster line, north first. The no-data value (-9999 if not named) becomes missing; corner (lower left) and cell size are in the metadata."""
    word = r"^\s*([A-Za-z_]+)\s+(\S+)\s*$"
    found = {}
    for row in spark.read.text(path).where(F.col("value").rlike(word)).limit(16).collect():  # a header has six lines
        key, value = row[0].split()
        if key.lower() in ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "nodata_value"):
            found[key.lower()] = float(value)
    if not {"ncols", "nrows", "cellsize"} <= set(found):
        raise ValueError("no header of an ASCII grid")
    parts = F.split(F.trim("value"), r"\s+")
    rows = numbered_lines(spark, path).where((F.col("n") >= len(found)) & (F.col("n") < len(found) + int(found["nrows"]))).select((F.col("n") - len(found)).alias("y"), F.posexplode(parts).alias("x", "s"))
    rows = rows.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("s").cast("double").alias(band)).where(F.col("x") < int(found["ncols"]))
    rows = rows.withColumn(band, F.when(F.col(band) != found.get("nodata_value", -9999.0), F.col(band)))
    cell = found["cellsize"]
    corner = tuple(found.get(f"{a}llcorner", found.get(f"{a}llcenter", cell / 2) - cell / 2) for a in "xy")
    return Product(rows, int(found["nrows"]), int(found["ncols"]), {"corner": corner, "cell": cell})


def read_csv_file(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A CSV product as other programs write it: lines `#name=value` of properties anywhere, then a tab-separated header name:type and rows. Types as in read_csv(); empty fields and `[null]` are missing, as is what a type can't hold; rows with a wrong number of fields are skipped."""
    kinds = {"string": "string", "byte": "tinyint", "short": "smallint", "int": "int", "integer": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "time": "timestamp"}
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    about = [r[0][1:].split("=", 1) for r in lines.where(F.col("value").startswith("#") & F.col("value").contains("=")).collect()]  # a header's lines
    plain = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    first = plain.first()
    if first is None:
        raise ValueError("no header of a CSV product")
    names = [(f.split(":", 1) + ["string"])[:2] for f in first[0].split("\t")]
    cells = F.split("value", "\t", -1)
    text = lambda i: F.when(~F.get(cells, F.lit(i)).isin("", "[null]"), F.get(cells, F.lit(i)))
    rows = plain.where((F.col("value") != first[0]) & (F.size(cells) == len(names)))
    return rows.select(*[text(i).try_cast(kinds.get(k.lower(), "string")).alias(n) for i, (n, k) in enumerate(names)]), {k.strip(): v.strip() for k, v in about}


def read_elevation_tile(spark: SparkSession, path: str, height: int, width: int, no_data: int = -9999) -> Product:
    """A raw elevation tile (16 bit, high byte first, line by line) as band elevation, missing where it has the no-data value."""
    p = read_raw(spark, path, height, width, ">i2", ["elevation"])
    return p.with_bands(elevation=F.when(F.col("elevation") != no_data, F.col("elevation")))


def image_rows(p: Product, red: str, green: str, blue: str, low: float, high: float) -> DataFrame:
    """One row a line: y and rgb bytes, scaled from [low, high]; missing samples are 0. images.write_png() makes a file."""
    byte = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col(c) - low) / (high - low) * 256)))).otherwise(0).cast("int")
    code = F.array(byte(red), byte(green), byte(blue))
    line = F.array_sort(F.collect_list(F.struct("x", code.alias("c"))))
    return p.pixels.groupBy("y").agg(F.flatten(F.transform(line, lambda s: s["c"])).alias("rgb"))
