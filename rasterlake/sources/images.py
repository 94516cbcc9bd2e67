"""Image files of three bands, and sets of products."""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..product import Product
from ..session import ship
from .dimap import read_dimap
from .raster_files import open_store, read_layout, write_raster
from .stores import read_csv_file, read_envi, read_grid_file, read_product  # noqa: F401

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(p: Product, path: str, red: str, green: str, blue: str, low: float, high: float, lines: int | None = None) -> None:
    """An image file of three bands, scaled from [low, high] to a byte each; missing samples are 0.

    Tasks write strips of bytes side by side; one task then streams them through the
    compressor, a strip of the three bands in memory at once.
    """
    spark = p.pixels.sparkSession
    byte = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col(c).cast("double") - low) / (high - low) * 256)))).otherwise(0).cast("double")
    bands = p.select(byte(red).alias("r"), byte(green).alias("g"), byte(blue).alias("b"))
    strips = f"{path}-strips-{uuid.uuid4().hex[:12]}"
    write_raster(bands, strips, "u1", lines=lines)
    layout = read_layout(spark, strips)
    height, width = p.height, p.width
    files = list(zip(*[[f for _, f in b.files] for b in layout.bands], strict=True))
    rows = [(path, [list(f) for f in files])]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, target = open_store(row["path"])
                part = f"{target}.{uuid.uuid4().hex[:12]}"
                packer = zlib.compressobj(6)
                with store.open_output_stream(part) as out:
                    out.write(_SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)))
                    for three in row["strips"]:
                        planes = []
                        for f in three:
                            source, local = open_store(f)
                            with source.open_input_stream(local) as given:
                                planes.append(np.frombuffer(given.read(), np.uint8).reshape(-1, width))
                        line = np.stack(planes, axis=2).reshape(len(planes[0]), 3 * width)
                        packed = packer.compress(np.pad(line, ((0, 0), (1, 0))).tobytes())  # a line begins with its filter, none
                        if packed:
                            out.write(_chunk(b"IDAT", packed))
                    out.write(_chunk(b"IDAT", packer.flush()) + _chunk(b"IEND", b""))
                store.move(part, target)
                yield pa.record_batch([pa.array([target])], ["path"])

    ship(spark)
    spark.createDataFrame(rows, "path string, strips array<array<string>>").repartition(1).mapInArrow(run, "path string").collect()
    store, local = open_store(strips)
    store.delete_dir(local)


def product_files(path: str) -> list[str]:
    """The products in a folder, sorted: headers of DIMAP and ENVI (but not those inside a DIMAP product), ASCII grids, and folders of write_product(); a path that is no folder, or is such a folder itself, stands for itself."""
    store, local = open_store(path)
    is_product = lambda folder: store.get_file_info(f"{folder}/header").type != pyarrow.fs.FileType.NotFound
    if store.get_file_info(local).type != pyarrow.fs.FileType.Directory or is_product(local):
        return [path]
    found = []
    for info in store.get_file_info(pyarrow.fs.FileSelector(local)):
        if info.type == pyarrow.fs.FileType.Directory:
            found += [info.base_name] if is_product(info.path) else []
        elif info.base_name.lower().endswith((".dim", ".hdr", ".asc")):
            found.append(info.base_name)
    return sorted(posixpath.join(path, n) for n in found)


def read_product_set(spark: SparkSession, paths: list[str]) -> list[Product]:
    """The products of a list of paths and folders, in order, each read as its name tells."""

    def read(path: str) -> Product:
        if path.lower().endswith(".dim"):
            return read_dimap(spark, path)
        if path.lower().endswith(".hdr"):
            return read_envi(spark, path, path[:-4] + ".img")
        if path.lower().endswith(".asc"):
            return read_grid_file(spark, path)
        return read_product(spark, path)

    return [read(file) for path in paths for file in product_files(path)]


def all_pixels(products: list[Product]) -> DataFrame:
    """One table of all products' pixels with product, its number in the list; a band that a product lacks is missing."""
    if not products:
        raise ValueError("no products")
    out = None
    for k, p in enumerate(products):
        rows = p.pixels.withColumn("product", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
