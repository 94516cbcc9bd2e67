"""Elevation models of many tiles, each a raw file that its corner addresses.

The tiles are one raster over the whole globe, of which most files may not be
there: what they would cover is sea. Lookups are dealt by the tiles that hold the
samples they need, one, two or four at a tile's edges, and only the lines of the
tiles that are asked for are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.raster_files import open_store


@dataclass(frozen=True)
class TileStore:
    """Tiles of `degrees` a side (parts of a degree need a name that can say so) with `samples` samples a side (16 bit, high byte first, north first). name: a format of the south-west corner, with lat and lon (their sizes), ns and ew, and folder for the store's folder."""

    folder: str
    degrees: float = 1
    samples: int = 1200
    no_data: int = -32768
    name: str = "{folder}/{ns}{lat:02d}{ew}{lon:03d}.hgt"

    def path(self, south: float, west: float) -> str:
        return self.name.format(folder=self.folder, lat=abs(south), lon=abs(west), ns="N" if south >= 0 else "S", ew="E" if west >= 0 else "W")


SALT = 16  # tasks that the lookups of one tile are dealt to


def elevation_at(points: DataFrame, lat: Column, lon: Column, store: TileStore, method: str = "bilinear", key: tuple[str, ...] = ("y", "x"), sea: float = 0.0) -> DataFrame:
    """key and elevation under each point: of the nearest sample, or between the four around it.

    Samples lie at the middle of their cells, of which a tile has `samples` a side;
    beyond a tile's edge the neighbour's are taken, around the globe in longitude, and
    those at the poles repeat. A tile without a file is sea. Samples with the no-data
    value don't count; without any other the elevation is missing, as it is where a
    coordinate is missing or no latitude.
    """
    spark = points.sparkSession
    ship(spark)
    per = store.samples / store.degrees  # samples a degree
    height, width = int(180 * per), int(360 * per)
    row, col = (90.0 - lat.cast("double")) * per, F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) * per
    asked = points.select(*key, row.alias("_r"), col.alias("_c")).where("_r is not null and _c is not null and not isnan(_r) and not isnan(_c)").where(F.col("_r").between(0, height))
    if method == "nearest":
        taps = F.array(F.struct(F.floor("_r").alias("r"), F.floor("_c").alias("c"), F.lit(1.0).alias("w")))
    elif method == "bilinear":
        r, c = F.floor(F.col("_r") - 0.5), F.floor(F.col("_c") - 0.5)
        wr, wc = F.col("_r") - 0.5 - r, F.col("_c") - 0.5 - c
        taps = F.array(*[F.struct((r + i).alias("r"), (c + j).alias("c"), ((wr if i else 1 - wr) * (wc if j else 1 - wc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    else:
        raise ValueError("nearest or bilinear")
    asked = asked.select(*key, F.inline(taps))
    asked = asked.select(*key, F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("r"))).cast("long").alias("r"), F.pmod(F.col("c"), F.lit(width)).cast("long").alias("c"), "w")
    n = store.samples
    asked = asked.withColumns({"down": F.expr(f"r div {n}").cast("int"), "right": F.expr(f"c div {n}").cast("int"), "line": (F.col("r") % n).cast("int"), "column": (F.col("c") % n).cast("int")})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.select(*key, "w", "down", "right", "line", "column").repartition(parts, "down", "right", F.pmod(F.xxhash64(*key), F.lit(SALT))).sortWithinPartitions("down", "right", "line")

    def run(batches):
        at, file = None, None
        for batch in batches:
            tile = np.stack([np.asarray(batch.column(c)) for c in ("down", "right")])
            line, column = np.asarray(batch.column("line")), np.asarray(batch.column("column"))
            out = np.full(batch.num_rows, float(sea))
            edges = [0, *(np.flatnonzero((np.diff(tile) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if (tile[0, a], tile[1, a]) != at:
                    at = (tile[0, a], tile[1, a])
                    files, path = open_store(store.path(90 - store.degrees * (int(at[0]) + 1), store.degrees * int(at[1]) - 180))
                    file = files.open_input_file(path) if files.get_file_info(path).is_file else None
                if file is None:
                    continue
                first, last = int(line[a:b].min()), int(line[a:b].max())
                file.seek(2 * n * first)
                samples = np.frombuffer(file.read(2 * n * (last - first + 1)), ">i2").reshape(-1, n)
                out[a:b] = samples[line[a:b] - first, column[a:b]]
            yield pa.record_batch([*[batch.column(c) for c in (*key, "w")], pa.array(out, mask=out == store.no_data)], [*key, "w", "s"])

    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in key)
    found = dealt.mapInArrow(run, f"{kinds}, w double, s double")
    weight = F.sum(F.when(F.col("s").isNotNull(), F.col("w")))
    return found.groupBy(*key).agg((F.sum(F.col("w") * F.col("s")) / F.when(weight > 0, weight)).alias("elevation"))
