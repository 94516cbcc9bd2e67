"""Rasters in flat binary files, as a splittable source and a writer in strips.

A layout says where each band's samples lie: files, sample type, and the strides
from pixel to pixel and from line to line, so bands after each other, line by
line, pixel by pixel, or in a file each are all read alike. A partition is a range
of lines. Only the bands of the asked schema are read, and filters on y and x that
Spark pushes down become byte ranges, so a subset of a large file touches the
lines that it needs.

Files are opened by pyarrow's file systems, those of local and shared folders and
of the object stores and HDFS that it knows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..product import Product
from ..session import ship

SPLIT = 32 << 20  # bytes of samples in a partition, about
PIXELS = 1 << 19  # that a task puts in order
BATCH = 1 << 17  # pixels of an Arrow batch, about


@dataclass
class Band:
    """Samples of a band. files: [first line, path] of each strip, in order of lines; start: the first sample's byte in each file; pixel and line: bytes from one to the next.

    A sample s stands for s * scale + offset, or 10 to the power of that if log10;
    no_data (of raw samples) and NaN stand for a missing one.
    """

    name: str
    files: list
    dtype: str
    pixel: int
    line: int
    start: int = 0
    scale: float = 1.0
    offset: float = 0.0
    log10: bool = False
    no_data: float | None = None
    mixed: bool = False  # other bands' samples lie between this one's, in its lines or from line to line


@dataclass
class Layout:
    height: int
    width: int
    bands: list[Band] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"height": self.height, "width": self.width, "bands": [b.__dict__ for b in self.bands]})

    @staticmethod
    def from_json(text: str) -> Layout:
        found = json.loads(text)
        return Layout(found["height"], found["width"], [Band(**b) for b in found["bands"]])

    def schema(self) -> str:
        return "y long, x long" + "".join(f", `{b.name}` double" for b in self.bands)


def interleaved(path: str, height: int, width: int, dtype: str, bands: list[str], interleave: str = "bsq", offset: int = 0) -> Layout:
    """The layout of one file with bands after each other (bsq), line by line (bil) or pixel by pixel (bip). Complex samples become <band>_i and <band>_q."""
    kind, n = np.dtype(dtype), len(bands)
    size = kind.itemsize
    pixel, line, band = {"bsq": (size, size * width, size * width * height), "bil": (size, size * width * n, size * width), "bip": (size * n, size * width * n, size)}[interleave]
    if kind.kind != "c":
        return Layout(height, width, [Band(b, [[0, path]], kind.str, pixel, line, offset + i * band, mixed=interleave != "bsq") for i, b in enumerate(bands)])
    part = np.dtype(f"{kind.str[0]}f{size // 2}")
    return Layout(height, width, [Band(f"{b}_{s}", [[0, path]], part.str, pixel, line, offset + i * band + k * part.itemsize, mixed=True) for i, b in enumerate(bands) for k, s in enumerate("iq")])


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


class _Lines(InputPartition):
    def __init__(self, first: int, last: int):
        self.value, self.first, self.last = (first, last), first, last


class _Bounds:
    """The least and largest whole number that the filters on a column let through."""

    def __init__(self, size: int):
        self.low, self.high = 0, size - 1

    def take(self, f) -> None:
        if isinstance(f, EqualTo):
            self.low, self.high = max(self.low, f.value), min(self.high, f.value)
        elif isinstance(f, In) and f.value:
            self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
        elif isinstance(f, GreaterThan):
            self.low = max(self.low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, f.value)
        elif isinstance(f, LessThan):
            self.high = min(self.high, f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, f.value)


class RasterReader(DataSourceReader):
    def __init__(self, layout: Layout, names: list[str], split: int):
        self.layout, self.names, self.split = layout, names, split
        self.bounds = {("y",): _Bounds(layout.height), ("x",): _Bounds(layout.width)}
        self.bands = [b for b in layout.bands if b.name in names]

    def pushFilters(self, filters):
        """Bounds on y and x choose what is read; Spark applies all filters again."""
        for f in filters:
            bounds = self.bounds.get(getattr(f, "attribute", None))
            values = getattr(f, "value", None)
            if bounds is not None and all(isinstance(v, int) for v in (values if isinstance(values, (list, tuple)) else [values])):
                bounds.take(f)
            yield f

    def partitions(self):
        y = self.bounds["y",]
        weight = max(1, sum(np.dtype(b.dtype).itemsize for b in self.bands)) * max(1, self.layout.width)
        lines = max(1, self.split // weight)
        return [_Lines(a, min(a + lines, y.high + 1)) for a in range(y.low, y.high + 1, lines)] or [_Lines(0, 0)]

    def read(self, partition):
        x = self.bounds["x",]
        count = max(0, x.high - x.low + 1)
        step = max(1, BATCH // max(count, 1))
        shared, files = origins(self.bands), _Files()
        for top in range(partition.first, partition.last if count else partition.first, step):
            end = min(top + step, partition.last)
            columns = {"y": pa.array(np.repeat(np.arange(top, end), count)), "x": pa.array(np.tile(np.arange(x.low, x.high + 1), end - top))}
            columns |= {b.name: _samples(b, shared[b.name], top, end, x.low, x.high + 1, files) for b in self.bands}
            files.stretches.clear()
            yield pa.record_batch([columns[n] for n in self.names], self.names)


def origins(bands: list[Band]) -> dict[str, int | None]:
    """Of bands that lie among others' samples: the byte at which the stretch begins that they share, line for line. None for bands whose lines are their own."""
    out: dict[str, int | None] = {b.name: None for b in bands}
    begun: dict = {}
    for b in sorted(bands, key=lambda b: b.start):
        if b.mixed:
            key = (b.files[0][1], b.line)
            if key not in begun or b.start - begun[key] >= b.line:
                begun[key] = b.start
            out[b.name] = begun[key]
    return out


class _Files:
    """Open files of a task, and the stretches that bands of the same lines share."""

    def __init__(self):
        self.files: dict = {}
        self.stretches: dict = {}

    def bytes(self, path: str, begin: int, length: int) -> bytes:
        if (path, begin, length) not in self.stretches:
            if path not in self.files:
                store, local = open_store(path)
                self.files[path] = store.open_input_file(local)
            self.files[path].seek(begin)
            self.stretches[path, begin, length] = self.files[path].read(length)
        return self.stretches[path, begin, length]


def _samples(b: Band, origin: int | None, top: int, end: int, left: int, right: int, files: _Files) -> pa.Array:
    """Lines top to end and columns left to right of a band as doubles."""
    kind, parts = np.dtype(b.dtype), []
    for k, (first, path) in enumerate(b.files):
        last = b.files[k + 1][0] if k + 1 < len(b.files) else end
        a, z = max(top, first), min(end, last)
        if a >= z:
            continue
        need = (z - 1 - a) * b.line + (right - 1 - left) * b.pixel + kind.itemsize
        if origin is None:
            raw, at = files.bytes(path, b.start + (a - first) * b.line + left * b.pixel, need), 0
        else:
            raw, at = files.bytes(path, origin + (a - first) * b.line, (z - a) * b.line), b.start - origin + left * b.pixel
        if len(raw) < at + need:
            raise ValueError(f"{path} ends before line {z - 1} of band {b.name}")
        parts.append(np.ndarray((z - a, right - left), kind, raw, at, (b.line, b.pixel)))
    v = (np.concatenate(parts) if len(parts) > 1 else parts[0]).astype(np.float64).ravel()
    gone = np.isnan(v)
    if b.no_data is not None:
        gone |= v == b.no_data
    v = v * b.scale + b.offset if (b.scale, b.offset) != (1.0, 0.0) else v
    return pa.array(10.0**v if b.log10 else v, mask=gone)


@dataclass
class _Strips(WriterCommitMessage):
    strips: list


class RasterWriter(DataSourceArrowWriter):
    """Files of `lines` lines a band; rows come in order of (y, x), a strip's lines all in one task. The index is written last, by the driver, and names the strips of the tasks that were committed."""

    def __init__(self, path: str, height: int, width: int, lines: int, kinds: dict[str, tuple[str, float]], names: list[str]):
        self.path, self.height, self.width, self.lines, self.kinds, self.names = path, height, width, lines, kinds, names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Strips:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        done, open_strip, planes = [], None, {}

        def flush():
            if open_strip is not None:
                tag = f"{open_strip:08d}-{uuid.uuid4().hex[:12]}"
                for b, plane in planes.items():
                    with store.open_output_stream(f"{root}/{b}-{tag}.img") as out:
                        out.write(plane.tobytes())
                done.append((open_strip, tag))

        for batch in iterator:
            y, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x"))
            strip = y // self.lines
            for s in np.unique(strip).tolist():
                if s != open_strip:
                    flush()
                    if any(s == k for k, _ in done):
                        raise ValueError("rows must come in order of lines, a strip's in one task")
                    open_strip, planes = s, {b: np.full((min(self.lines, self.height - s * self.lines), self.width), self.fill(b), self.kinds[b][0]) for b in self.names}
                here = np.flatnonzero(strip == s)
                for b in self.names:
                    column = batch.column(b).take(pa.array(here))
                    v = column.to_numpy(zero_copy_only=False).astype(np.float64)
                    there = ~np.isnan(v)
                    planes[b][y[here][there] - s * self.lines, x[here][there]] = self.rounded(b, v[there])
        flush()
        return _Strips(done)

    def fill(self, b: str) -> float:
        return self.kinds[b][1]

    def rounded(self, b: str, v: np.ndarray) -> np.ndarray:
        kind = np.dtype(self.kinds[b][0])
        if kind.kind == "f":
            return v.astype(kind)
        info = np.iinfo(kind)
        v = np.floor(v + 0.5)
        if len(v) and (v.min() < info.min or v.max() > info.max):
            raise ValueError(f"band {b} has samples beyond its type {kind}")
        return v.astype(kind)

    def commit(self, messages) -> None:
        strips = dict(s for m in messages if m is not None for s in m.strips)
        store, root = open_store(self.path)
        size = range(-(-self.height // self.lines))
        missing = [s for s in size if s not in strips]
        if missing:  # strips without a row
            for s in missing:
                strips[s] = f"{s:08d}-{uuid.uuid4().hex[:12]}"
                for b in self.names:
                    with store.open_output_stream(f"{root}/{b}-{strips[s]}.img") as out:
                        out.write(np.full((min(self.lines, self.height - s * self.lines), self.width), self.fill(b), self.kinds[b][0]).tobytes())
        bands = []
        for b in self.names:
            kind = np.dtype(self.kinds[b][0])
            no_data = self.kinds[b][1]
            files = [[s * self.lines, f"{b}-{strips[s]}.img"] for s in size]
            bands.append(Band(b, files, kind.str, kind.itemsize, kind.itemsize * self.width, no_data=None if np.isnan(no_data) else no_data))
        with store.open_output_stream(f"{root}/layout.json") as out:
            out.write(Layout(self.height, self.width, bands).to_json().encode())

    def abort(self, messages) -> None:
        store, root = open_store(self.path)
        for tag in [t for m in messages if m is not None for _, t in m.strips]:
            for b in self.names:
                info = store.get_file_info(f"{root}/{b}-{tag}.img")
                if info.type == pyarrow.fs.FileType.File:
                    store.delete_file(info.path)


class RasterSource(DataSource):
    """Options to read: layout (JSON of Layout), split (bytes). To write: path, height, width, lines (of a strip), kinds (JSON: band to sample type and no-data value)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return Layout.from_json(self.options["layout"]).schema()

    def reader(self, schema):
        return RasterReader(Layout.from_json(self.options["layout"]), [f.name for f in schema.fields], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite):
        o = self.options
        names = [f.name for f in schema.fields if f.name not in ("y", "x")]
        return RasterWriter(o["path"], int(o["height"]), int(o["width"]), int(o["lines"]), json.loads(o["kinds"]), names)


def register(spark: SparkSession) -> None:
    """Make the format `raster` known to the session, with pushed filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def read_raster(spark: SparkSession, layout: Layout, bands: list[str] | None = None, split: int = SPLIT, meta: dict | None = None) -> Product:
    """The product of a layout: all bands, or those named; other bands' samples are not read. Missing samples are null."""
    register(spark)
    chosen = layout if bands is None else Layout(layout.height, layout.width, [b for n in bands for b in layout.bands if b.name == n])
    if bands is not None and len(chosen.bands) != len(bands):
        raise ValueError(f"bands of the layout: {[b.name for b in layout.bands]}")
    pixels = spark.read.format("raster").option("layout", chosen.to_json()).option("split", split).load()
    return Product(pixels, layout.height, layout.width, meta or {})


def in_strips(pixels: DataFrame, height: int, width: int, lines: int, parts: int) -> DataFrame:
    """Rows in order of (y, x), a strip of so many lines in one task, which has strips that follow each other, of PIXELS at most unless one alone has more."""
    strips = max(1, -(-height // lines))
    each = lines * max(1, min(PIXELS // (lines * max(width, 1)), strips // parts))
    rows = pixels.withColumn("_part", F.expr(f"cast(y div {each} as int)")).repartitionById(-(-max(height, 1) // each), F.col("_part"))
    return rows.drop("_part").sortWithinPartitions("y", "x")


def write_raster(p: Product, path: str, dtype: str | dict[str, str] = "<f4", no_data: dict[str, float] | None = None, lines: int | None = None) -> None:
    """Bands as strips of `lines` lines (if not given, about SPLIT bytes or PIXELS at most), each a file, with an index layout.json beside them.

    A task holds one strip at a time. Missing and absent pixels get the band's
    no-data value (NaN for floats if none is given; for other types 0, and are
    then read as 0). Whole types round half up and refuse samples they can't hold.
    """
    spark = p.pixels.sparkSession
    register(spark)
    kinds = {b: dtype if isinstance(dtype, str) else dtype[b] for b in p.bands}
    fill = {b: (no_data or {}).get(b, float("nan") if np.dtype(k).kind == "f" else 0) for b, k in kinds.items()}
    wide = sum(np.dtype(k).itemsize for k in kinds.values()) * max(p.width, 1)
    lines = lines or max(1, min(SPLIT // wide, PIXELS // max(p.width, 1)))
    rows = p.pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.col(f"`{b}`").cast("double").alias(b) for b in p.bands])
    options = {"path": path, "height": p.height, "width": p.width, "lines": lines, "kinds": json.dumps({b: [kinds[b], fill[b]] for b in p.bands})}
    in_strips(rows, p.height, p.width, lines, int(spark.conf.get("spark.sql.shuffle.partitions"))).write.format("raster").mode("append").options(**options).save()


def read_layout(spark: SparkSession, path: str) -> Layout:
    """The index of write_raster(), its files made whole paths."""
    layout = Layout.from_json("\n".join(r[0] for r in spark.read.text(f"{path}/layout.json").collect()))  # one line
    for b in layout.bands:
        b.files = [[first, posixpath.join(path, name)] for first, name in b.files]
    return layout


def join_strips(spark: SparkSession, layout: Layout, targets: dict[str, str]) -> None:
    """Each band's strips, one after the other, as one file, by one task, which holds a few megabytes at once; a task has one band, or a share of them where there are very many."""
    rows = [(b.name, targets[b.name], [path for _, path in b.files]) for b in layout.bands if b.name in targets]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, target = open_store(row["target"])
                store.create_dir(posixpath.dirname(target), recursive=True)
                part = f"{target}.{uuid.uuid4().hex[:12]}"  # a task that is run again doesn't meet the first one's file
                total = 0
                with store.open_output_stream(part) as out:
                    for path in row["files"]:
                        source, local = open_store(path)
                        with source.open_input_stream(local) as given:
                            while piece := given.read(8 << 20):
                                out.write(piece)
                                total += len(piece)
                store.move(part, target)
                yield pa.record_batch([pa.array([total])], ["bytes"])

    ship(spark)
    tasks = min(len(rows), max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df = spark.createDataFrame(rows, "band string, target string, files array<string>").repartition(max(1, tasks), "band")
    df.mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()
