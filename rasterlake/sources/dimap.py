"""Products in DIMAP form: an XML header, and a flat binary file with an ENVI header for each band and tie-point grid.

The header is small and read whole; samples are read by the splittable source of
raster_files, band by band and line by line as they are asked for. Writing goes
through strips, which tasks write side by side, and joins each band's strips to
one file.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.tie_points import TiePoints
from ..product import Product
from .raster_files import Band, Layout, join_strips, open_store, read_layout, read_raster, write_raster

# Sample types by name, and their ENVI codes; samples have the high byte first unless a header says otherwise.
TYPES = {"int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
ENVI_CODES = {"u1": 1, "i1": 1, "i2": 2, "i4": 3, "f4": 4, "f8": 5, "u2": 12, "u4": 13}


def _text(element, tag: str, default=None):
    found = element.find(tag) if element is not None else None
    return default if found is None or found.text is None else found.text.strip()


def _number(element, tag: str, default: float) -> float:
    text = _text(element, tag)
    return default if text is None or text == "" else float(text)


def _truth(element, tag: str) -> bool:
    return (_text(element, tag) or "").lower() == "true"


def _metadata(element) -> dict:
    """A tree of metadata: attributes by name as their texts, elements as dicts; of repeated names, a list."""
    out: dict = {}
    for child in element:
        if child.tag not in ("MDElem", "MDATTR"):
            continue
        value = _metadata(child) if child.tag == "MDElem" else (child.text or "").strip()
        name = child.get("name", "")
        if name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        else:
            out[name] = value
    return out


def parse_header(text: str) -> dict:
    """What a header says: name, type, start, stop, description, height, width, bands (a dict each, virtual ones too), tie_points, flags and indexes (codings by name), metadata, and geocoding (names of the grids)."""
    root = ET.fromstring(text.encode("utf-8") if not text.lstrip().startswith("<?xml") else re.sub(r"<\?xml[^>]*\?>", "", text, count=1).encode("utf-8"))
    if root.tag != "Dimap_Document":
        raise ValueError("not a DIMAP header")
    size = root.find("Raster_Dimensions")
    files = {int(_text(f, "BAND_INDEX")): f.find("DATA_FILE_PATH").get("href") for f in root.iterfind("Data_Access/Data_File")}
    grids = {int(_text(f, "TIE_POINT_GRID_INDEX")): f.find("TIE_POINT_GRID_FILE_PATH").get("href") for f in root.iterfind("Data_Access/Tie_Point_Grid_File")}
    bands = []
    for b in root.iterfind("Image_Interpretation/Spectral_Band_Info"):
        index = int(_text(b, "BAND_INDEX"))
        found = {"name": _text(b, "BAND_NAME"), "type": _text(b, "DATA_TYPE"), "unit": _text(b, "PHYSICAL_UNIT"), "description": _text(b, "BAND_DESCRIPTION"), "file": files.get(index), "coding": _text(b, "FLAG_CODING_NAME") or _text(b, "INDEX_CODING_NAME"), "valid": _text(b, "VALID_MASK_TERM")}
        found |= {"wavelength": _number(b, "BAND_WAVELEN", 0.0), "bandwidth": _number(b, "BANDWIDTH", 0.0), "solar_flux": _number(b, "SOLAR_FLUX", 0.0)}
        found |= {"scale": _number(b, "SCALING_FACTOR", 1.0), "offset": _number(b, "SCALING_OFFSET", 0.0), "log10": _truth(b, "LOG10_SCALED"), "no_data": _number(b, "NO_DATA_VALUE", 0.0) if _truth(b, "NO_DATA_VALUE_USED") else None}
        found["expression"] = _text(b, "EXPRESSION") if _truth(b, "VIRTUAL_BAND") else None
        bands.append(found)
    tie_points = []
    for g in root.iterfind("Tie_Point_Grids/Tie_Point_Grid_Info"):
        found = {"name": _text(g, "TIE_POINT_GRID_NAME"), "unit": _text(g, "PHYSICAL_UNIT"), "description": _text(g, "TIE_POINT_DESCRIPTION"), "type": _text(g, "DATA_TYPE", "float32"), "cyclic": _truth(g, "CYCLIC"), "file": grids.get(int(_text(g, "TIE_POINT_GRID_INDEX")))}
        found |= {"cols": int(_text(g, "NCOLS")), "rows": int(_text(g, "NROWS")), "offset": (_number(g, "OFFSET_X", 0.0), _number(g, "OFFSET_Y", 0.0)), "step": (_number(g, "STEP_X", 1.0), _number(g, "STEP_Y", 1.0))}
        tie_points.append(found)
    codings = {c.get("name"): {_text(f, "Flag_Name"): int(_text(f, "Flag_Index")) for f in c.iterfind("Flag")} for c in root.iterfind("Flag_Coding")}
    indexes = {c.get("name"): {_text(f, "INDEX_NAME"): int(_text(f, "INDEX_VALUE")) for f in c.iterfind("Index")} for c in root.iterfind("Index_Coding")}
    production, geo = root.find("Production"), root.find("Geoposition/Geoposition_Points")
    sources = root.find("Dataset_Sources")
    return {
        "name": _text(root, "Dataset_Id/DATASET_NAME") or root.get("name"), "description": _text(root, "Dataset_Id/DATASET_DESCRIPTION") or _text(root, "Dataset_Use/DATASET_COMMENTS"), "type": _text(production, "PRODUCT_TYPE"),
        "start": _text(production, "PRODUCT_SCENE_RASTER_START_TIME"), "stop": _text(production, "PRODUCT_SCENE_RASTER_STOP_TIME"), "height": int(_text(size, "NROWS")), "width": int(_text(size, "NCOLS")),
        "bands": bands, "tie_points": tie_points, "flags": codings, "indexes": indexes, "metadata": _metadata(sources) if sources is not None else {},
        "geocoding": (_text(geo, "TIE_POINT_GRID_NAME_LAT"), _text(geo, "TIE_POINT_GRID_NAME_LON")) if geo is not None else None,
    }


def _order(spark: SparkSession, path: str) -> tuple[str, int]:
    """Byte order and offset of an ENVI header; high byte first at 0 where there is none."""
    store, local = open_store(path)
    if not store.get_file_info(local).is_file:
        return ">", 0
    fields = dict(x.split("=", 1) for x in (r[0] for r in spark.read.text(path).collect()) if "=" in x)  # a few lines
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return "<" if fields.get("byte order", "1") == "0" else ">", int(fields.get("header offset", 0))


def read_header(spark: SparkSession, path: str) -> dict:
    return parse_header(spark.read.text(path, wholetext=True).first()[0])


def _data(path: str, href: str) -> tuple[str, str]:
    header = posixpath.join(posixpath.dirname(path), href)
    return header, re.sub(r"\.hdr$", "", header) + ".img"


def read_dimap(spark: SparkSession, path: str, bands: list[str] | None = None) -> Product:
    """The product of a header file (.dim) with its stored bands, or those named, in physical units (scaled, no-data as missing). What else the header says is in the product's meta; virtual bands are there with their expressions."""
    header = read_header(spark, path)
    stored = [b for b in header["bands"] if b["expression"] is None and b["file"]]
    layout = Layout(header["height"], header["width"])
    for b in stored:
        if bands is not None and b["name"] not in bands:
            continue
        order, start = _order(spark, _data(path, b["file"])[0])
        kind = np.dtype(order + TYPES[b["type"]])
        layout.bands.append(Band(b["name"], [[0, _data(path, b["file"])[1]]], kind.str, kind.itemsize, kind.itemsize * header["width"], start, b["scale"], b["offset"], b["log10"], b["no_data"]))
    return read_raster(spark, layout, bands, meta={k: v for k, v in header.items() if k not in ("height", "width")})


def read_tie_points(spark: SparkSession, path: str, name: str) -> TiePoints:
    """A header's tie-point grid; angles in a cyclic one leap at 180 degrees, or at 360 if one is larger than 180."""
    grid = next((g for g in read_header(spark, path)["tie_points"] if g["name"] == name), None)
    if grid is None:
        raise ValueError(f"no tie-point grid {name}")
    order, start = _order(spark, _data(path, grid["file"])[0])
    kind = np.dtype(order + TYPES[grid["type"]])
    layout = Layout(grid["rows"], grid["cols"], [Band("v", [[0, _data(path, grid["file"])[1]]], kind.str, kind.itemsize, kind.itemsize * grid["cols"], start)])
    points = read_raster(spark, layout).pixels.select(F.col("y").alias("row"), F.col("x").alias("col"), "v")
    leap = 0
    if grid["cyclic"]:
        leap = 360 if (points.agg(F.max("v")).first()[0] or 0) > 180 else 180
    return TiePoints(points, grid["rows"], grid["cols"], *grid["offset"], *grid["step"], leap)


def _child(parent, tag: str, text=None, **attributes):
    element = ET.SubElement(parent, tag, {k: str(v) for k, v in attributes.items()})
    if text is not None:
        element.text = str(text).lower() if isinstance(text, bool) else str(text)
    return element


def _write_metadata(parent, tree: dict) -> None:
    for name, value in tree.items():
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, dict):
                _write_metadata(_child(parent, "MDElem", name=name), v)
            else:
                _child(parent, "MDATTR", v, name=name, type="ascii")


def _envi_header(name: str, kind: np.dtype, height: int, width: int) -> str:
    lines = ["ENVI", f"description = {{{name}}}", f"samples = {width}", f"lines = {height}", "bands = 1", "header offset = 0", "file type = ENVI Standard", f"data type = {ENVI_CODES[kind.str[1:]]}", "interleave = bsq", "byte order = 1", f"band names = {{ {name} }}", ""]
    return "\n".join(lines)


def write_dimap(p: Product, path: str, types: dict[str, str] | None = None, tie_points: dict[str, TiePoints] | None = None, name: str | None = None, lines: int | None = None) -> None:
    """p's bands, and grids of tie points, under path (ending in .dim) and the folder beside it that ends in .data.

    types: sample types by band (float32 if not given; whole ones round half up).
    p.meta can hold what parse_header() gives; bands' units, descriptions,
    scalings and no-data values are taken from there, and samples are scaled
    back. A band with missing pixels needs a no-data value unless it is of floats
    without one, which hold NaN. Scaled bands of whole numbers are stored by their
    raw samples.
    """
    spark = p.pixels.sparkSession
    known = {b["name"]: b for b in p.meta.get("bands", [])}
    types = {b: (types or {}).get(b) or known.get(b, {}).get("type") or "float32" for b in p.bands}
    base, data = posixpath.dirname(path), re.sub(r"\.dim$", "", posixpath.basename(path)) + ".data"
    raw, fill = {}, {}
    for b in p.bands:
        k = known.get(b, {})
        v = F.col(f"`{b}`").cast("double")
        v = F.log10(v) if k.get("log10") else v
        raw[b] = (v - k.get("offset", 0.0)) / k.get("scale", 1.0)
        if k.get("no_data") is not None:
            fill[b] = k["no_data"]
    strips = posixpath.join(base, f"{data}/strips-{uuid.uuid4().hex[:12]}")
    write_raster(p.with_bands(**raw), strips, {b: ">" + TYPES[t] for b, t in types.items()}, fill, lines)
    join_strips(spark, read_layout(spark, strips), {b: posixpath.join(base, data, f"{b}.img") for b in p.bands})
    store, local = open_store(strips)
    store.delete_dir(local)
    for n, t in (tie_points or {}).items():
        grid = Product(t.points.select(F.col("row").alias("y"), F.col("col").alias("x"), F.col("v").alias(n)), t.rows, t.cols)
        write_raster(grid, strips, ">f4", lines=max(t.rows, 1))
        join_strips(spark, read_layout(spark, strips), {n: posixpath.join(base, data, f"tie_point_grids/{n}.img")})
        store.delete_dir(local)

    title = name or p.meta.get("name") or re.sub(r"\.dim$", "", posixpath.basename(path))
    root = ET.Element("Dimap_Document", {"name": posixpath.basename(path)})
    format_ = _child(root, "Metadata_Id")
    _child(format_, "METADATA_FORMAT", "DIMAP", version="2.12.1")
    dataset = _child(root, "Dataset_Id")
    _child(dataset, "DATASET_NAME", title)
    if p.meta.get("description"):
        _child(dataset, "DATASET_DESCRIPTION", p.meta["description"])
    production = _child(root, "Production")
    _child(production, "DATASET_PRODUCER_NAME")
    _child(production, "PRODUCT_TYPE", p.meta.get("type") or "")
    for tag, k in (("PRODUCT_SCENE_RASTER_START_TIME", "start"), ("PRODUCT_SCENE_RASTER_STOP_TIME", "stop")):
        if p.meta.get(k):
            _child(production, tag, p.meta[k])
    if p.meta.get("geocoding") and set(p.meta["geocoding"]) <= set(tie_points or {}):
        points = _child(_child(root, "Geoposition"), "Geoposition_Points")
        _child(points, "TIE_POINT_GRID_NAME_LAT", p.meta["geocoding"][0])
        _child(points, "TIE_POINT_GRID_NAME_LON", p.meta["geocoding"][1])
    for coding, flags in p.meta.get("flags", {}).items():
        element = _child(root, "Flag_Coding", name=coding)
        for flag, bit in flags.items():
            one = _child(element, "Flag")
            _child(one, "Flag_Name", flag)
            _child(one, "Flag_Index", bit)
            _child(one, "Flag_description", "")
    for coding, values in p.meta.get("indexes", {}).items():
        element = _child(root, "Index_Coding", name=coding)
        for index, value in values.items():
            one = _child(element, "Index")
            _child(one, "INDEX_NAME", index)
            _child(one, "INDEX_VALUE", value)
            _child(one, "INDEX_DESCRIPTION", "")
    size = _child(root, "Raster_Dimensions")
    _child(size, "NCOLS", p.width)
    _child(size, "NROWS", p.height)
    virtual = [b for b in p.meta.get("bands", []) if b.get("expression")]
    _child(size, "NBANDS", len(p.bands) + len(virtual))
    access = _child(root, "Data_Access")
    _child(access, "DATA_FILE_FORMAT", "ENVI")
    _child(access, "DATA_FILE_FORMAT_DESC", "ENVI File Format")
    _child(access, "DATA_FILE_ORGANISATION", "BAND_SEPARATE")
    for i, b in enumerate(p.bands):
        file = _child(access, "Data_File")
        _child(file, "DATA_FILE_PATH", href=f"{data}/{b}.hdr")
        _child(file, "BAND_INDEX", i)
    for i, n in enumerate(tie_points or {}):
        file = _child(access, "Tie_Point_Grid_File")
        _child(file, "TIE_POINT_GRID_FILE_PATH", href=f"{data}/tie_point_grids/{n}.hdr")
        _child(file, "TIE_POINT_GRID_INDEX", i)
    if tie_points:
        grids = _child(root, "Tie_Point_Grids")
        _child(grids, "NUM_TIE_POINT_GRIDS", len(tie_points))
        units = {g["name"]: g for g in p.meta.get("tie_points", [])}
        for i, (n, t) in enumerate(tie_points.items()):
            info = _child(grids, "Tie_Point_Grid_Info")
            texts = {"TIE_POINT_GRID_INDEX": i, "TIE_POINT_DESCRIPTION": units.get(n, {}).get("description") or "", "PHYSICAL_UNIT": units.get(n, {}).get("unit") or "", "TIE_POINT_GRID_NAME": n, "DATA_TYPE": "float32", "NCOLS": t.cols, "NROWS": t.rows, "OFFSET_X": t.offset_x, "OFFSET_Y": t.offset_y, "STEP_X": t.step_x, "STEP_Y": t.step_y, "CYCLIC": t.discontinuity != 0}
            for tag, text in texts.items():
                _child(info, tag, text)
    bands = _child(root, "Image_Interpretation")
    for i, b in enumerate([*({"name": b, "type": types[b]} for b in p.bands), *virtual]):
        k = known.get(b["name"], {})
        info = _child(bands, "Spectral_Band_Info")
        no_data = fill.get(b["name"])
        texts = {"BAND_INDEX": i, "BAND_DESCRIPTION": k.get("description") or "", "BAND_NAME": b["name"], "DATA_TYPE": b.get("type") or "float32", "PHYSICAL_UNIT": k.get("unit") or "", "SOLAR_FLUX": k.get("solar_flux", 0.0), "BAND_WAVELEN": k.get("wavelength", 0.0), "BANDWIDTH": k.get("bandwidth", 0.0)}
        if k.get("coding"):
            texts["FLAG_CODING_NAME" if k["coding"] in p.meta.get("flags", {}) else "INDEX_CODING_NAME"] = k["coding"]
        texts |= {"SCALING_FACTOR": k.get("scale", 1.0), "SCALING_OFFSET": k.get("offset", 0.0), "LOG10_SCALED": bool(k.get("log10")), "NO_DATA_VALUE_USED": no_data is not None, "NO_DATA_VALUE": no_data if no_data is not None else 0.0}
        if b.get("expression"):
            texts |= {"VIRTUAL_BAND": True, "EXPRESSION": b["expression"]}
        if k.get("valid"):
            texts["VALID_MASK_TERM"] = k["valid"]
        for tag, text in texts.items():
            _child(info, tag, text)
    if p.meta.get("metadata"):
        _write_metadata(_child(root, "Dataset_Sources"), p.meta["metadata"])
    ET.indent(root, "    ")
    store, local = open_store(path)
    files = {f"{b}.hdr": _envi_header(b, np.dtype(">" + TYPES[types[b]]), p.height, p.width) for b in p.bands}
    files |= {f"tie_point_grids/{n}.hdr": _envi_header(n, np.dtype(">f4"), t.rows, t.cols) for n, t in (tie_points or {}).items()}
    for n, text in files.items():
        with store.open_output_stream(posixpath.join(posixpath.dirname(local), data, n)) as out:
            out.write(text.encode())
    with store.open_output_stream(local) as out:
        out.write(b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="utf-8"))
