"""Whole products with their grids and metadata: subsets that keep what bands refer to, and metadata from another product."""

from __future__ import annotations

import copy
import re

from pyspark.sql import functions as F

from ..product import Product
from . import tie_points as tp
from .pixels import mask_polygon, subset
from .vectors import parts_of


def referenced(p: Product, names: list[str], known: list[str]) -> list[str]:
    """names and all of `known` that their expressions and valid-mask terms (in the product's metadata of bands) refer to, directly or through others, in that order."""
    about = {b["name"]: b for b in p.meta.get("bands", [])}
    out = list(dict.fromkeys(names))
    for name in out:  # grows while it is gone through
        for text in (about.get(name, {}).get("expression"), about.get(name, {}).get("valid")):
            words = re.findall(r"[A-Za-z_][A-Za-z0-9_.]*", text or "")
            out += [w for w in dict.fromkeys(x for word in words for x in (word, word.split(".")[0])) if w in known and w not in out]
    return out


def pixel_region(p: Product, wkt: str, lat: str = "lat", lon: str = "lon") -> tuple[int, int, int, int]:
    """x, y, width and height of the pixels whose place (bands lat and lon) lies in a polygon given as text with longitudes first; ValueError if there is none."""
    rings = p.pixels.sparkSession.range(1).select(parts_of(F.lit(wkt)).alias("r")).first()["r"]  # one geometry
    inside = F.lit(False)
    for ring in rings:
        corners = [(q["x"], q["y"]) for q in ring]
        inside = inside != mask_polygon(corners, F.col(lon), F.col(lat))
    found = p.pixels.where(inside).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if found["x0"] is None:
        raise ValueError("the region doesn't meet the product")
    return found["x0"], found["y0"], found["x1"] - found["x0"] + 1, found["y1"] - found["y0"] + 1


def product_subset(p: Product, grids: dict[str, tp.TiePoints] | None = None, region: tuple[int, int, int, int] | str | None = None, step: tuple[int, int] = (1, 1), bands: list[str] | None = None, grid_names: list[str] | None = None, full_swath: bool = False, copy_metadata: bool = False) -> tuple[Product, dict[str, tp.TiePoints]]:
    """A product's part and its tie-point grids' parts.

    region: x, y, width and height, or a polygon as text over bands lat and lon; all
    by default. step: each n-th pixel along (x, y). Bands and grids by name (all by
    default) bring along what they refer to; virtual bands stay in the metadata.
    full_swath takes whole lines. The tree `metadata` is copied only if it is asked
    for; what describes bands and codings always is.
    """
    grids = grids or {}
    virtual = [b["name"] for b in p.meta.get("bands", []) if b.get("expression")]
    known = [*p.bands, *virtual, *grids]
    asked = [*(bands if bands is not None else [*p.bands, *virtual]), *(grid_names if grid_names is not None else grids)]
    lacking = [n for n in asked if n not in known]
    if lacking:
        raise ValueError(f"the product has no {lacking}")
    keep = referenced(p, asked, known)
    x, y, width, height = pixel_region(p, region) if isinstance(region, str) else region or (0, 0, p.width, p.height)
    if full_swath:
        x, width = 0, p.width
    x1, y1 = min(x + width, p.width), min(y + height, p.height)
    x, y = max(x, 0), max(y, 0)
    if x >= x1 or y >= y1:
        raise ValueError("the region doesn't meet the product")
    q = subset(p.select(*[b for b in p.bands if b in keep]), x, y, x1 - x, y1 - y, *step)
    meta = {k: v for k, v in p.meta.items() if k != "metadata" or copy_metadata}
    if "bands" in meta:
        meta["bands"] = [b for b in meta["bands"] if b["name"] in keep]
    parts = {n: tp.subset(g, x, y, x1 - x, y1 - y, *step) for n, g in grids.items() if n in keep}
    return q.with_pixels(q.pixels, meta=meta), parts


KEPT = ("polsarData", "abs_calibration_flag")
POLARISATIONS = ("mds1_tx_rx_polar", "mds2_tx_rx_polar", "mds3_tx_rx_polar", "mds4_tx_rx_polar")


def replace_metadata(p: Product, other: Product, root: str = "Abstracted_Metadata") -> Product:
    """p's bands with the other product's type, times and metadata. What says that p is polarimetric or calibrated stays so; a polarimetric one has no polarisation of a band."""
    metadata = copy.deepcopy(other.meta.get("metadata", {}))
    own, new = p.meta.get("metadata", {}).get(root, {}), metadata.setdefault(root, {})
    set_ = lambda k: str(own.get(k, "0")).strip().lower() in ("1", "true")
    if set_("polsarData"):
        new.update(dict.fromkeys(POLARISATIONS, " "))
    new.update({k: "1" for k in KEPT if set_(k)})
    taken = {k: v for k, v in other.meta.items() if k not in ("bands", "name", "metadata")}
    return p.with_pixels(p.pixels, meta={**p.meta, **taken, "metadata": metadata})
