"""Coordinate reference systems by their text: a code, or well-known text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..product import Product
from . import geometry as g

Pair = tuple[Column, Column]


@dataclass(frozen=True)
class Projection:
    """forward takes latitude and longitude (degrees) to map coordinates (x to the east, y to the north), inverse back."""

    name: str
    forward: Callable[[Column, Column], Pair]
    inverse: Callable[[Column, Column], Pair]


def _shifted(name: str, forward, inverse, east: float, north: float, unit: float = 1.0) -> Projection:
    def there(lat: Column, lon: Column) -> Pair:
        x, y = forward(lat, lon)
        return (x + east) / unit, (y + north) / unit

    return Projection(name, there, lambda x, y: inverse(x * unit - east, y * unit - north))


def _utm(zone: int, south: bool) -> Projection:
    lon0, north = 6.0 * zone - 183.0, 10_000_000.0 if south else 0.0
    return Projection(f"UTM zone {zone}{'S' if south else 'N'}", lambda lat, lon: g.transverse_mercator(lat, lon, lon0, north=north), lambda x, y: g.transverse_mercator_inverse(x, y, lon0, north=north))


def projection(text: str) -> Projection:
    """Of EPSG:4326 and WGS 84 / UTM (EPSG:32601 to 32660 and 32701 to 32760) by code, or of GEOGCS and PROJCS texts with a projection that the geometry module has.

    Parameters that a text lacks are 0, scales 1. Angles are in degrees; lengths are
    in the PROJCS's unit. Others raise ValueError.
    """
    code = re.fullmatch(r"\s*EPSG:(\d+)\s*", text, re.IGNORECASE)
    if code:
        n = int(code[1])
        if n == 4326:
            return Projection("geographic", lambda lat, lon: (lon, lat), lambda x, y: (y, x))
        if 32601 <= n <= 32660 or 32701 <= n <= 32760:
            return _utm(n % 100, n > 32700)
        raise ValueError(f"EPSG:{n} is not known")
    kind = re.match(r"\s*(GEOGCS|PROJCS)\s*\[", text, re.IGNORECASE)
    if not kind:
        raise ValueError("neither a code nor well-known text")
    if kind[1].upper() == "GEOGCS":
        return projection("EPSG:4326")
    name = re.search(r'PROJECTION\s*\[\s*"([^"]+)"', text, re.IGNORECASE)
    given = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]+)"\s*,\s*([-+0-9.eE]+)', text, re.IGNORECASE)}
    outside = re.sub(r"GEOGCS\s*\[.*?\]\s*\]", "", text, flags=re.IGNORECASE | re.DOTALL)  # the unit of lengths stands outside the geographic part
    units = re.findall(r'UNIT\s*\[\s*"[^"]*"\s*,\s*([-+0-9.eE]+)', outside, re.IGNORECASE)
    unit = float(units[-1]) if units else 1.0
    unit = unit if unit > 0.1 else 1.0  # an angle's
    p = lambda n, *others: next((given[k] for k in (n, *others) if k in given), 0.0)
    lat0, lon0 = p("latitude_of_origin", "latitude_of_center"), p("central_meridian", "longitude_of_center")
    lat1, lat2 = p("standard_parallel_1"), p("standard_parallel_2")
    east, north = p("false_easting") * unit, p("false_northing") * unit
    scale = given.get("scale_factor", 1.0)
    kind = re.sub(r"[^a-z]", "", (name[1] if name else "").lower())
    if kind == "transversemercator":
        return _shifted(name[1], lambda lat, lon: g.transverse_mercator(lat, lon, lon0, scale, 0.0, 0.0), lambda x, y: g.transverse_mercator_inverse(x, y, lon0, scale, 0.0, 0.0), east, north, unit)
    if kind == "sinusoidal":
        return _shifted(name[1], lambda lat, lon: g.sinusoidal(lat, lon, lon0), lambda x, y: g.sinusoidal_inverse(x, y, lon0), east, north, unit)
    if kind in ("albers", "albersconicequalarea", "albersequalarea"):
        return _shifted(name[1], lambda lat, lon: g.albers(lat, lon, lat1, lat2, lat0, lon0), lambda x, y: g.albers_inverse(x, y, lat1, lat2, lat0, lon0), east, north, unit)
    if kind in ("lambertconformalconicsp", "lambertconformalconic", "lambertconformalconicspbelgium"):
        one, two = (lat1 or lat0), (lat2 or lat1 or lat0)
        return _shifted(name[1], lambda lat, lon: g.lambert_conformal(lat, lon, one, two, lat0, lon0), lambda x, y: g.lambert_conformal_inverse(x, y, one, two, lat0, lon0), east, north, unit)
    if kind in ("stereographic", "polarstereographic", "obliquestereographic"):
        return _shifted(name[1], lambda lat, lon: g.stereographic(lat, lon, lat0, lon0), lambda x, y: g.stereographic_inverse(x, y, lat0, lon0), east, north, unit)
    if kind == "mollweide":
        return _shifted(name[1], lambda lat, lon: g.mollweide(lat, lon, lon0), lambda x, y: g.mollweide_inverse(x, y, lon0), east, north, unit)
    raise ValueError(f"projection {name[1] if name else 'without a name'} is not known")


def reproject_to(source: Product, band: str, origin: tuple[float, float], step: tuple[float, float], crs: str, target: DataFrame, height: int, width: int, corner: tuple[float, float], spacing: float, method: str = "bilinear") -> Product:
    """geometry.reproject() onto a grid of the coordinate reference system that the text names."""
    return g.reproject(source, band, origin, step, projection(crs).inverse, target, height, width, corner, spacing, method)
