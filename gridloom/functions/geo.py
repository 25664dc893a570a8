"""Coordinates, distances, grids and geometry keys in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.guards import ratio

EARTH_M = 6371008.8
MERCATOR_M = 6378137.0


class CrsError(ValueError):
    """A coordinate system that has no closed form here."""


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - F.lit(math.pi / 2))


# Transverse Mercator by its series in the third flattening, WGS84.
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = MERCATOR_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_K0, _EAST = 0.9996, 500_000.0


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing in the UTM zone of an EPSG code 326xx or 327xx."""
    zone, south = _zone(epsg)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    return _EAST + _K0 * _A * x, _K0 * _A * y + (1e7 if south else 0)


def from_utm(east: Column, north: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude of UTM coordinates."""
    zone, south = _zone(epsg)
    xi, eta = (north - (1e7 if south else 0)) / (_K0 * _A), (east - _EAST) / (_K0 * _A)
    x = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    y = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)


def _zone(epsg: int) -> tuple[int, bool]:
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise CrsError(f"EPSG:{epsg} has no closed form here")
    return epsg % 100, epsg >= 32700


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates between 4326, 3857 and UTM zones, x (longitude, easting) first; other codes are a CrsError."""
    if source == target:
        return x, y
    lon, lat = (x, y) if source == 4326 else from_mercator(x, y) if source == 3857 else from_utm(x, y, source)
    return (lon, lat) if target == 4326 else to_mercator(lon, lat) if target == 3857 else to_utm(lon, lat, target)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def bbox_around(lon: Column, lat: Column, km: float) -> dict[str, Column]:
    dlat, dlon = F.lit(km / 111.32), F.lit(km) / (111.32 * F.cos(F.radians(lat)))
    return {"west": lon - dlon, "south": lat - dlat, "east": lon + dlon, "north": lat + dlat}


def bbox_valid(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (south >= -90) & (south < north) & (north <= 90) & (west >= -180) & (west < east) & (east <= 180)


def outside_world(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    return (lon_min < -180) | (lat_min < -90) | (lon_max > 180) | (lat_max > 90)


def world_to_pixel(x: Column, y: Column, west: float, north: float, res: float) -> tuple[Column, Column]:
    """Row and column of a point in a north-up grid; fractions are cut off towards zero."""
    return ((F.lit(north) - y) / res).cast("int"), ((x - F.lit(west)) / res).cast("int")


def geometry_key(coordinates: Column) -> Column:
    """Coordinates (array of [x, y]) rounded to 6 places as text; null has a key of its own."""
    return F.coalesce(F.to_json(F.transform(coordinates, lambda p: F.transform(p, lambda v: F.round(v, 6)))), F.lit("null-geometry"))


def property_key(*properties: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in properties])


def key_value(tag: Column) -> tuple[Column, Column]:
    """Both sides of the first '='; null unless both are non-empty."""
    at = F.instr(tag, "=")
    key, value = F.trim(F.substring(tag, F.lit(1), at - 1)), F.trim(F.substring(tag, at + 1, F.length(tag)))
    ok = (at > 0) & (key != "") & (value != "")
    return F.when(ok, key), F.when(ok, value)


def ring_area(ring: Column) -> Column:
    """Area of a closed ring (array of structs x, y) by the shoelace formula."""
    n = F.size(ring)
    pairs = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    twice = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + ring[i - 1]["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * ring[i - 1]["y"])
    return F.when(n >= 4, F.abs(twice) / 2).otherwise(0.0)


def ring_length(ring: Column) -> Column:
    n = F.size(ring)
    pairs = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.when(n >= 2, F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.hypot(F.get(ring, i)["x"] - ring[i - 1]["x"], F.get(ring, i)["y"] - ring[i - 1]["y"]))).otherwise(0.0)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule on a closed ring (array of structs x, y)."""
    pairs = F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))

    def crosses(i: Column) -> Column:
        ax, ay, bx, by = ring[i - 1]["x"], ring[i - 1]["y"], F.get(ring, i)["x"], F.get(ring, i)["y"]
        return F.coalesce(((ay > y) != (by > y)) & (x < (bx - ax) * ratio(y - ay, by - ay) + ax), F.lit(False))

    return F.aggregate(pairs, F.lit(0), lambda s, i: s + crosses(i).cast("int")) % 2 == 1


def hex_to_rgb(text: Column) -> Column:
    """'r,g,b' of '#rrggbb'."""
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10)
    return F.concat_ws(",", part(2), part(4), part(6))
