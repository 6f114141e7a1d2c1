"""Coordinates as columns: transverse Mercator by Krueger's series, Web Mercator, cells and footprints."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6) + 1


def utm_epsg(mean_lon: Column, mean_lat: Column) -> Column:
    """Zone code of a set of points from its mean position; zones have no regional exceptions."""
    return (F.when(mean_lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(mean_lon)).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + K0 * _RADIUS * east, F.when(lat < 0, F.lit(1e7)).otherwise(F.lit(0.0)) + K0 * _RADIUS * north


def from_utm(x: Column, y: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    y = y if south is None else y - F.when(south, F.lit(1e7)).otherwise(F.lit(0.0))
    xi, eta = y / (K0 * _RADIUS), (x - 500000) / (K0 * _RADIUS)
    xi2, eta2 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi2 = xi2 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta2 = eta2 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(phi)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres; latitudes beyond 85 degrees are held there."""
    held = F.least(F.greatest(lat, F.lit(-85.0)), F.lit(85.0))
    return F.radians(lon) * A, F.log(F.tan(F.radians(held) / 2 + math.pi / 4)) * A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def snap(v: Column, cell: float = 10.0) -> Column:
    """Centre of the cell that holds a projected coordinate."""
    return F.floor(v / cell) * cell + cell / 2


def metres(lon: Column, lat: Column, per_lon: float, per_lat: float) -> tuple[Column, Column]:
    """Local equirectangular coordinates."""
    return lon * per_lon, lat * per_lat


def degree_cell(lon: Column, lat: Column, size: float) -> Column:
    """Key of the degree cell around a rounded position (half to even)."""
    return F.concat(F.lit("cell_"), F.bround(lon / size).cast("long").cast("string"), F.lit("_"), F.bround(lat / size).cast("long").cast("string"))


def grid(min_x: Column, min_y: Column, max_x: Column, max_y: Column, cell: float) -> Column:
    """Grid of whole cells over a box: left and upper edge, columns and rows; rows grow to the south."""
    x0, y0 = F.floor(min_x / cell) * cell, F.ceil(max_y / cell) * cell
    return F.struct(
        x0.alias("x0"), y0.alias("y0"), F.greatest(F.lit(1), F.ceil((max_x - x0) / cell)).cast("int").alias("width"),
        F.greatest(F.lit(1), F.ceil((y0 - min_y) / cell)).cast("int").alias("height"))


def pixel(x: Column, y: Column, x0: Column, y0: Column, cell: float) -> tuple[Column, Column]:
    """Row and column of a projected point."""
    return F.floor((y0 - y) / cell), F.floor((x - x0) / cell)


def box_zoom(width_deg: Column, height_deg: Column) -> Column:
    """Web-map zoom that shows a box, 1 to 18."""
    span = F.greatest(width_deg, height_deg, F.lit(1e-6))
    return F.least(F.greatest(F.floor(F.log2(360 / span)), F.lit(1)), F.lit(18)).cast("int")
