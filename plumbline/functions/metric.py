"""Distances, areas and the projection of the Polish national grid, as column expressions. Constants are doubles throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84, the mean sphere, and the national grid (Gauss-Krueger at 19 degrees, scale 0.9993).
A, E2 = 6378137.0, 0.00669437999014
SPHERE_RADIUS = 6371008.8
SCALE, CENTRAL, FALSE_EASTING, FALSE_NORTHING = 0.9993, 19.0, 500000.0, -5300000.0
LON_METRES, LAT_METRES = A * math.pi / 180, A * (1 - E2) * math.pi / 180


def sphere_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the mean sphere."""
    p, q = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((q - p) / F.lit(2.0)), F.sin(F.radians(lon2 - lon1) / F.lit(2.0))
    return F.lit(2 * SPHERE_RADIUS) * F.asin(F.sqrt(s * s + F.cos(p) * F.cos(q) * t * t))


def _w(lat: Column) -> Column:
    return F.lit(1.0) - F.lit(E2) * F.sin(F.radians(lat)) * F.sin(F.radians(lat))


def vertex_shift(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between near points, from degree differences at the mid-latitude."""
    mid = (lat1 + lat2) / F.lit(2.0)
    w = _w(mid)
    dx = (lon1 - lon2) * F.lit(LON_METRES) * F.cos(F.radians(mid)) / F.sqrt(w)
    dy = (lat1 - lat2) * F.lit(LAT_METRES) / F.pow(w, F.lit(1.5))
    return F.sqrt(dx * dx + dy * dy)


def area_m2(square_degrees: Column, mid_lat: Column) -> Column:
    w = _w(mid_lat)
    return square_degrees * F.lit(LON_METRES * LAT_METRES) * F.cos(F.radians(mid_lat)) / (w * w)


def approx_area_m2(square_degrees: Column, mid_lat: Column) -> Column:
    return F.round(area_m2(square_degrees, mid_lat)).cast("int")


def metres_per_degree(lat: Column) -> Column:
    """lat, lon: metres of one degree of each at a latitude, by their cosine series."""
    r = F.radians(lat)
    c = lambda k: F.cos(F.lit(float(k)) * r)
    return F.struct((F.lit(111132.92) - F.lit(559.82) * c(2) + F.lit(1.175) * c(4)).alias("lat"), (F.lit(111412.84) * c(1) - F.lit(93.5) * c(3) + F.lit(0.118) * c(5)).alias("lon"))


def _series():
    """Inverse Krueger coefficients and the rectifying radius of GRS 80, from the flattening."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280,
    ]
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return beta, radius, 2 * math.sqrt(n) / (1 + n)


def grid_to_lonlat(east: Column, north: Column) -> Column:
    """lon, lat (WGS 84) of national grid metres, x first."""
    beta, radius, e = _series()
    xi = (north - F.lit(FALSE_NORTHING)) / F.lit(SCALE * radius)
    eta = (east - F.lit(FALSE_EASTING)) / F.lit(SCALE * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        k = F.lit(2.0 * j)
        xi1 = xi1 - F.lit(b) * F.sin(k * xi) * F.cosh(k * eta)
        eta1 = eta1 - F.lit(b) * F.cos(k * xi) * F.sinh(k * eta)
    sin_chi = F.sin(xi1) / F.cosh(eta1)
    lon = F.lit(CENTRAL) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    psi = F.atanh(sin_chi)
    s = sin_chi
    for _ in range(6):  # isometric to geodetic latitude, a fixed-point iteration that gains three digits a step
        s = F.tanh(psi + F.lit(e) * F.atanh(F.lit(e) * s))
    return F.struct(lon.alias("lon"), F.degrees(F.asin(s)).alias("lat"))
