"""Web-Mercator cells and tiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_ZOOM = 14


def x_frac(lon: Column, zoom: int = CELL_ZOOM) -> Column:
    return (lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(1 << zoom))


def y_frac(lat: Column, zoom: int = CELL_ZOOM) -> Column:
    r = F.radians(lat)
    return (F.lit(1.0) - F.ln(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.lit(math.pi)) / F.lit(2.0) * F.lit(float(1 << zoom))


def cell_x(lon: Column, zoom: int = CELL_ZOOM) -> Column:
    return F.floor(x_frac(lon, zoom)).cast("int")


def cell_y(lat: Column, zoom: int = CELL_ZOOM) -> Column:
    return F.floor(y_frac(lat, zoom)).cast("int")


def tile_bbox(z: Column, x: Column, y: Column) -> Column:
    """min_lon, min_lat, max_lon, max_lat of a tile, as a struct."""
    n = F.pow(F.lit(2.0), z)
    lon = lambda c: c / n * F.lit(360.0) - F.lit(180.0)
    lat = lambda c: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * c / n))))
    return F.struct(lon(x).alias("min_lon"), lat(y + 1).alias("min_lat"), lon(x + 1).alias("max_lon"), lat(y).alias("max_lat"))


def tiles_for_cell(x: Column, y: Column) -> Column:
    """Tiles that a changed cell touches: its 3 x 3 ring at zoom 14, and its parents at 13 and 12; an array of (z, x, y)."""
    top = F.lit(1 << CELL_ZOOM)
    ring = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dx: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dy: F.struct(F.lit(CELL_ZOOM).alias("z"), (x + dx).alias("x"), (y + dy).alias("y")))))
    inside = F.filter(ring, lambda t: (t.x >= 0) & (t.x < top) & (t.y >= 0) & (t.y < top))
    above = F.array(*(F.struct(F.lit(CELL_ZOOM - k).alias("z"), F.shiftright(x, k).alias("x"), F.shiftright(y, k).alias("y")) for k in (1, 2)))
    return F.concat(inside, above)


def cells_for_bbox(x0: Column, y0: Column, x1: Column, y1: Column, buffer: float = 0.0, most: int = 1024) -> Column:
    """All cells that a box, widened by so many degrees, touches; null above `most` cells or without a box."""
    left, right = cell_x(x0 - buffer), cell_x(x1 + buffer)
    up, down = cell_y(y1 + buffer), cell_y(y0 - buffer)
    n = (right - left + 1).cast("long") * (down - up + 1)
    every = F.flatten(F.transform(F.sequence(left, right), lambda x: F.transform(F.sequence(up, down), lambda y: F.struct(x.alias("cell_x"), y.alias("cell_y")))))
    return F.when(n.between(1, most), every)
