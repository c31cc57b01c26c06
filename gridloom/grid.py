"""The global latitude/longitude tile grid: 2^z by 2^(z-1) tiles from (-180, -90), rows of tiles counted upwards.

Pixels have global coordinates gx (from the west) and gy (from the north). All functions are plain arithmetic; the
column versions compile to codegen'd expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
METERS_PER_DEGREE = 2 * math.pi * EARTH_RADIUS / 360
MAX_ZOOM = 22


@dataclass(frozen=True)
class Bounds:
    w: float = -180.0
    s: float = -90.0
    e: float = 180.0
    n: float = 90.0

    def expand(self, o: Bounds) -> Bounds:
        return Bounds(min(self.w, o.w), min(self.s, o.s), max(self.e, o.e), max(self.n, o.n))

    def intersect(self, o: Bounds) -> Bounds | None:
        b = Bounds(max(self.w, o.w), max(self.s, o.s), min(self.e, o.e), min(self.n, o.n))
        return b if b.w <= b.e and b.s <= b.n else None


@dataclass(frozen=True)
class TileBounds:
    """Inclusive."""

    w: int
    s: int
    e: int
    n: int

    @property
    def count(self) -> int:
        return max(0, self.e - self.w + 1) * max(0, self.n - self.s + 1)


def tiles_wide(zoom: int) -> int:
    return 1 << zoom


def tiles_high(zoom: int) -> int:
    return 1 << max(0, zoom - 1)


def resolution(zoom: int, tilesize: int) -> float:
    """Degrees of a pixel."""
    return 180.0 / tilesize / 2 ** (zoom - 1) if zoom > 0 else 0.0


def zoom_for_pixel_size(size: float, tilesize: int) -> int:
    """The first zoom whose pixels are not larger; 0 if there is none up to MAX_ZOOM."""
    return next((z for z in range(1, MAX_ZOOM + 1) if resolution(z, tilesize) <= size + 1e-8), 0)


def tile_id(tx: int, ty: int, zoom: int) -> int:
    return (ty << zoom) + tx


def tile_xy(tid: int, zoom: int) -> tuple[int, int]:
    return tid % (1 << zoom), tid >> zoom


def tile_bounds(tx: int, ty: int, zoom: int, tilesize: int) -> Bounds:
    d = tilesize * resolution(zoom, tilesize)
    return Bounds(tx * d - 180, ty * d - 90, (tx + 1) * d - 180, (ty + 1) * d - 90)


def lat_lon_to_pixel(lat: float, lon: float, zoom: int, tilesize: int) -> tuple[int, int]:
    """(gx, gy) of the pixel, gy from the north."""
    r = resolution(zoom, tilesize)
    return int((180.0 + lon) / r), tiles_high(zoom) * tilesize - 1 - int((90.0 + lat) / r)


def pixel_to_lat_lon(gx: int, gy: int, zoom: int, tilesize: int) -> tuple[float, float]:
    """The north-west corner."""
    r = resolution(zoom, tilesize)
    return 90.0 - gy * r, gx * r - 180.0


def lat_lon_to_tile(lat: float, lon: float, zoom: int, tilesize: int) -> tuple[int, int]:
    r = resolution(zoom, tilesize) * tilesize
    return int((180.0 + lon) / r), int((90.0 + lat) / r)


def bounds_to_tiles(b: Bounds, zoom: int, tilesize: int) -> TileBounds:
    """Lower edges belong to their tile; an upper edge that falls on the border of tiles belongs to the lower one."""
    r = resolution(zoom, tilesize) * tilesize
    w, s = int((180.0 + b.w) / r), int((90.0 + b.s) / r)
    e, n = int(math.ceil((180.0 + b.e) / r)) - 1, int(math.ceil((90.0 + b.n) / r)) - 1
    clip = lambda v, most: min(max(v, 0), most)
    return TileBounds(clip(w, tiles_wide(zoom) - 1), clip(s, tiles_high(zoom) - 1), clip(max(e, w), tiles_wide(zoom) - 1), clip(max(n, s), tiles_high(zoom) - 1))


def bounds_to_pixels(b: Bounds, zoom: int, tilesize: int) -> tuple[int, int, int, int]:
    """(gx0, gy0, gx1, gy1), inclusive; upper edges as for tiles."""
    r = resolution(zoom, tilesize)
    high = tiles_high(zoom) * tilesize
    x0, y0 = int((180.0 + b.w) / r), int((90.0 + b.s) / r)
    x1, y1 = max(x0, math.ceil((180.0 + b.e) / r) - 1), max(y0, math.ceil((90.0 + b.n) / r) - 1)
    return x0, high - 1 - y1, x1, high - 1 - y0


def meters(zoom: int, tilesize: int) -> float:
    return resolution(zoom, tilesize) * METERS_PER_DEGREE


def tx_column(tid: Column, zoom: int) -> Column:
    return tid % F.lit(1 << zoom)


def ty_column(tid: Column, zoom: int) -> Column:
    return F.shiftright(tid, zoom)


def pixel_columns(lon: Column, lat: Column, zoom: int, tilesize: int) -> tuple[Column, Column]:
    """(gx, gy) of points."""
    r = resolution(zoom, tilesize)
    return F.floor((lon + 180.0) / r), F.lit(tiles_high(zoom) * tilesize - 1) - F.floor((lat + 90.0) / r)


def tile_of_pixel(gx: Column, gy: Column, zoom: int, tilesize: int) -> Column:
    ty = F.lit(tiles_high(zoom) - 1) - F.floor(gy / tilesize)
    return ty * (1 << zoom) + F.floor(gx / tilesize)
