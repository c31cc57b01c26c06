"""What map services read: a tile, a map of any bounds and size, legends and descriptions. No HTTP."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import groupby
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import functions as F

from .. import grid
from ..functions.colors import GREY, ColorScale
from ..grid import Bounds
from ..meta import RasterMeta
from ..operators.aggregate import coarser
from ..raster import Raster
from ..sources.catalog import Catalog
from ..sources.images import stitch, write_jpeg, write_png, write_tiff


def pick_zoom(levels: list[int], bounds: Bounds, width: int, tilesize: int) -> int:
    """The coarsest stored level that is at least as fine as the request, else the finest."""
    wanted = grid.zoom_for_pixel_size((bounds.e - bounds.w) / width, tilesize)
    return next((z for z in sorted(levels) if z >= wanted > 0), max(levels))


def _paint(a: np.ndarray, scale: ColorScale, low: float, high: float, quantiles: tuple[float, ...] = ()) -> list[np.ndarray]:
    stops = scale.resolved(low, high, quantiles)
    if scale.scaling.lower() == "modulo":
        a = np.fmod(a, stops[-1][0])
    x = np.array([s for s, _ in stops])
    out = []
    for band in range(4):
        c = np.array([s[1][band] for s in stops], float)
        v = np.interp(a, x, c) if scale.interpolate else c[np.clip(np.searchsorted(x, a, "right") - 1, 0, len(x) - 1)]
        out.append(np.where(np.isnan(a), scale.nodata[band], v))
    return out


def _level(catalog: Catalog, name: str, bounds: Bounds, width: int) -> Raster:
    """The tiles that meet the bounds, of the coarsest level that is fine enough; if all that are stored are finer than
    the request, they are shrunk by executors first, so that what is stitched follows the request's size."""
    metas = catalog.meta(name)
    ts = metas[max(metas)].tilesize
    z = pick_zoom(list(metas), bounds, width, ts)
    r = catalog.raster(name, z, bounds)
    r = Raster(r.meta.with_(bounds=bounds, stats=r.meta.stats, quantiles=r.meta.quantiles), r.sources, r.expr, r.strict)
    wanted = max(1, grid.zoom_for_pixel_size((bounds.e - bounds.w) / width, ts))
    while r.meta.zoom > wanted:
        r = coarser(r)
    return r


def _view(r: Raster, bounds: Bounds, width: int, height: int) -> list[np.ndarray]:
    """Nearest cells of each band in a window of the bounds."""
    bands, at = stitch(r)
    h, w = bands[0].shape
    xs = ((bounds.w + (np.arange(width) + 0.5) * (bounds.e - bounds.w) / width) - at.w) / (at.e - at.w) * w
    ys = (at.n - (bounds.n - (np.arange(height) + 0.5) * (bounds.n - bounds.s) / height)) / (at.n - at.s) * h
    return [b[np.clip(ys.astype(int), 0, h - 1)][:, np.clip(xs.astype(int), 0, w - 1)] for b in bands]


def _range(m: RasterMeta) -> tuple[float, float, tuple[float, ...]]:
    """Least and greatest value and quantiles of the first band."""
    low, high = (m.stats[0][0], m.stats[0][1]) if m.stats and m.stats[0] else (0.0, 1.0)
    return low, high, m.quantiles[0] if m.quantiles else ()


def _image(bands: list[np.ndarray], bounds: Bounds, format: str) -> bytes:
    if format == "tif":
        return write_tiff(bands, bounds, float("nan"))
    return write_jpeg(bands) if format in ("jpg", "jpeg") else write_png(bands)


def get_map(catalog: Catalog, name: str, bounds: Bounds, width: int, height: int, scale: ColorScale = GREY, format: str = "png") -> bytes:
    """An image of the bounds, nearest cells; reads the tiles of one level that meet the bounds."""
    metas = catalog.meta(name)
    view = _view(_level(catalog, name, bounds, width), bounds, width, height)[0]
    return _image(_paint(view, scale, *_range(metas[max(metas)])), bounds, format)


def get_mosaic(catalog: Catalog, names: list[str], bounds: Bounds, width: int, height: int, scale: ColorScale = GREY, format: str = "png") -> bytes:
    """One map of several rasters; where they overlap the first that has a value is seen."""
    views, low, high = [], np.inf, -np.inf
    for name in names:
        metas = catalog.meta(name)
        a, b, _ = _range(metas[max(metas)])
        low, high = min(low, a), max(high, b)
        views.append(_view(_level(catalog, name, bounds, width), bounds, width, height)[0])
    out = views[0]
    for v in views[1:]:
        out = np.where(np.isnan(out), v, out)
    return _image(_paint(out, scale, low, high), bounds, format)


def describe_tiles(catalog: Catalog, name: str, zoom: int | None = None, bounds: Bounds | None = None) -> list[tuple[int, Bounds]]:
    """Stored tiles of a level that meet the bounds, with their own bounds."""
    r = catalog.raster(name, zoom, bounds)
    z, ts = r.meta.zoom, r.meta.tilesize
    ids = sorted(x.tile_id for x in r.tiles().select("tile_id").distinct().collect())
    return [(t, grid.tile_bounds(*grid.tile_xy(t, z), z, ts)) for t in ids]


def coverages(catalog: Catalog) -> dict[str, Bounds]:
    """All rasters that a coverage service offers, with their bounds."""
    return {n: m[max(m)].bounds for n in catalog.rasters() for m in [catalog.meta(n)]}


def describe_coverage(catalog: Catalog, name: str) -> dict:
    """Bounds, size of a cell in degrees, type, bands, nodata and formats of a coverage at its finest level."""
    metas = catalog.meta(name)
    m = metas[max(metas)]
    x0, y0, x1, y1 = grid.bounds_to_pixels(m.bounds, m.zoom, m.tilesize)
    return {"bounds": m.bounds, "cell": grid.resolution(m.zoom, m.tilesize), "width": x1 - x0 + 1, "height": y1 - y0 + 1, "type": m.tile_type, "bands": m.bands, "nodata": [m.nodata_of(b) for b in range(m.bands)], "crs": "EPSG:4326", "formats": ["tif", "png", "jpg"]}


def get_coverage(catalog: Catalog, name: str, bounds: Bounds, width: int, height: int, format: str = "tif") -> bytes:
    """The values themselves (as TIFF), or an image of the first bands."""
    view = _view(_level(catalog, name, bounds, width), bounds, width, height)
    if format == "tif":
        return _image(view, bounds, format)
    return _image(view[: 3 if len(view) >= 3 else 1], bounds, format)


def get_tile(catalog: Catalog, name: str, zoom: int, tx: int, ty: int, scale: ColorScale = GREY, mask: str | None = None, mask_max: float = float("inf")) -> bytes | None:
    """One tile as PNG, None if there is none; where a mask's cell is nodata or above mask_max, nothing is drawn."""
    r = catalog.raster(name, zoom)
    tid = grid.tile_id(tx, ty, zoom)
    one = Raster(r.meta, tuple(s.where((F.col("tx") == tx) & (F.col("ty") == ty)) for s in r.sources))
    if mask:
        m = catalog.raster(mask, zoom)
        from ..raster import con

        one = con(Raster(m.meta, tuple(s.where(F.col("tile_id") == tid) for s in m.sources)).binary(mask_max, "le"), one, None)
    row = one.tiles().where("band = 0").first()
    if row is None:
        return None
    a = np.array([np.nan if v is None else v for v in row.cells]).reshape(r.meta.tilesize, -1)
    return write_png(_paint(a, scale, *_range(r.meta)))


def legend(scale: ColorScale, width: int = 16, height: int = 128) -> bytes:
    x = np.repeat(np.linspace(scale.stops[-1][0], scale.stops[0][0], height)[:, None], width, 1)
    flat = ColorScale(scale.stops, "Absolute", scale.interpolate, scale.nodata)
    return write_png(_paint(x, flat, 0.0, 1.0))


class TileReader:
    """Random access to the tiles of a stored level: those read last stay in memory, up to `most` of them."""

    def __init__(self, catalog: Catalog, name: str, zoom: int | None = None, most: int = 64) -> None:
        self.raster, self.most = catalog.raster(name, zoom), most
        self.meta = self.raster.meta
        self._held: OrderedDict[int, list[np.ndarray] | None] = OrderedDict()

    def _bands(self, rows) -> list[np.ndarray] | None:
        out = [np.full((self.meta.tilesize,) * 2, np.nan) for _ in range(self.meta.bands)]
        for r in rows:
            out[r.band] = np.array([np.nan if v is None else v for v in r.cells]).reshape(self.meta.tilesize, -1)
        return out if rows else None

    def get(self, tx: int, ty: int) -> list[np.ndarray] | None:
        """A tile's bands, NaN for nodata; None if it isn't stored. The scan is pruned to the files that may hold it."""
        t = grid.tile_id(tx, ty, self.meta.zoom)
        if t not in self._held:
            self._held[t] = self._bands(self.raster.tiles().where((F.col("tile_id") == t) & (F.col("tx") == tx) & (F.col("ty") == ty)).select("band", "cells").collect())
            if len(self._held) > self.most:
                self._held.popitem(last=False)
        self._held.move_to_end(t)
        return self._held[t]

    def scan(self, first: int, last: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Tiles by id from the first to the last one, a partition at a time."""
        rows = self.raster.tiles().where(F.col("tile_id").between(first, last)).select("tile_id", "band", "cells").orderBy("tile_id", "band").toLocalIterator()
        for t, own in groupby(rows, key=lambda r: r.tile_id):
            yield t, self._bands(list(own))


def kml(name: str, bounds: Bounds, href: str) -> str:
    """A map's image as an overlay of the ground."""
    text = lambda x: escape(str(x))
    box = "".join(f"<{k}>{v}</{k}>" for k, v in (("north", bounds.n), ("south", bounds.s), ("east", bounds.e), ("west", bounds.w)))
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><GroundOverlay><name>{text(name)}</name><Icon><href>{text(href)}</href></Icon><LatLonBox>{box}</LatLonBox></GroundOverlay></Document></kml>'


def describe(catalog: Catalog, name: str) -> dict:
    """Levels with their tile ranges, type, bands and statistics."""
    return {z: {"tiles": grid.bounds_to_tiles(m.bounds, z, m.tilesize), "type": m.tile_type, "bands": m.bands, "stats": m.stats, "bounds": m.bounds} for z, m in catalog.meta(name).items()}
