"""Features to rasters: points and painted geometries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import grid
from ..functions.geometry import clip, parse_wkt, to_wkt
from ..grid import Bounds
from ..meta import RasterMeta
from ..raster import Raster, from_cells
from ..runtime import ship

FEATURES = "feature_id long, wkt string, attrs map<string,string>"
AGGREGATES = ("MASK", "MASK2", "SUM", "MIN", "MAX", "AVERAGE", "COUNT")
#: Tiles, and bytes of text, from which on a feature is cut into parts; tiles of a part in each direction.
SPLIT, LONG, PART = 1000, 100_000, 16


def points(spark, lon_lat: list[tuple[float, float]]) -> DataFrame:
    rows = [(k, to_wkt("POINT", [[(float(x), float(y))]]), {}) for k, (x, y) in enumerate(lon_lat)]
    return spark.createDataFrame(rows, FEATURES)


def cell_size(size, tilesize: int) -> int:
    """Zoom of "30m", "12z", "0.1d" or degrees."""
    s = str(size).strip().lower()
    if s.endswith("z"):
        return int(float(s[:-1]))
    degrees = float(s[:-1]) / grid.METERS_PER_DEGREE if s.endswith("m") else float(s.rstrip("d"))
    return grid.zoom_for_pixel_size(degrees, tilesize)


def _aggregate(cells: DataFrame, how: str) -> DataFrame:
    f = {"MASK": F.lit(0.0), "MASK2": F.lit(1.0), "SUM": F.sum("value"), "MIN": F.min("value"), "MAX": F.max("value"), "AVERAGE": F.avg("value"), "COUNT": F.count(F.lit(1)).cast("double")}[how]
    keys = cells.groupBy("gx", "gy")
    return keys.agg((F.max(f) if how.startswith("MASK") else f).alias("v"))


def _rule(how: str, column: str | None) -> str:
    how = how.upper()
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregation {how!r}; known are {', '.join(AGGREGATES)}")
    if how.startswith("MASK") and column:
        raise ValueError("a mask takes no column")
    return how


def _value(column: str | None):
    return F.col("attrs")[column].cast("double") if column else F.lit(1.0)


def rasterize_points(features: DataFrame, how: str, size, column: str | None = None, bounds: Bounds | None = None, tilesize: int = 512) -> Raster:
    """Each point to one cell: arithmetic on coordinates and one grouped aggregate, summed before the shuffle."""
    how, zoom = _rule(how, column), cell_size(size, tilesize)
    number = r"([-+0-9.eE]+)"
    at = r"(?i)POINT\s*Z?\s*\(\s*" + number + r"\s+" + number
    p = features.select(F.regexp_extract("wkt", at, 1).alias("x"), F.regexp_extract("wkt", at, 2).alias("y"), _value(column).alias("value")).where("x != ''")
    p = p.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "value").where("x >= -180 and x < 180 and y >= -90 and y < 90")
    if bounds is not None:
        p = p.where(F.col("x").between(bounds.w, bounds.e) & F.col("y").between(bounds.s, bounds.n))
    if column:
        p = p.where("value is not null")
    gx, gy = grid.pixel_columns(F.col("x"), F.col("y"), zoom, tilesize)
    cells = _aggregate(p.select(gx.alias("gx"), gy.alias("gy"), "value"), how)
    return from_cells(cells, RasterMeta(zoom, tilesize, 1, "byte" if how.startswith("MASK") else "double", (), bounds or Bounds()))


def _paint(kind: str, rings: list, x0: int, y0: int, n: int, zoom: int, ts: int, width: float) -> np.ndarray:
    """Cells of the n x n block from (x0, y0) that the geometry covers: of polygons those whose centres are inside by
    the even-odd rule; of lines those within half the width of one, at least those that it passes."""
    r = grid.resolution(zoom, ts)
    high = grid.tiles_high(zoom) * ts
    px = [np.array([((x + 180) / r - x0, high - (y + 90) / r - y0) for x, y in ring]) for ring in rings]
    out = np.zeros((n, n), bool)
    if "POLYGON" in kind:
        cy = np.arange(n) + 0.5
        for row in range(n):
            xs = []
            for p in px:
                a, b = p, np.roll(p, -1, 0)
                hit = (a[:, 1] > cy[row]) != (b[:, 1] > cy[row])
                a, b = a[hit], b[hit]
                xs += ((b[:, 0] - a[:, 0]) * (cy[row] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).tolist()
            xs.sort()
            for s, e in zip(xs[::2], xs[1::2]):
                i, j = max(0, math.ceil(s - 0.5)), min(n, math.ceil(e - 0.5))
                if i < j:
                    out[row, i:j] ^= True
        return out
    half = width / r / 2 if width else 0.0
    for p in px:
        if len(p) == 1:
            i, j = int(math.floor(p[0, 0])), int(math.floor(p[0, 1]))
            if half == 0:
                if 0 <= i < n and 0 <= j < n:
                    out[j, i] = True
                continue
        for a, b in zip(p[:-1] if len(p) > 1 else p, p[1:] if len(p) > 1 else p):
            if half == 0:
                # between two crossings of the grid a segment is in one cell
                d, t = b - a, [np.array([0.0, 1.0])]
                for k in (0, 1):
                    if d[k]:
                        lines = np.arange(max(0, math.ceil(min(a[k], b[k]))), min(n, math.floor(max(a[k], b[k]))) + 1)
                        t.append((lines - a[k]) / d[k])
                t = np.sort(np.concatenate(t))
                # a corner that is just touched is no cell passed
                far = np.diff(t) * np.abs(d).max() > 1e-6
                mid = ((t[:-1] + t[1:]) / 2)[far] if far.any() else t[:1]
                q = np.floor(a + d * mid[:, None]).astype(int)
                q = q[((q >= 0) & (q < n)).all(1)]
                out[q[:, 1], q[:, 0]] = True
                continue
            y, x = np.mgrid[0:n, 0:n] + 0.5
            d = b - a
            length = float(d @ d)
            t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / length, 0, 1) if length else np.zeros_like(x)
            out |= (x - a[0] - t * d[0]) ** 2 + (y - a[1] - t * d[1]) ** 2 <= half * half
    return out


def _whole_wkt(kind: str, rings: list) -> str:
    """Rings of several polygons are painted by the even-odd rule, so one polygon may hold them all."""
    return to_wkt("POLYGON" if kind == "MULTIPOLYGON" else "MULTIPOINT" if kind == "POINT" else kind, rings if kind not in ("POINT", "MULTIPOINT") else [[p for r in rings for p in r]])


def paint_gaussian(features: DataFrame, sigma: float, size, column: str | None = None, tilesize: int = 512, reach: float = 3.0) -> Raster:
    """Points painted as Gaussians of `sigma` degrees, added up: a point's weight falls with its distance from a cell's
    centre, up to `reach` sigmas. The sums are made before the shuffle."""
    zoom = cell_size(size, tilesize)
    r, high = grid.resolution(zoom, tilesize), grid.tiles_high(zoom) * tilesize
    number = r"([-+0-9.eE]+)"
    at = r"(?i)POINT\s*Z?\s*\(\s*" + number + r"\s+" + number
    p = features.select(F.regexp_extract("wkt", at, 1).alias("x"), F.regexp_extract("wkt", at, 2).alias("y"), _value(column).alias("value")).where("x != '' and value is not null")
    p = p.select(((F.col("x").cast("double") + 180) / r).alias("x"), (high - (F.col("y").cast("double") + 90) / r).alias("y"), "value")
    s, n = sigma / r, math.ceil(reach * sigma / r)
    near = lambda c: F.sequence(F.floor(c).cast("long") - n, F.floor(c).cast("long") + n)
    cells = p.withColumn("gx", F.explode(near(F.col("x")))).withColumn("gy", F.explode(near(F.col("y")))).where(f"gx >= 0 and gx < {grid.tiles_wide(zoom) * tilesize} and gy >= 0 and gy < {high}")
    far = F.pow(F.col("gx") + 0.5 - F.col("x"), 2) + F.pow(F.col("gy") + 0.5 - F.col("y"), 2)
    cells = cells.where(far <= (reach * s) ** 2).groupBy("gx", "gy").agg(F.sum(F.col("value") * F.exp(-far / (2 * s * s))).alias("v"))
    return from_cells(cells, RasterMeta(zoom, tilesize, 1, "double", (), Bounds()))


def rasterize_vector(features: DataFrame, how: str, size, column: str | None = None, width: str | None = None, bounds: Bounds | None = None, tilesize: int = 512) -> Raster:
    """Features painted into tiles: overlapping tiles are found from bounding boxes as rows, so that a feature that
    covers many tiles is painted by many tasks, tile by tile; cells are then aggregated."""
    spark = features.sparkSession
    ship(spark)
    how, zoom, ts = _rule(how, column), cell_size(size, tilesize), tilesize
    wide = 0.0
    if width:
        w = str(width).lower()
        wide = float(w[:-1]) * {"m": 1 / grid.METERS_PER_DEGREE, "p": grid.resolution(zoom, ts), "d": 1.0}[w[-1]]
    limit = bounds or Bounds()

    def boxes(batches):
        for b in batches:
            rows = []
            for wkt in b.column(0).to_pylist():
                try:
                    pts = [p for ring in parse_wkt(wkt)[1] for p in ring] if wkt else []
                except ValueError:
                    pts = []
                box = None
                if pts:
                    box = Bounds(min(p[0] for p in pts) - wide / 2, min(p[1] for p in pts) - wide / 2, max(p[0] for p in pts) + wide / 2, max(p[1] for p in pts) + wide / 2).intersect(limit)
                t = grid.bounds_to_tiles(box, zoom, ts) if box else None
                rows.append((t.w, t.s, t.e, t.n) if t else None)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(r) if r else None for r in rows], kind)], [*b.schema.names, "box"])

    f = features.select("wkt", _value(column).alias("value"))
    if column:
        f = f.where("value is not null")
    f = f.mapInArrow(boxes, "wkt string, value double, box array<bigint>").where("box is not null")

    def parts(batches):
        """Large features cut by blocks of PART x PART tiles and a rim as wide as their lines, so that a tile's row
        carries the part around it and not the whole."""
        d = ts * grid.resolution(zoom, ts)
        rim = wide + 2 * grid.resolution(zoom, ts)
        for b in batches:
            out: list = [[], [], []]
            for wkt, v, (w, s, e, n) in zip(*(c.to_pylist() for c in b.columns)):
                kind, rings = parse_wkt(wkt)
                for y in range(s, n + 1, PART):
                    for x in range(w, e + 1, PART):
                        z, u = min(e, x + PART - 1), min(n, y + PART - 1)
                        own = clip(kind, rings, Bounds(x * d - 180 - rim, y * d - 90 - rim, (z + 1) * d - 180 + rim, (u + 1) * d - 90 + rim))
                        if own[1]:
                            for column, item in zip(out, (_whole_wkt(*own), v, [x, y, z, u])):
                                column.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], b.schema.names)

    large = (F.expr("(box[2] - box[0] + 1) * (box[3] - box[1] + 1)") > SPLIT) | (F.length("wkt") > LONG)
    f = f.where(~large).unionByName(f.where(large).mapInArrow(parts, "wkt string, value double, box array<bigint>"))
    t = f.select("wkt", "value", F.explode(F.sequence(F.col("box")[1], F.col("box")[3])).alias("ty"), "box").select("wkt", "value", "ty", F.explode(F.sequence(F.col("box")[0], F.col("box")[2])).alias("tx"))
    high = grid.tiles_high(zoom)

    def paint(batches):
        for b in batches:
            gx, gy, value = [], [], []
            for wkt, v, ty, tx in zip(*(c.to_pylist() for c in b.columns)):
                kind, rings = parse_wkt(wkt)
                x0, y0 = tx * ts, (high - 1 - ty) * ts
                y, x = np.nonzero(_paint(kind, rings, x0, y0, ts, zoom, ts, wide))
                gx.append(x + x0)
                gy.append(y + y0)
                value.append(np.full(len(x), v))
                if sum(map(len, gx)) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (gx, gy, value)], ["gx", "gy", "value"])
                    gx, gy, value = [], [], []
            if gx:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (gx, gy, value)], ["gx", "gy", "value"])

    # dealt out anew: one large feature's tiles would else be painted where it was read
    cells = t.repartition(F.col("tx"), F.col("ty"), F.xxhash64("wkt") % 8).mapInArrow(paint, "gx long, gy long, value double")
    if bounds is not None:
        x0, y0, x1, y1 = grid.bounds_to_pixels(bounds, zoom, ts)
        cells = cells.where(F.col("gx").between(x0, x1) & F.col("gy").between(y0, y1))
    return from_cells(_aggregate(cells, how), RasterMeta(zoom, ts, 1, "byte" if how.startswith("MASK") else "double", (), bounds or Bounds()))
