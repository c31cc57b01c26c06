"""Tiles as numpy arrays: Arrow conversion, dense tiles from cells, and tiles with a rim of their neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import grid
from ..meta import RasterMeta
from ..runtime import ship


def to_arrow(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of cells; NaN becomes NULL."""
    if not rows:
        return pa.array([], pa.list_(pa.float64()))
    flat = np.concatenate([np.asarray(r, float).ravel() for r in rows])
    ends = np.cumsum([0] + [np.size(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=np.isnan(flat)))


def from_arrow(cells) -> np.ndarray:
    """One tile's cells, NULL as NaN."""
    return cells.values.to_numpy(zero_copy_only=False).astype(float)


def dense_tiles(cells: DataFrame, meta: RasterMeta) -> DataFrame:
    """(tile_id, tx, ty, band, cells) from (gx, gy[, band], v); a tile's cells meet once, at most tilesize^2 of them."""
    ship(cells.sparkSession)
    ts, z = meta.tilesize, meta.zoom
    if "band" not in cells.columns:
        cells = cells.withColumn("band", F.lit(0))
    at = (F.pmod("gy", F.lit(ts)) * ts + F.pmod("gx", F.lit(ts))).cast("int")
    some = cells.where("v is not null").select(grid.tile_of_pixel(F.col("gx"), F.col("gy"), z, ts).cast("long").alias("tile_id"), F.col("band").cast("int").alias("band"), at.alias("i"), F.col("v").cast("double").alias("v"))
    lists = some.groupBy("tile_id", "band").agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v"))

    def go(batches):
        for b in batches:
            rows = []
            for i, v in zip(b.column(2), b.column(3)):
                a = np.full(ts * ts, np.nan)
                a[i.values.to_numpy()] = from_arrow(v)
                rows.append(a)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), to_arrow(rows)], ["tile_id", "band", "cells"])

    out = lists.mapInArrow(go, "tile_id long, band int, cells array<double>")
    return out.select("tile_id", grid.tx_column(F.col("tile_id"), z).alias("tx"), grid.ty_column(F.col("tile_id"), z).alias("ty"), "band", "cells")


def each_tile(raster, f: Callable[[np.ndarray], np.ndarray], meta: RasterMeta):
    """f on every tile by itself, without a shuffle."""
    from ..raster import TILES, Raster

    ship(raster.spark)
    ts = raster.meta.tilesize

    def go(batches):
        for b in batches:
            rows = [f(from_arrow(c).reshape(ts, ts)) for c in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], to_arrow(rows)], b.schema.names)

    return Raster(meta, (raster.tiles().select("tile_id", "tx", "ty", "band", "cells").mapInArrow(go, TILES),))


def rimmed(raster, left: int, up: int, right: int, down: int, f: Callable[[np.ndarray], list[np.ndarray]], meta: RasterMeta, bands: int = 1):
    """f on every tile with a rim of cells of its neighbours; it returns `bands` tiles for each.

    A tile sends each neighbour only the cells of its rim, so the shuffle is one copy of the raster and its rims, and
    a task holds one tile. Rims may be wider than a tile. Outside the raster's bounds cells are nodata.
    """
    from ..raster import TILES, Raster

    ship(raster.spark)
    ts, z, range_ = raster.meta.tilesize, raster.meta.zoom, raster.tile_range()
    reach_w, reach_e, reach_n, reach_s = -(-right // ts), -(-left // ts), -(-down // ts), -(-up // ts)
    # a tile lies in the right rims of those to its west, and so on

    def send(batches):
        for b in batches:
            out = []
            for tx, ty, band, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                a = from_arrow(c).reshape(ts, ts)
                for i in range(-reach_w, reach_e + 1):
                    for j in range(-reach_n, reach_s + 1):  # j rows of tiles further south
                        x, y = tx + i, ty - j
                        if not (range_.w <= x <= range_.e and range_.s <= y <= range_.n):
                            continue
                        # this tile's origin as the target's rimmed array sees it
                        ox, oy = left - i * ts, up - j * ts
                        x0, x1 = max(0, -ox), min(ts, ts + left + right - ox)
                        y0, y1 = max(0, -oy), min(ts, ts + up + down - oy)
                        if x0 < x1 and y0 < y1:
                            part = a[y0:y1, x0:x1]
                            if (i, j) == (0, 0) or not np.isnan(part).all():
                                out.append(((y << z) + x, band, ox + x0, oy + y0, x1 - x0, (i, j) == (0, 0), part.tobytes()))
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["tile_id", "band", "x", "y", "w", "own", "part"])

    def receive(key, table):
        if not any(table.column("own").to_pylist()):
            return pa.table({"tile_id": pa.array([], pa.int64()), "tx": pa.array([], pa.int64()), "ty": pa.array([], pa.int64()), "band": pa.array([], pa.int32()), "cells": to_arrow([])})
        a = np.full((ts + up + down, ts + left + right), np.nan)
        for x, y, w, part in zip(*(table.column(k).to_pylist() for k in ("x", "y", "w", "part"))):
            p = np.frombuffer(part).reshape(-1, w)
            a[y : y + len(p), x : x + w] = p
        tid, band = key[0].as_py(), key[1].as_py()
        rows = f(a)
        n = len(rows)
        return pa.table({"tile_id": pa.array([tid] * n, pa.int64()), "tx": pa.array([tid % (1 << z)] * n, pa.int64()), "ty": pa.array([tid >> z] * n, pa.int64()), "band": pa.array([band * n + k for k in range(n)], pa.int32()), "cells": to_arrow(rows)})

    parts = raster.tiles().select("tile_id", "tx", "ty", "band", "cells").mapInArrow(send, "tile_id long, band int, x int, y int, w int, own boolean, part binary")
    return Raster(meta, (parts.groupBy("tile_id", "band").applyInArrow(receive, TILES),))
