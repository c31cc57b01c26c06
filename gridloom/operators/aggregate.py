"""Pyramids and quantiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import grid
from ..functions import aggregators
from ..meta import RasterMeta
from ..raster import TILES, Raster
from ..runtime import scratch, ship
from .tiling import from_arrow, to_arrow


def coarser(r: Raster, rule: str | None = None) -> Raster:
    """One zoom level up. A tile shrinks to a quarter where it is read; parents gather four quarters at most."""
    ship(r.spark)
    rule = (rule or r.meta.resampling).upper()
    if rule not in aggregators.RULES:
        raise ValueError(f"unknown aggregator {rule!r}")
    z, ts = r.meta.zoom, r.meta.tilesize
    half, whole = ts // 2, r.meta.tile_type in ("byte", "short", "ushort", "int")

    def shrink(batches):
        for b in batches:
            tx, ty = np.array(b.column(1).to_pylist(), np.int64), np.array(b.column(2).to_pylist(), np.int64)
            parts = [aggregators.reduce(from_arrow(c).reshape(ts, ts), rule, whole).tobytes() for c in b.column(4)]
            # rows of tiles count upwards: an odd row is the northern half
            yield pa.RecordBatch.from_arrays([pa.array(((ty // 2) << (z - 1)) + tx // 2), b.column(3), pa.array((tx % 2 * half).astype(np.int32)), pa.array(((1 - ty % 2) * half).astype(np.int32)), pa.array(parts, pa.binary())], ["tile_id", "band", "x", "y", "part"])

    def paste(key, table):
        a = np.full((ts, ts), np.nan)
        for x, y, part in zip(*(table.column(k).to_pylist() for k in ("x", "y", "part"))):
            a[y : y + half, x : x + half] = np.frombuffer(part).reshape(half, half)
        t = key[0].as_py()
        return pa.table({"tile_id": pa.array([t], pa.int64()), "tx": pa.array([t % (1 << (z - 1))], pa.int64()), "ty": pa.array([t >> (z - 1)], pa.int64()), "band": pa.array([key[1].as_py()], pa.int32()), "cells": to_arrow([a])})

    parts = r.tiles().select("tile_id", "tx", "ty", "band", "cells").mapInArrow(shrink, "tile_id long, band int, x int, y int, part binary")
    return Raster(r.meta.with_(zoom=z - 1), (parts.groupBy("tile_id", "band").applyInArrow(paste, TILES),))


def build_pyramid(r: Raster, rule: str | None = None, to: int = 1) -> list[Raster]:
    """The raster and all coarser levels down to a zoom; each level is written once and feeds the next."""
    levels = [r]
    while levels[-1].meta.zoom > to:
        up = coarser(levels[-1], rule)
        levels.append(Raster(up.meta, (scratch(up.tiles(), f"level{up.meta.zoom}"),)))
    return levels


def quantiles(r: Raster, n: int, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """(band, k, value): the exact k-th of n quantiles, k = 1 to n - 1: the value at the 0-based place ceil(k / n * count),
    the last at most. fraction: of the cells that are sampled, if under 1.

    Equal values are counted first; the counts are range-partitioned, only sums of partitions reach the driver, and
    places are looked up inside their partitions.
    """
    cells = r.cells().select("band", "v")
    if fraction < 1:
        cells = cells.sample(fraction=fraction, seed=seed)
    parts = int(r.spark.conf.get("spark.sql.shuffle.partitions"))
    counts = cells.groupBy("band", "v").count().repartitionByRange(parts, "band", "v").withColumn("part", F.spark_partition_id())
    counts = scratch(counts, "values")
    sums = sorted(tuple(x) for x in counts.groupBy("band", "part").agg(F.sum("count")).collect())
    total: dict = {}
    for band, _, c in sums:
        total[band] = total.get(band, 0) + c
    wanted, before = [], {}
    for band, part, c in sums:
        a = before.get(band, 0)
        for k in range(1, n):
            at = min(-(-k * total[band] // n), total[band] - 1)
            if a <= at < a + c:
                wanted.append((band, part, k, at - a))
        before[band] = a + c
    schema = "band int, part int, k int, at long"
    from pyspark.sql import Window

    want = r.spark.createDataFrame(wanted, schema)
    run = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("band", "part").orderBy("v")))
    hit = run.join(F.broadcast(want), ["band", "part"]).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("count")))
    return hit.select("band", "k", F.col("v").alias("value"))


def with_quantiles(r: Raster, n: int, fraction: float = 1.0) -> Raster:
    """The raster with its quantiles in its metadata."""
    rows = sorted(tuple(x) for x in quantiles(r, n, fraction).collect())
    q = tuple(tuple(v for b, _, v in rows if b == band) for band in range(r.meta.bands))
    return Raster(r.meta.with_(quantiles=q), r.sources, r.expr, r.strict)


def pyramid_stats(levels: list[Raster]) -> DataFrame:
    """(zoom, band, min, max, sum, count, mean) of all levels."""
    from .local import stats

    out = None
    for r in levels:
        s = stats(r).withColumn("zoom", F.lit(r.meta.zoom))
        out = s if out is None else out.unionByName(s)
    return out


def stored_range(meta: RasterMeta) -> grid.TileBounds:
    return grid.bounds_to_tiles(meta.bounds, meta.zoom, meta.tilesize)
