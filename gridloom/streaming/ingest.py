"""Incremental mosaics: new tiles or cells of a stream merged into a stored raster, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..meta import RasterMeta
from ..raster import Raster, from_cells
from ..sources.catalog import Catalog


def merge_cells(stream: DataFrame, catalog: Catalog, name: str, meta: RasterMeta, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Mosaic a stream of (gx, gy, v) into the raster `name`: what is stored wins, as in an ingest's overlaps.

    Each batch is written as a raster of its own version, and the pointer of the last version is moved after that, so
    that a batch that is repeated after a failure gives the same raster: of equal cells of one batch the least value
    wins, whatever their order. The version before the last is kept for a repetition, older ones are deleted.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        new = from_cells(df.groupBy("gx", "gy").agg(F.min("v").alias("v")), meta)
        older = [v for v in versions(catalog, name) if v < epoch]
        if older:
            old = catalog.raster(f"{name}@{older[-1]}")
            new = old.mosaic(Raster(old.meta.with_(stats=(), bounds=meta.bounds), new.sources, new.expr, new.strict))
        catalog.save(new, f"{name}@{epoch}")
        for v in older[:-1]:
            catalog.drop(f"{name}@{v}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def versions(catalog: Catalog, name: str) -> list[int]:
    return sorted(int(x.split("@")[1]) for x in catalog.rasters() if x.startswith(f"{name}@"))


def windowed_points(stream: DataFrame, time: str, length: str, late: str, zoom: int, tilesize: int) -> DataFrame:
    """Points (x, y, value and a time) counted and summed by cell and time window, late ones dropped by watermark."""
    from .. import grid

    gx, gy = grid.pixel_columns(F.col("x"), F.col("y"), zoom, tilesize)
    return stream.withWatermark(time, late).groupBy(F.window(time, length), gx.alias("gx"), gy.alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
