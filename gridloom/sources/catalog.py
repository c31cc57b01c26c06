"""Rasters and vectors by name under one folder: Parquet tiles partitioned by zoom, and a JSON of metadata beside them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import grid
from ..meta import RasterMeta
from ..raster import TILES, Raster


class Catalog:
    """A raster is saved as a version: its tiles in folders of their own, then one JSON file that names them, which
    appears by a rename. Readers see the last version whole or the one before; that one is kept for those that began
    with it, older ones go."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """A file that is there whole or not at all."""
        own = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(own))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(self._path(own), self._path(path)):
            self._fs.delete(self._path(own), True)
            raise FileExistsError(path)

    def _versions(self, name: str) -> list[int]:
        return [int(x[2:-5]) for x in self._names(f"{self.path}/rasters/{name}") if x.startswith("v=") and x.endswith(".json")]

    def _levels(self, name: str) -> dict[int, tuple[RasterMeta, str]]:
        """Metadata and the tiles' folder by zoom, of the last version."""
        known = self._versions(name)
        if not known:
            raise FileNotFoundError(f"no raster named {name!r}")
        rows = json.loads(self._read(f"{self.path}/rasters/{name}/v={max(known):012}.json"))
        return {m.zoom: (m, r["tiles"]) for r in rows for m in [RasterMeta.from_json(json.dumps(r["meta"]))]}

    def _commit(self, name: str, levels: list[tuple[RasterMeta, str]]) -> None:
        """The next version; what only versions before the last one read is deleted."""
        base = f"{self.path}/rasters/{name}"
        known = self._versions(name)
        self._write(f"{base}/v={max(known, default=0) + 1:012}.json", json.dumps([{"meta": json.loads(m.to_json()), "tiles": t} for m, t in levels], sort_keys=True))
        if len(known) > 1:
            keep = {t for _, t in levels} | {r["tiles"] for r in json.loads(self._read(f"{base}/v={max(known):012}.json"))}
            for v in known:
                if v == max(known):
                    continue
                for r in json.loads(self._read(f"{base}/v={v:012}.json")):
                    if r["tiles"] not in keep:
                        self._fs.delete(self._path(f"{base}/{r['tiles']}"), True)
                self._fs.delete(self._path(f"{base}/v={v:012}.json"), True)

    def _list(self, kind: str) -> list[str]:
        return self._names(f"{self.path}/{kind}")

    def rasters(self) -> list[str]:
        return self._list("rasters")

    def vectors(self) -> list[str]:
        return self._list("vectors")

    def find(self, name: str):
        """A raster of that name, else vectors, else None."""
        return self.raster(name) if name in self.rasters() else self.features(name) if name in self.vectors() else None

    def meta(self, name: str) -> dict[int, RasterMeta]:
        return {z: m for z, (m, _) in self._levels(name).items()}

    def raster(self, name: str, zoom: int | None = None, bounds: grid.Bounds | None = None) -> Raster:
        """The finest level, or another; bounds become ranges of tx and ty, which the scan prunes row groups by."""
        levels = self._levels(name)
        m, tiles = levels[max(levels) if zoom is None else zoom]
        df = self.spark.read.schema(TILES).parquet(f"{self.path}/rasters/{name}/{tiles}")
        if bounds is not None:
            t = grid.bounds_to_tiles(bounds, m.zoom, m.tilesize)
            df = df.where(F.col("tx").between(t.w, t.e) & F.col("ty").between(t.s, t.n))
        return Raster(m, (df,))

    def features(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors/{name}")

    def save(self, x, name: str):
        """A raster (or a list of its levels) or features; what is read back is returned."""
        if isinstance(x, DataFrame):
            x.write.mode("overwrite").parquet(f"{self.path}/vectors/{name}")
            return self.features(name)
        levels = x if isinstance(x, list) else [x]
        version, done = uuid.uuid4().hex[:12], []
        for r in levels:
            tiles = f"tiles/zoom={r.meta.zoom}/{version}"
            at = f"{self.path}/rasters/{name}/{tiles}"
            r.tiles().select("tile_id", "tx", "ty", "band", "cells").repartitionByRange("tile_id").sortWithinPartitions("tile_id", "band").write.option("compression", "zstd").parquet(at)
            stored = Raster(r.meta, (self.spark.read.schema(TILES).parquet(at),))
            done.append((r.meta.with_(stats=self._stats(stored), quantiles=r.meta.quantiles, nodata=r.meta.nodata), tiles))
        self._commit(name, done)
        return self.raster(name)

    @staticmethod
    def _stats(r: Raster) -> tuple:
        from ..operators.local import stats

        rows = {s.band: (s.min, s.max, s["sum"], s["count"], s["mean"]) for s in stats(r).collect()}
        return tuple(rows.get(b, ()) for b in range(r.meta.bands))

    def restate(self, name: str) -> dict[int, tuple]:
        """Compute the statistics of all levels anew and store them."""
        levels = self._levels(name)
        new = [(m.with_(stats=self._stats(self.raster(name, z)), quantiles=m.quantiles, nodata=m.nodata), t) for z, (m, t) in levels.items()]
        self._commit(name, new)
        return {m.zoom: m.stats for m, _ in new}

    def set_quantiles(self, name: str, quantiles: tuple) -> None:
        """Store quantiles by band with all levels."""
        self._commit(name, [(m.with_(stats=m.stats, quantiles=quantiles, nodata=m.nodata), t) for m, t in self._levels(name).values()])

    def tag(self, name: str, **tags: str) -> None:
        """Change tags; None removes one."""
        new = []
        for m, t in self._levels(name).values():
            own = {k: v for k, v in (dict(m.tags) | tags).items() if v is not None}
            new.append((m.with_(stats=m.stats, quantiles=m.quantiles, nodata=m.nodata, tags=tuple(sorted(own.items()))), t))
        self._commit(name, new)

    def drop(self, name: str) -> None:
        """Delete a raster with all its versions."""
        self._fs.delete(self._path(f"{self.path}/rasters/{name}"), True)

    def splits(self, name: str, zoom: int | None = None) -> list[tuple[str, int, int, int]]:
        """(file, first tile, last tile, rows) of a level's files."""
        rows = self.raster(name, zoom).sources[0].groupBy(F.input_file_name().alias("file")).agg(F.min("tile_id").alias("a"), F.max("tile_id").alias("z"), F.count(F.lit(1)).alias("n"))
        return sorted((r.file.rsplit("/", 1)[1], r.a, r.z, r.n) for r in rows.collect())

    def color_scales(self) -> list[str]:
        return [x[:-5] for x in self._names(f"{self.path}/colorscales") if x.endswith(".json")]

    def color_scale(self, name: str):
        from ..functions.colors import ColorScale

        return ColorScale.from_json(self._read(f"{self.path}/colorscales/{name}.json"))

    def add_color_scale(self, name: str, scale) -> None:
        path = f"{self.path}/colorscales/{name}.json"
        self._fs.mkdirs(self._path(f"{self.path}/colorscales"))
        self._fs.delete(self._path(path), True)
        self._write(path, scale.to_json())
