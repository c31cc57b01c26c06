"""Rasters: tiles of cells, and the lazy expressions over them.

A raster is some frames of tiles and one expression of their cells. Frames have a row for each tile and band:
(tile_id, tx, ty, band, cells), cells row by row from the north-west, NULL for nodata. Cell-wise operators only grow
the expression, so that a whole formula is one join of tiles (never of pixels) and one projection. Tiles that must be
there join inner, others left; if none must, the frames are united and grouped, in a single shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grid
from .functions import expressions as X
from .meta import RasterMeta, widest

TILES = "tile_id long, tx long, ty long, band int, cells array<double>"


@dataclass(frozen=True)
class Here:
    """Where a cell is."""

    gx: Column
    gy: Column


Expr = Callable[[list[Column], Here], Column]


class Raster:
    def __init__(self, meta: RasterMeta, sources: tuple[DataFrame, ...], expr: Expr | None = None, strict: frozenset[int] | None = None) -> None:
        self.meta, self.sources, self.expr = meta, tuple(sources), expr
        self.strict = frozenset(range(len(self.sources))) if strict is None else strict

    # --- frames

    @property
    def spark(self) -> SparkSession:
        return self.sources[0].sparkSession

    @property
    def _size(self) -> int:
        return self.meta.tilesize**2

    def _located(self, df: DataFrame) -> DataFrame:
        z = self.meta.zoom
        return df.withColumn("tx", grid.tx_column(F.col("tile_id"), z)).withColumn("ty", grid.ty_column(F.col("tile_id"), z))

    def _joined(self) -> DataFrame:
        """(tile_id, tx, ty, band, c0, c1, ...)"""
        names = [f"c{k}" for k in range(len(self.sources))]
        frames = [s.select("tile_id", "band", F.col("cells").alias(n)) for s, n in zip(self.sources, names, strict=True)]
        if len(frames) == 1:
            out = frames[0]
        elif self.strict:
            order = sorted(range(len(frames)), key=lambda k: (k not in self.strict, k))
            out = frames[order[0]]
            for k in order[1:]:
                out = out.join(frames[k], ["tile_id", "band"], "inner" if k in self.strict else "left")
        else:
            every = None
            for k, f in enumerate(frames):
                f = f.select("tile_id", "band", F.lit(k).alias("k"), F.col(names[k]).alias("c"))
                every = f if every is None else every.unionByName(f)
            out = every.groupBy("tile_id", "band").agg(*(F.any_value(F.when(F.col("k") == k, F.col("c")), F.lit(True)).alias(n) for k, n in enumerate(names)))
        absent = F.array_repeat(F.lit(None).cast("double"), self._size)
        keep = [F.col(n) if k in self.strict or len(frames) == 1 else F.coalesce(n, absent).alias(n) for k, n in enumerate(names)]
        return self._located(out.select("tile_id", "band", *keep))

    def tiles(self) -> DataFrame:
        """(tile_id, tx, ty, band, cells)"""
        if self.expr is None:
            return self.sources[0]
        ts, high = self.meta.tilesize, grid.tiles_high(self.meta.zoom)
        names = [f"c{k}" for k in range(len(self.sources))]

        def cell(z: Column, i: Column) -> Column:
            here = Here(F.col("tx") * ts + i % ts, (F.lit(high - 1) - F.col("ty")) * ts + F.floor(i / ts))
            return self.expr([z.getField(n) for n in names], here)

        return self._joined().select("tile_id", "tx", "ty", "band", F.transform(F.arrays_zip(*names), cell).alias("cells"))

    def cells(self, nodata: bool = False) -> DataFrame:
        """(tile_id, band, px, py, gx, gy, v), with rows of nodata only if asked for; one codegen'd stage after the join."""
        ts, high = self.meta.tilesize, grid.tiles_high(self.meta.zoom)
        names = [f"c{k}" for k in range(len(self.sources))]
        z = self._joined().select("tile_id", "tx", "ty", "band", F.posexplode(F.arrays_zip(*names)).alias("i", "z"))
        z = z.select("tile_id", "band", (F.col("i") % ts).alias("px"), F.floor(F.col("i") / ts).cast("int").alias("py"), "tx", "ty", "z")
        z = z.withColumn("gx", F.col("tx") * ts + F.col("px")).withColumn("gy", (F.lit(high - 1) - F.col("ty")) * ts + F.col("py"))
        values = [F.col("z").getField(n) for n in names]
        v = values[0] if self.expr is None else self.expr(values, Here(F.col("gx"), F.col("gy")))
        out = z.select("tile_id", "band", "px", "py", "gx", "gy", v.alias("v"))
        return out if nodata else out.where("v is not null")

    def solid(self) -> Raster:
        """The same with its expression worked out into one frame."""
        return self if self.expr is None else Raster(self.meta, (self.tiles(),))

    def tile_range(self) -> grid.TileBounds:
        return grid.bounds_to_tiles(self.meta.bounds, self.meta.zoom, self.meta.tilesize)

    def grid_frame(self, bounds: grid.Bounds | None = None) -> DataFrame:
        """All tiles and bands of the bounds, without cells."""
        b = grid.bounds_to_tiles(bounds or self.meta.bounds, self.meta.zoom, self.meta.tilesize)
        wide = b.e - b.w + 1
        out = self.spark.range(b.count * self.meta.bands)
        at = F.floor(F.col("id") / self.meta.bands)
        out = out.select((F.floor(at / wide) + b.s).alias("ty"), (at % wide + b.w).alias("tx"), (F.col("id") % self.meta.bands).cast("int").alias("band"))
        return out.select((F.shiftleft("ty", self.meta.zoom) + F.col("tx")).alias("tile_id"), "tx", "ty", "band", F.array_repeat(F.lit(None).cast("double"), self._size).alias("cells"))

    # --- composition

    def merged(self, others: list[Raster]) -> tuple[tuple[DataFrame, ...], list[Callable[[list[Column], Here], Column]], list[frozenset[int]]]:
        """Sources of all, each once; for each raster its expression over them, and which of them it needs."""
        sources: list[DataFrame] = []
        exprs, strict = [], []
        for r in [self, *others]:
            if (r.meta.zoom, r.meta.tilesize) != (self.meta.zoom, self.meta.tilesize):
                raise ValueError(f"rasters of zoom {self.meta.zoom} and {r.meta.zoom} don't fit")
            at = []
            for s in r.sources:
                k = next((i for i, x in enumerate(sources) if x is s), None)
                if k is None:
                    k = len(sources)
                    sources.append(s)
                at.append(k)
            own = r.expr
            exprs.append((lambda v, h, at=at: v[at[0]]) if own is None else (lambda v, h, at=at, own=own: own([v[k] for k in at], h)))
            strict.append(frozenset(at[k] for k in r.strict))
        return tuple(sources), exprs, strict

    def map(self, f: Callable[[Column], Column], kind: str | None = None, **meta) -> Raster:
        own = self.expr or (lambda v, h: v[0])
        how = meta | ({"tile_type": kind} if kind else {})
        return Raster(self.meta.with_(**how), self.sources, lambda v, h: f(own(v, h)), self.strict)

    def binary(self, other, name: str) -> Raster:
        f, kind = X.binary(name)
        if not isinstance(other, Raster):
            c = X.lit(other)
            return self.map(lambda v: f(v, c), kind)
        sources, (a, b), strict = self.merged([other])
        meta = self.meta.with_(tile_type=kind, bounds=self.meta.bounds.expand(other.meta.bounds))
        return Raster(meta, sources, lambda v, h: f(a(v, h), b(v, h)), strict[0] | strict[1])

    def unary(self, name: str) -> Raster:
        f, kind = X.unary(name)
        return self.map(f, kind)

    def __add__(self, o): return self.binary(o, "add")
    def __radd__(self, o): return self.binary(o, "add")
    def __sub__(self, o): return self.binary(o, "minus")
    def __rsub__(self, o): return self.binary(o, "rminus")
    def __mul__(self, o): return self.binary(o, "mult")
    def __rmul__(self, o): return self.binary(o, "mult")
    def __truediv__(self, o): return self.binary(o, "div")
    def __rtruediv__(self, o): return self.binary(o, "rdiv")
    def __pow__(self, o): return self.binary(o, "pow")
    def __rpow__(self, o): return self.binary(o, "rpow")
    def __and__(self, o): return self.binary(o, "bitand")
    def __or__(self, o): return self.binary(o, "bitor")
    def __xor__(self, o): return self.binary(o, "bitxor")
    def __lt__(self, o): return self.binary(o, "lt")
    def __le__(self, o): return self.binary(o, "le")
    def __gt__(self, o): return self.binary(o, "gt")
    def __ge__(self, o): return self.binary(o, "ge")
    def __eq__(self, o): return self.binary(o, "eq")  # type: ignore[override]
    def __ne__(self, o): return self.binary(o, "ne")  # type: ignore[override]
    def __neg__(self): return self.unary("uminus")
    def __abs__(self): return self.unary("abs")
    def __invert__(self): return self.unary("bitnot")
    __hash__ = object.__hash__

    def __getattr__(self, name: str):
        """Every registered operator is a method of its first raster argument."""
        if name.startswith("_"):
            raise AttributeError(name)
        from .plans.registry import lookup

        op = lookup(name)
        if op is None:
            raise AttributeError(name)
        return lambda *a, **k: op(self, *a, **k)


def from_cells(cells: DataFrame, meta: RasterMeta) -> Raster:
    """A raster from (gx, gy[, band], v): one row a cell; cells without a row are nodata."""
    from .operators.tiling import dense_tiles

    return Raster(meta, (dense_tiles(cells, meta),))


def con(*args) -> Raster:
    """con(test, value, [test, value, ...], otherwise): the value of the first test that is not zero.

    A test of nodata gives nodata. Values and tests are rasters or numbers; NaN and None mean nodata.
    """
    if len(args) < 3 or len(args) % 2 == 0:
        raise ValueError("con takes an odd number of arguments, three or more")
    rasters = [a for a in args if isinstance(a, Raster)]
    if not rasters:
        raise ValueError("con needs a raster")
    first = rasters[0]
    sources, exprs, strict = first.merged(rasters[1:])
    it = iter(exprs)
    cells = [next(it) if isinstance(a, Raster) else (lambda v, h, c=a: X.lit(c)) for a in args]

    def expr(v, h):
        out = cells[-1](v, h)
        for k in range(len(args) - 3, -1, -2):
            test = cells[k](v, h)
            out = F.when(test.isNull(), F.lit(None).cast("double")).when(X.true(test), cells[k + 1](v, h)).otherwise(out)
        return out

    results = [a for k, a in enumerate(args) if (k % 2 == 1 or k == len(args) - 1) and isinstance(a, Raster)]
    kind = widest(*(r.meta.tile_type for r in results)) if results else "float"
    bounds = first.meta.bounds
    for r in rasters[1:]:
        bounds = bounds.expand(r.meta.bounds)
    need = strict[0] if isinstance(args[0], Raster) else frozenset()
    return Raster(first.meta.with_(tile_type=kind, bounds=bounds), sources, expr, need)
