"""Cost distance and least-cost paths over rasters of any size, tile by tile.

A round lets every tile that gets new edges from its neighbours run Dijkstra's algorithm inside itself and send its own
edges on where they have become cheaper. Rounds end when no edge improves. A task holds one tile and its rim. Frictions
are written once; a round writes the costs of the tiles that it has touched as a layer over those before, and only the
number of changed tiles reaches the driver.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import grid
from ..grid import Bounds
from ..raster import TILES, Raster
from ..runtime import drop_scratch, scratch, ship
from .local import crop
from .tiling import from_arrow, rimmed, to_arrow

#: (rows down, columns right) and band of a directional friction.
STEPS = [(-1, 0, 0), (-1, 1, 1), (0, 1, 2), (1, 1, 3), (1, 0, 4), (1, -1, 5), (0, -1, 6), (-1, -1, 7)]
GAIN = 1e-7
#: Layers of costs that are folded into one.
LAYERS = 8
#: Changed tiles up to which the ids of their neighbours are broadcast: eight each, 64 MB of a hash table at most.
FEW = 100_000
_COST = "tile_id long, round int, cost binary, changed boolean"


def _spread(friction: np.ndarray, cost: np.ndarray, start: list, size: float, most: float) -> np.ndarray:
    """Dijkstra inside one array with its rim; start: (cost, row, column). Both arrays have NaN for nodata."""
    multi = len(friction) == 8
    high, wide = cost.shape
    dist = [size * (2**0.5 if y and x else 1.0) for y, x, _ in STEPS]
    f = friction.tolist()
    best = np.where(np.isnan(cost), np.inf, cost).tolist()
    heap = list(start)
    heapify(heap)
    while heap:
        c, y, x = heappop(heap)
        if c > best[y][x]:
            continue
        for (dy, dx, band), d in zip(STEPS, dist):
            v, u = y + dy, x + dx
            if not (0 <= v < high and 0 <= u < wide):
                continue
            w = f[band][y][x] if multi else (f[0][y][x] + f[0][v][u]) * 0.5
            if w != w:
                continue
            n = c + w * d
            if n < best[v][u] - GAIN and (most <= 0 or n <= most + 1e-8):
                best[v][u] = n
                heappush(heap, (n, v, u))
    out = np.array(best)
    return np.where(np.isinf(out), np.nan, out)


def cost_distance(points: DataFrame, friction: Raster, most: float = -1.0, bounds: Bounds | None = None) -> Raster:
    """Least cost from any of the points (features of WKT points) to every cell; friction in seconds a metre.

    One band: an edge costs the mean of its cells' frictions times its length. Eight bands: the friction of the cell
    that is left, by direction. Cells that can't be reached, or only at more than `most` (if positive), are nodata.
    """
    spark = friction.spark
    ship(spark)
    r = crop(friction, bounds) if bounds is not None else friction
    z, ts, nb = r.meta.zoom, r.meta.tilesize, r.meta.bands
    if nb not in (1, 8):
        raise ValueError("friction has one band or eight")
    size = grid.meters(z, ts)
    number = r"([-+0-9.eE]+)"
    at = r"(?i)POINT\s*Z?\s*\(\s*" + number + r"\s+" + number
    p = points.select(F.regexp_extract("wkt", at, 1).cast("double").alias("x"), F.regexp_extract("wkt", at, 2).cast("double").alias("y"))
    gx, gy = grid.pixel_columns(F.col("x"), F.col("y"), z, ts)
    seeds = p.select(gx.alias("gx"), gy.alias("gy")).distinct()
    seeds = seeds.select(grid.tile_of_pixel(F.col("gx"), F.col("gy"), z, ts).cast("long").alias("tile_id"), (F.col("gy") % ts * ts + F.col("gx") % ts).cast("int").alias("i"))
    seeds = seeds.groupBy("tile_id").agg(F.collect_set("i").alias("seeds"))

    def begin(key, table):
        f = np.full((nb, ts, ts), np.nan)
        for band, c in zip(table.column("band").to_pylist(), table.column("cells")):
            f[band] = from_arrow(c).reshape(ts, ts)
        cost = np.full((ts, ts), np.nan)
        seeds = table.column("seeds")[0].as_py()
        start = []
        for i in seeds or []:
            y, x = divmod(i, ts)
            if nb == 8 or not np.isnan(f[0, y, x]):
                cost[y, x] = 0.0
                start.append((0.0, y, x))
        if start:
            cost = _spread(f, cost, start, size, most)
        return pa.table({"tile_id": pa.array([key[0].as_py()], pa.int64()), "friction": pa.array([f.tobytes()], pa.binary()), "cost": pa.array([cost.tobytes()], pa.binary()), "changed": pa.array([bool(start)])})

    begun = r.tiles().select("tile_id", "band", "cells").join(seeds, "tile_id", "left").groupBy("tile_id").applyInArrow(begin, "tile_id long, friction binary, cost binary, changed boolean")
    begun = scratch(begun, "friction")
    frictions = begun.select("tile_id", "friction")
    range_ = r.tile_range()

    def edges(batches):
        for b in batches:
            out = []
            for tid, f, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                f, c = np.frombuffer(f).reshape(nb, ts, ts), np.frombuffer(c).reshape(ts, ts)
                tx, ty = tid % (1 << z), tid >> z
                for dy, dx, _ in STEPS:
                    x, y = tx + dx, ty - dy
                    if not (range_.w <= x <= range_.e and range_.s <= y <= range_.n):
                        continue
                    rows = slice(ts - 1, ts) if dy > 0 else slice(0, 1) if dy < 0 else slice(0, ts)
                    cols = slice(ts - 1, ts) if dx > 0 else slice(0, 1) if dx < 0 else slice(0, ts)
                    part = c[rows, cols]
                    if not np.isnan(part).all():
                        out.append(((y << z) + x, 0 if dx > 0 else ts + 1 if dx < 0 else 1, 0 if dy > 0 else ts + 1 if dy < 0 else 1, part.shape[1], np.ascontiguousarray(part).tobytes(), np.ascontiguousarray(f[:, rows, cols]).tobytes()))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(cols, kinds)], ["tile_id", "x", "y", "w", "part", "frictions"])

    def relax(number):
        def go(key, own, sent):
            if own.num_rows == 0:
                return pa.table({"tile_id": pa.array([], pa.int64()), "round": pa.array([], pa.int32()), "cost": pa.array([], pa.binary()), "changed": pa.array([], pa.bool_())})
            f = np.full((nb, ts + 2, ts + 2), np.nan)
            c = np.full((ts + 2, ts + 2), np.nan)
            f[:, 1:-1, 1:-1] = np.frombuffer(own.column("friction")[0].as_py()).reshape(nb, ts, ts)
            before = np.frombuffer(own.column("cost")[0].as_py()).reshape(ts, ts)
            c[1:-1, 1:-1] = before
            start = []
            for x, y, w, part, g in zip(*(sent.column(k).to_pylist() for k in ("x", "y", "w", "part", "frictions"))):
                q = np.frombuffer(part).reshape(-1, w)
                h = len(q)
                c[y : y + h, x : x + w] = q
                f[:, y : y + h, x : x + w] = np.frombuffer(g).reshape(nb, h, w)
                start += [(float(q[j, i]), y + j, x + i) for j in range(h) for i in range(w) if not np.isnan(q[j, i])]
            after = _spread(f, c, start, size, most)[1:-1, 1:-1] if start else before
            a, b = np.nan_to_num(after, nan=np.inf), np.nan_to_num(before, nan=np.inf)
            rim = np.ones((ts, ts), bool)
            rim[1:-1, 1:-1] = False
            with np.errstate(invalid="ignore"):
                changed = bool(((a < b - GAIN) & rim).any())
            return pa.table({"tile_id": own.column("tile_id"), "round": pa.array([number], pa.int32()), "cost": pa.array([np.ascontiguousarray(after).tobytes()], pa.binary()), "changed": pa.array([changed])})

        return go

    layers = [begun.select("tile_id", F.lit(0).alias("round"), "cost", "changed")]

    def latest(of: DataFrame | None = None) -> DataFrame:
        """The newest cost of every tile, or of those wanted."""
        every = layers[0]
        for x in layers[1:]:
            every = every.unionByName(x)
        if of is not None:
            every = every.join(of, "tile_id", "left_semi")
        if len(layers) == 1:
            return every
        return every.groupBy("tile_id").agg(F.max_by(F.struct("cost", "changed"), "round").alias("s"), F.max("round").alias("round")).select("tile_id", "round", "s.cost", "s.changed")

    number = 0
    while (moved := layers[-1].where("changed").count()) > 0:
        number += 1
        messages = layers[-1].where("changed").select("tile_id", "cost").join(frictions, "tile_id").select("tile_id", "friction", "cost")
        messages = messages.mapInArrow(edges, "tile_id long, x int, y int, w int, part binary, frictions binary")
        reached = messages.select("tile_id").distinct()
        if moved <= FEW:
            reached = F.broadcast(reached)  # a tile has eight neighbours at most
        own = latest(reached).select("tile_id", "cost").join(frictions, "tile_id")
        layer = scratch(own.groupBy("tile_id").cogroup(messages.groupBy("tile_id")).applyInArrow(relax(number), _COST), "cost")
        layers.append(layer)
        if len(layers) > LAYERS:
            # the last layer stays by itself, as it says what has changed
            last = layers.pop()
            folded = scratch(latest(), "costs")
            for x in layers[1:]:
                drop_scratch(x)
            layers = [folded, last]

    def finish(batches):
        for b in batches:
            tid = np.array(b.column(0).to_pylist(), np.int64)
            rows = [np.frombuffer(c).astype(np.float32).astype(float) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(tid % (1 << z)), pa.array(tid >> z), pa.array(np.zeros(len(tid), np.int32)), to_arrow(rows)], ["tile_id", "tx", "ty", "band", "cells"])

    return Raster(r.meta.with_(bands=1, tile_type="float"), (latest().select("tile_id", "cost").mapInArrow(finish, TILES),))


_PATH = "feature_id long, step int, gx long, gy long, cost double, open boolean"


def least_cost_path(cost: Raster, points: DataFrame) -> DataFrame:
    """From every point down the steepest of eight neighbours until none is lower: features of lines.

    Attributes COST_S, DISTANCE_M, MINSPEED_MPS, MAXSPEED_MPS and AVGSPEED_MPS have three decimals at most. Points
    walk through a tile in one step of the loop; all points walk at once.
    """
    spark = cost.spark
    ship(spark)
    z, ts = cost.meta.zoom, cost.meta.tilesize
    high = grid.tiles_high(z)
    look = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]

    def ways(a):
        c = a[1:-1, 1:-1]
        n = np.stack([a[1 + y : a.shape[0] - 1 + y, 1 + x : a.shape[1] - 1 + x] for y, x in look])
        n = np.where(np.isnan(n), np.inf, n)
        k = n.argmin(0)
        return [c, np.where(np.isnan(c) | ~(n.min(0) < c), -1.0, k)]

    two = rimmed(cost, 1, 1, 1, 1, ways, cost.meta, 2).tiles()
    tiles = scratch(two.groupBy("tile_id").agg(F.max(F.when(F.col("band") == 0, F.col("cells"))).alias("cost"), F.max(F.when(F.col("band") == 1, F.col("cells"))).alias("way")), "ways")

    def walk(key, tile, at):
        out: dict = {k: [] for k in ("feature_id", "step", "gx", "gy", "cost", "open")}
        if tile.num_rows:
            c, w = (from_arrow(tile.column(k)[0]).reshape(ts, ts) for k in ("cost", "way"))
            for fid, step, gx, gy in zip(*(at.column(k).to_pylist() for k in ("feature_id", "step", "gx", "gy"))):
                tx, ty = gx // ts, gy // ts
                while True:
                    v = c[gy % ts, gx % ts]
                    k = int(w[gy % ts, gx % ts]) if not np.isnan(v) else -1
                    for name, x in zip(out, (fid, step, gx, gy, float(v), False)):
                        out[name].append(x)
                    if k < 0:
                        break
                    gy, gx, step = gy + look[k][0], gx + look[k][1], step + 1
                    if (gx // ts, gy // ts) != (tx, ty):
                        for name, x in zip(out, (fid, step, gx, gy, None, True)):
                            out[name].append(x)
                        break
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    number = r"([-+0-9.eE]+)"
    expr = r"(?i)POINT\s*Z?\s*\(\s*" + number + r"\s+" + number
    gx, gy = grid.pixel_columns(F.regexp_extract("wkt", expr, 1).cast("double"), F.regexp_extract("wkt", expr, 2).cast("double"), z, ts)
    now = points.select("feature_id", F.lit(0).alias("step"), gx.cast("long").alias("gx"), gy.cast("long").alias("gy"))
    rows = None
    while True:
        placed = now.withColumn("tile_id", grid.tile_of_pixel(F.col("gx"), F.col("gy"), z, ts).cast("long"))
        # only tiles that hold a walker are read, and each once
        here = tiles.join(placed.select("tile_id").distinct(), "tile_id", "left_semi")
        got = scratch(here.groupBy("tile_id").cogroup(placed.groupBy("tile_id")).applyInArrow(walk, _PATH), "walk")
        done = got.where("not open")
        rows = done if rows is None else rows.unionByName(done)
        now = got.where("open").select("feature_id", "step", "gx", "gy")
        if not now.limit(1).count():
            break
    from pyspark.sql import Window

    size = float(np.float32(grid.meters(z, ts)))
    w = Window.partitionBy("feature_id").orderBy("step")
    r = grid.resolution(z, ts)
    steps = rows.where("not isnan(cost)").withColumn("px", F.lag("gx").over(w)).withColumn("py", F.lag("gy").over(w)).withColumn("pc", F.lag("cost").over(w))
    d = F.when((F.col("gx") != F.col("px")) & (F.col("gy") != F.col("py")), size * 2**0.5).when(F.col("px").isNotNull(), F.lit(size))
    steps = steps.withColumn("d", d).withColumn("speed", F.col("d") / (F.col("pc") - F.col("cost"))).withColumn("pt", F.concat((F.col("gx") * r - 180.0).cast("string"), F.lit(" "), (90.0 - F.col("gy") * r).cast("string")))
    got = steps.groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("step", "pt"))).alias("pts"), F.max("cost").alias("c"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"), F.coalesce(F.min("speed"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("speed"), F.lit(0.0)).alias("hi"))
    three = lambda c: F.regexp_replace(F.regexp_replace(F.round(c, 3).cast("decimal(38,3)").cast("string"), r"0+$", ""), r"\.$", "")
    single = F.size("pts") == 1
    attrs = F.create_map(
        F.lit("COST_S"), three(F.when(single, 0.0).otherwise(F.col("c"))), F.lit("DISTANCE_M"), three(F.col("d")), F.lit("MINSPEED_MPS"), three(F.col("lo")), F.lit("MAXSPEED_MPS"), three(F.col("hi")),
        F.lit("AVGSPEED_MPS"), three(F.when(single | (F.col("c") == 0), 0.0).otherwise(F.col("d") / F.when(F.col("c") != 0, F.col("c")))),
    )
    line = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("pts", lambda p: p.pt), ", "), F.lit(")"))
    return got.select("feature_id", line.alias("wkt"), attrs.alias("attrs"))
