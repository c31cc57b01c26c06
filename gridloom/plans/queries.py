"""Registered queries of the raster engine, each with SQL that says the same over plain rows of cells.

Rasters are derived from the business tables: A from lineitem, B from orders, on 64 x 64 cells in tiles of 16.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.colors import ColorScale
from ..grid import Bounds
from ..meta import RasterMeta
from ..operators import aggregate, cost, focal, local, vector
from ..raster import Raster, con, from_cells
from .engine import Engine

SIDE, TILE, ZOOM = 64, 16, 3
META = RasterMeta(ZOOM, TILE, 1, "float", (), Bounds(-180, -90, 0, 90))
#: Of tiles (1..2, 1..2) and a little more, so that edges matter.
WINDOW = Bounds(-130.0, -40.0, -50.0, 40.0)


def raster_a(spark: SparkSession, sf: str, tile_type: str = "float") -> Raster:
    t = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy((F.col("l_partkey") % SIDE).alias("gx"), (F.col("l_suppkey") % SIDE).alias("gy")).agg(F.max("l_quantity").alias("v"))
    return from_cells(t.where("v >= 5"), META.with_(tile_type=tile_type))


def raster_b(spark: SparkSession, sf: str, tile_type: str = "float") -> Raster:
    t = spark.read.parquet(f"{sf}/orders.parquet").groupBy((F.col("o_custkey") % SIDE).alias("gx"), (F.col("o_orderkey") % SIDE).alias("gy")).agg(F.max(F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("v"))
    return from_cells(t, META.with_(tile_type=tile_type))


_WITH = """WITH a AS (SELECT * FROM (SELECT (l_partkey % 64)::BIGINT AS gx, (l_suppkey % 64)::BIGINT AS gy, max(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) WHERE v >= 5),
b AS (SELECT (o_custkey % 64)::BIGINT AS gx, (o_orderkey % 64)::BIGINT AS gy, max(floor(o_totalprice / 1000))::DOUBLE AS v FROM orders GROUP BY 1, 2)
"""
_Q: dict = {}
_SQL: dict = {}


def _add(name: str, f, sql: str | None = None) -> None:
    _Q[name] = f
    if sql:
        _SQL[name] = _WITH + sql


def _cells(r: Raster, digits: int | None = None) -> DataFrame:
    out = r.cells()
    v = F.round("v", digits) if digits is not None else F.col("v")
    cols = ["gx", "gy", *(["band"] if r.meta.bands > 1 else [])]
    return out.select(*(F.col(c).cast("long").alias(c) for c in cols), (v + 0.0).alias("v"))


def _two(name: str, sql: str, flag: bool = False) -> None:
    value = f"CASE WHEN {sql} THEN 1.0 ELSE 0.0 END" if flag else f"CAST({sql} AS FLOAT)"
    _add(f"raster_{name}", lambda s, d: _cells(raster_a(s, d).binary(raster_b(s, d), name)), f"SELECT gx, gy, ({value})::DOUBLE + 0.0 AS v FROM a JOIN b USING (gx, gy)".replace("a.v", "a.v").replace("b.v", "b.v"))


for _n, _s in {"add": "a.v + b.v", "minus": "a.v - b.v", "rminus": "b.v - a.v", "mult": "a.v * b.v", "bitand": "a.v::BIGINT & b.v::BIGINT", "bitor": "a.v::BIGINT | b.v::BIGINT", "bitxor": "xor(a.v::BIGINT, b.v::BIGINT)", "rdiv": "b.v / a.v"}.items():
    _two(_n, _s)
for _n, _s in {"and": "abs(a.v) > 1e-8 AND abs(b.v) > 1e-8", "or": "abs(a.v) > 1e-8 OR abs(b.v) > 1e-8", "xor": "(abs(a.v) > 1e-8) <> (abs(b.v) > 1e-8)", "eq": "abs(a.v - b.v) <= 1e-8", "ne": "abs(a.v - b.v) > 1e-8", "gt": "a.v > b.v", "ge": "a.v >= b.v", "lt": "a.v < b.v", "le": "a.v <= b.v"}.items():
    _two(_n, _s, True)
_add("raster_div", lambda s, d: _cells(raster_a(s, d) / raster_b(s, d)), "SELECT gx, gy, CAST(CASE WHEN b.v = 0 THEN 'infinity'::DOUBLE ELSE a.v / b.v END AS FLOAT)::DOUBLE AS v FROM a JOIN b USING (gx, gy)")
_add("raster_pow", lambda s, d: _cells(raster_a(s, d) ** 2), "SELECT gx, gy, CAST(pow(v, 2) AS FLOAT)::DOUBLE AS v FROM a")
_add("raster_rpow", lambda s, d: _cells(2 ** (raster_a(s, d) / 8), 3), "SELECT gx, gy, round(CAST(pow(2, CAST(v / 8 AS FLOAT)::DOUBLE) AS FLOAT)::DOUBLE, 3) AS v FROM a")
for _n, _s in {"abs": "abs(v)", "uminus": "-v", "bitnot": "(~(v::BIGINT))", "not": "CASE WHEN abs(v) <= 1e-8 THEN 1 ELSE 0 END"}.items():
    _add(f"raster_{_n}", lambda s, d, n=_n: _cells((raster_a(s, d) - 20).unary(n)), f"SELECT gx, gy, ({_s})::DOUBLE + 0.0 AS v FROM (SELECT gx, gy, v - 20 AS v FROM a)")
for _n in ("sin", "cos", "tan"):
    _add(f"raster_{_n}", lambda s, d, n=_n: _cells(raster_a(s, d).unary(n), 4), f"SELECT gx, gy, round(CAST({_n}(v) AS FLOAT)::DOUBLE, 4) AS v FROM a")
_add("raster_log", lambda s, d: _cells(local.log(raster_a(s, d)), 4), "SELECT gx, gy, round(CAST(ln(v) AS FLOAT)::DOUBLE, 4) AS v FROM a")
_add("raster_log_base", lambda s, d: _cells(local.log(raster_a(s, d), 10), 4), "SELECT gx, gy, round(CAST(ln(v) / ln(10) AS FLOAT)::DOUBLE, 4) AS v FROM a")

_GRID = ", g AS (SELECT x.x AS gx, y.y AS gy FROM range(64) x(x), range(64) y(y))\n"
_TILES = ", t AS (SELECT DISTINCT gx // 16 AS tx, gy // 16 AS ty FROM a)\n"
_WIN = "gx BETWEEN 16 AND 47 AND gy BETWEEN 16 AND 47"
_add("raster_isnodata", lambda s, d: _cells(local.is_nodata(raster_a(s, d))), _GRID + "SELECT gx, gy, CASE WHEN a.v IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM g LEFT JOIN a USING (gx, gy)")
_add("raster_isnodatabounds", lambda s, d: _cells(local.is_nodata(raster_a(s, d), -130, -40, -50, 40)), _GRID + f"SELECT gx, gy, CASE WHEN a.v IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM g LEFT JOIN a USING (gx, gy) WHERE {_WIN}")
_add("raster_con", lambda s, d: _cells((lambda a, b: con(a > 45, b, a < 20, a * 2, 7))(raster_a(s, d), raster_b(s, d))), "SELECT gx, gy, CASE WHEN a.v > 45 THEN b.v WHEN a.v < 20 THEN a.v * 2 ELSE 7 END AS v FROM a LEFT JOIN b USING (gx, gy) WHERE NOT (a.v > 45 AND b.v IS NULL)")
_add("raster_con_outer", lambda s, d: _cells((lambda a, b: con(b >= 0, b, None))(raster_a(s, d), raster_b(s, d))), "SELECT gx, gy, v FROM b")
_add(
    "raster_script",
    lambda s, d: _cells(Engine(s, a=raster_a(s, d), b=raster_b(s, d)).run("# an example\nhigh = [a] * 2 + 1\nboth = high > 60 && [b] >= 100\ncon(both, high - [b], isNodata([b]), -1, 0)")),
    "SELECT gx, gy, CASE WHEN 2 * a.v + 1 > 60 AND b.v >= 100 THEN 2 * a.v + 1 - b.v ELSE 0 END AS v FROM a JOIN b USING (gx, gy)",
)
_add("raster_bandcombine", lambda s, d: _cells(local.band_combine(raster_a(s, d), raster_b(s, d))), "SELECT gx, gy, 0::BIGINT AS band, v FROM a UNION ALL SELECT gx, gy, 1, v FROM b")
_add("raster_bandextract", lambda s, d: _cells(local.band_extract(local.band_combine(raster_a(s, d), raster_b(s, d)), 2)), "SELECT gx, gy, v FROM b")
_add("raster_convert_truncate", lambda s, d: _cells(local.convert(raster_b(s, d) * 1.5, "byte")), "SELECT gx, gy, floor(least(greatest(v * 1.5, 0), 254)) AS v FROM b")
_add("raster_convert_mod", lambda s, d: _cells(local.convert(raster_b(s, d), "byte", "mod")), "SELECT gx, gy, v % 254 AS v FROM b")
_add("raster_convert_fit", lambda s, d: _cells(local.convert(raster_b(s, d), "byte", "fit")), ", m AS (SELECT min(v) AS x, max(v) AS y FROM b) SELECT gx, gy, floor(0.0 + v / (y - x) * (254.0 - 0.0))::DOUBLE AS v FROM b, m")
_add(
    "raster_changeclassification",
    lambda s, d: (lambda r: _cells(r).withColumn("classification", F.lit(r.meta.classification)).withColumn("resampling", F.lit(r.meta.resampling)))(local.change_classification(raster_a(s, d), "categorical")),
    "SELECT gx, gy, v, 'Categorical' AS classification, 'MODE' AS resampling FROM a",
)
_add("raster_normalize", lambda s, d: _cells(local.normalize(raster_a(s, d))), ", m AS (SELECT min(v) AS x, max(v) AS y FROM a) SELECT gx, gy, CAST((v - x) / (y - x) AS FLOAT)::DOUBLE AS v FROM a, m")
_add("raster_normalize_range", lambda s, d: _cells(local.normalize(raster_a(s, d), 0, 100)), "SELECT gx, gy, CAST(v / 100 AS FLOAT)::DOUBLE AS v FROM a")
_add("raster_crop", lambda s, d: _cells(local.crop(raster_a(s, d), WINDOW)), f"SELECT * FROM a WHERE {_WIN}")
_add("raster_crop_of_sum", lambda s, d: _cells(local.crop(raster_a(s, d) + raster_b(s, d), WINDOW)), f"SELECT gx, gy, a.v + b.v AS v FROM a JOIN b USING (gx, gy) WHERE {_WIN}")
_add("raster_cropexact", lambda s, d: _cells(local.crop_exact(raster_a(s, d), WINDOW)), "SELECT * FROM a WHERE gx BETWEEN 17 AND 46 AND gy BETWEEN 17 AND 46")
_add("raster_fill", lambda s, d: _cells(local.fill(local.crop(raster_a(s, d), WINDOW), 3, META.bounds)), _GRID + f"SELECT gx, gy, 3.0::DOUBLE AS v FROM g WHERE NOT ({_WIN}) UNION ALL SELECT * FROM a WHERE {_WIN}")
_add("raster_fill_raster", lambda s, d: _cells(local.fill(local.crop(raster_a(s, d), WINDOW), raster_b(s, d), META.bounds)), f"SELECT gx, gy, v FROM b WHERE NOT ({_WIN}) UNION ALL SELECT * FROM a WHERE {_WIN}")
_add("raster_mosaic", lambda s, d: _cells(local.mosaic(local.crop(raster_a(s, d), WINDOW), raster_b(s, d), raster_a(s, d))), f"SELECT gx, gy, coalesce(CASE WHEN {_WIN} THEN a.v END, b.v, a.v) AS v FROM a FULL JOIN b USING (gx, gy)")
_add("raster_findholes", lambda s, d: local.find_holes(local.crop(raster_a(s, d), WINDOW), META.bounds).select("tx", "ty"), "SELECT x.x AS tx, y.y AS ty FROM range(4) x(x), range(4) y(y) WHERE NOT (x.x BETWEEN 1 AND 2 AND y.y BETWEEN 1 AND 2)")
_THREE = ", u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT gx, gy, v + 3 FROM a)\n"
for _n, _s in {"min": "min(v)", "max": "max(v)", "mean": "round(avg(v), 4)", "median": "median(v)", "sum": "sum(v)", "count": "count(*)", "stddev": "round(stddev_pop(v), 4)"}.items():
    _g = _GRID if _n == "count" else ""
    _src = "SELECT gx, gy, count(v)::DOUBLE AS v FROM g LEFT JOIN u USING (gx, gy) GROUP BY 1, 2" if _n == "count" else f"SELECT gx, gy, ({_s})::DOUBLE AS v FROM u GROUP BY 1, 2"
    _add(f"raster_statistics_{_n}", lambda s, d, n=_n: _cells((lambda a, b: local.statistics(n, a, b, a + 3))(raster_a(s, d), raster_b(s, d)), 4 if n in ("mean", "stddev") else None), _THREE + _g + _src)
_add("raster_statistics_mode", lambda s, d: _cells((lambda a, b: local.statistics("mode", a, b, a))(raster_a(s, d), raster_b(s, d))), "SELECT gx, gy, coalesce(a.v, b.v) AS v FROM a FULL JOIN b USING (gx, gy)")
_add("raster_stats", lambda s, d: local.stats(raster_a(s, d)).select("min", "max", "sum", "count", F.round("mean", 6).alias("mean")), "SELECT min(v) AS min, max(v) AS max, sum(v) AS sum, count(*) AS count, round(avg(v), 6) AS mean FROM a")
_add("raster_quantiles", lambda s, d: aggregate.quantiles(raster_b(s, d), 8).select(F.col("k").cast("long").alias("k"), "value"), ", r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM b) SELECT k.k AS k, v AS value FROM r JOIN range(1, 8) k(k) ON i = least(-((-k.k * n) // 8), n - 1)".replace("-((-k.k * n) // 8)", "(k.k * n + 7) // 8"))

_NEAR = "FROM a c JOIN {n} n ON n.gx BETWEEN c.gx - {l} AND c.gx + {r} AND n.gy BETWEEN c.gy - {l} AND c.gy + {r}"
for _n, _s in {"count": "count(*)", "min": "min(n.v)", "max": "max(n.v)", "range": "max(n.v) - min(n.v)", "sum": "sum(n.v)", "mean": "round(CAST(avg(n.v) AS FLOAT)::DOUBLE, 4)", "median": "median(n.v)", "variance": "round(coalesce(var_samp(n.v), 0), 3)", "stddev": "round(coalesce(stddev_samp(n.v), 0), 3)"}.items():
    _add(f"raster_focal_{_n}", lambda s, d, n=_n: _cells(focal.focal_stat(n, raster_a(s, d), "3p", True), {"mean": 4, "variance": 3, "stddev": 3}.get(n)), f"SELECT c.gx, c.gy, ({_s})::DOUBLE AS v " + _NEAR.format(n="a", l=1, r=1) + " GROUP BY 1, 2")
_add("raster_focal_even_strict", lambda s, d: _cells(focal.focal_stat("sum", raster_a(s, d), 4, False)), "SELECT c.gx, c.gy, sum(n.v) AS v " + _NEAR.format(n="a", l=1, r=2) + " GROUP BY 1, 2 HAVING count(*) = 16")
_add("raster_focal_wide", lambda s, d: _cells(focal.focal_stat("max", raster_a(s, d), 41, True)), "SELECT c.gx, c.gy, max(n.v) AS v " + _NEAR.format(n="a", l=20, r=20) + " GROUP BY 1, 2")
_add("raster_tpi", lambda s, d: _cells(focal.tpi(raster_a(s, d), 5), 3), "SELECT c.gx, c.gy, round(any_value(c.v) - (sum(n.v) - any_value(c.v)) / (count(*) - 1), 3) AS v " + _NEAR.format(n="a", l=2, r=2) + " GROUP BY 1, 2 HAVING count(*) > 1")
_M = "(2.8125 * 2 * pi() * 6378137.0 / 360)"
_Z = ", z AS (SELECT c.gx, c.gy, c.v AS e" + "".join(f", coalesce(n{k}.v, c.v) AS z{k}" for k in range(8)) + " FROM (SELECT gx, gy, v * 100000 AS v FROM a) c" + "".join(f" LEFT JOIN (SELECT gx, gy, v * 100000 AS v FROM a) n{k} ON n{k}.gx = c.gx + ({x}) AND n{k}.gy = c.gy + ({y})" for k, (y, x, _) in enumerate(cost.STEPS)) + ")\n"
_D = ", w AS (SELECT gx, gy, ((z1 + 2 * z2 + z3) - (z7 + 2 * z6 + z5)) / 8 AS x, ((z7 + 2 * z0 + z1) - (z5 + 2 * z4 + z3)) / 8 AS y FROM z)\n"
_add("raster_slope", lambda s, d: _cells(focal.slope(raster_a(s, d) * 100000, "deg"), 3), _Z + _D + f"SELECT gx, gy, round(CAST(acos(least(1, {_M} / sqrt(x * x + y * y + {_M} * {_M}))) * 57.2957795 AS FLOAT)::DOUBLE, 3) AS v FROM w")
_add("raster_aspect", lambda s, d: _cells(focal.aspect(raster_a(s, d) * 100000, "rad"), 3), _Z + _D + "SELECT gx, gy, round(CAST(CASE WHEN x = 0 AND y <= 0 THEN -1 ELSE 2 * pi() - (atan2(-y, -x) + 1.5 * pi()) + CASE WHEN atan2(-y, -x) + 1.5 * pi() >= 2 * pi() THEN 2 * pi() ELSE 0 END END AS FLOAT)::DOUBLE, 3) AS v FROM w")
_add("raster_slope8", lambda s, d: _cells(focal.slope8(raster_a(s, d) * 100000, "rad"), 3), _Z + " UNION ALL ".join(f"SELECT gx, gy, {k}::BIGINT AS band, round(CAST(atan2(z{k} - e, {_M} * {'sqrt(2)' if x and y else '1'}) AS FLOAT)::DOUBLE, 3) AS v FROM z" for k, (y, x, _) in enumerate(cost.STEPS)))
_S = "(400000 / (2.8125 * 2 * pi() * 6378137.0 / 360))"
_add(
    "raster_kernel_gaussian",
    lambda s, d: _cells(focal.kernel("gaussian", raster_a(s, d), 400_000), 2),
    f", m AS (SELECT sum(exp(-0.5 * pow(k / {_S}, 2))) AS m FROM range(-4, 5) t(k)) SELECT c.gx, c.gy, round(CAST(sum(n.v * exp(-0.5 * pow((n.gx - c.gx) / {_S}, 2)) * exp(-0.5 * pow((n.gy - c.gy) / {_S}, 2))) / pow(any_value(m.m), 2) AS FLOAT)::DOUBLE, 2) AS v "
    + _NEAR.format(n="a", l=4, r=4) + " CROSS JOIN m GROUP BY 1, 2",
)
_add(
    "raster_kernel_laplacian",
    lambda s, d: _cells(focal.kernel("laplacian", raster_a(s, d), 400_000), 2),
    # smoothed values of all cells and of those around the raster, then the stencil
    f", m AS (SELECT sum(exp(-0.5 * pow(k / {_S}, 2))) AS m FROM range(-4, 5) t(k)), e AS (SELECT x.x AS gx, y.y AS gy FROM range(-1, 65) x(x), range(-1, 65) y(y)),\n"
    f"k AS (SELECT e.gx, e.gy, coalesce(sum(n.v * exp(-0.5 * pow((n.gx - e.gx) / {_S}, 2)) * exp(-0.5 * pow((n.gy - e.gy) / {_S}, 2))), 0) / pow(any_value(m.m), 2) AS v\n"
    "  FROM e CROSS JOIN m LEFT JOIN a n ON n.gx BETWEEN e.gx - 4 AND e.gx + 4 AND n.gy BETWEEN e.gy - 4 AND e.gy + 4 GROUP BY 1, 2)\n"
    "SELECT a.gx, a.gy, round(CAST(u.v + l.v + r.v + b.v - 4 * c.v AS FLOAT)::DOUBLE, 2) + 0.0 AS v FROM a JOIN k c ON c.gx = a.gx AND c.gy = a.gy JOIN k u ON u.gx = a.gx AND u.gy = a.gy - 1\n"
    "  JOIN k b ON b.gx = a.gx AND b.gy = a.gy + 1 JOIN k l ON l.gx = a.gx - 1 AND l.gy = a.gy JOIN k r ON r.gx = a.gx + 1 AND r.gy = a.gy",
)

_P = ", p AS (SELECT gx // 2 AS gx, gy // 2 AS gy, v, (gy % 2) * 2 + gx % 2 AS k FROM a)\n"
for _n, _s in {
    "MEAN": "avg(v)", "SUM": "sum(v)", "MIN": "min(v)", "MAX": "max(v)", "NEAREST": "arg_min(v, [0, 1, 3, 2][k + 1])",
    "MODE": "(list_sort(list_transform(list_distinct(list(v)), lambda x: [-len(list_filter(list(v), lambda y: y = x)), x])))[1][2]",
}.items():
    if _n == "MODE":
        _sql = _P + "SELECT gx, gy, arg_min(v, [-n, v]) AS v FROM (SELECT gx, gy, v, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2"
    else:
        _sql = _P + f"SELECT gx, gy, {_s} AS v FROM p GROUP BY 1, 2"
    _add(f"raster_pyramid_{_n.lower()}", lambda s, d, n=_n: _cells(aggregate.coarser(raster_a(s, d), n)), _sql)
_add("raster_pyramid_minavgpair", lambda s, d: _cells(aggregate.coarser(raster_a(s, d), "MINAVGPAIR")), _P + "SELECT gx, gy, (l[1] + l[2]) / 2 AS v FROM (SELECT gx, gy, list_sort(list(v)) AS l FROM p GROUP BY 1, 2) WHERE len(l) > 1")
_add("raster_pyramid_stats", lambda s, d: aggregate.pyramid_stats(aggregate.build_pyramid(raster_a(s, d), "MAX")).select("zoom", "min", "max", "sum", "count"), ", q AS (SELECT 3 AS zoom, * FROM a UNION ALL SELECT 2, gx // 2, gy // 2, max(v) FROM a GROUP BY 2, 3 UNION ALL SELECT 1, gx // 4, gy // 4, max(v) FROM a GROUP BY 2, 3) SELECT zoom, min(v) AS min, max(v) AS max, sum(v) AS sum, count(*) AS count FROM q GROUP BY 1")

_EV = ", e AS (SELECT (event_id * 37) % 360 - 180 AS x, (user_id * 17) % 180 - 90 AS y, value FROM events)\n, k AS (SELECT floor((x + 180) / 2.8125)::BIGINT AS gx, 63 - floor((y + 90) / 2.8125)::BIGINT AS gy, round(value) AS v FROM e)\n"


def _events(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    x, y = (F.col("event_id") * 37) % 360 - 180, (F.col("user_id") * 17) % 180 - 90
    return e.select(F.col("event_id").alias("feature_id"), F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")")).alias("wkt"), F.create_map(F.lit("value"), F.round("value").cast("string")).alias("attrs"))


for _n, _s in {"SUM": "sum(v)", "MIN": "min(v)", "MAX": "max(v)", "AVERAGE": "round(avg(v), 6)", "MASK": "0.0", "MASK2": "1.0"}.items():
    _add(f"raster_rasterizepoints_{_n.lower()}", lambda s, d, n=_n: _cells(vector.rasterize_points(_events(s, d), n, "3z", None if n.startswith("MASK") else "value", tilesize=TILE), 6), _EV + f"SELECT gx, gy, ({_s})::DOUBLE AS v FROM k GROUP BY 1, 2")
_add("raster_rasterizepoints_bounds", lambda s, d: _cells(vector.rasterize_points(_events(s, d), "SUM", 2.8125, "value", Bounds(-60, -30, 60, 30), TILE)), _EV + "SELECT gx, gy, sum(v) AS v FROM (SELECT floor((x + 180) / 2.8125)::BIGINT AS gx, 63 - floor((y + 90) / 2.8125)::BIGINT AS gy, round(value) AS v FROM e WHERE x BETWEEN -60 AND 60 AND y BETWEEN -30 AND 30) GROUP BY 1, 2")


def _boxes(s: SparkSession, d: str) -> DataFrame:
    """A box for each supplier, and a hole in every third."""
    t = s.read.parquet(f"{d}/supplier.parquet")
    w, b = (F.col("s_suppkey") * 13) % 300 - 180.0, (F.col("s_suppkey") * 7) % 120 - 90.0
    n = lambda c: c.cast("string")
    ring = lambda x0, y0, x1, y1: F.concat(F.lit("("), n(x0), F.lit(" "), n(y0), F.lit(","), n(x1), F.lit(" "), n(y0), F.lit(","), n(x1), F.lit(" "), n(y1), F.lit(","), n(x0), F.lit(" "), n(y1), F.lit(","), n(x0), F.lit(" "), n(y0), F.lit(")"))
    hole = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(","), ring(w + 10, b + 8, w + 30, b + 20))).otherwise("")
    return t.select(F.col("s_suppkey").alias("feature_id"), F.concat(F.lit("POLYGON ("), ring(w, b, w + 45, b + 30), hole, F.lit(")")).alias("wkt"), F.create_map(F.lit("value"), (F.col("s_suppkey") % 10).cast("string")).alias("attrs"))


_BOX = ", s AS (SELECT s_suppkey AS id, (s_suppkey * 13) % 300 - 180.0 AS w, (s_suppkey * 7) % 120 - 90.0 AS b FROM supplier)\n, g AS (SELECT x.x AS gx, y.y AS gy, -180 + (x.x + 0.5) * 2.8125 AS cx, 90 - (y.y + 0.5) * 2.8125 AS cy FROM range(128) x(x), range(64) y(y))\n, k AS (SELECT gx, gy, (id % 10)::DOUBLE AS v FROM s JOIN g ON cx > w AND cx < w + 45 AND cy > b AND cy < b + 30 WHERE NOT (id % 3 = 0 AND cx > w + 10 AND cx < w + 30 AND cy > b + 8 AND cy < b + 20))\n"
for _n, _s in {"SUM": "sum(v)", "MIN": "min(v)", "MAX": "max(v)", "AVERAGE": "round(avg(v), 6)", "MASK2": "1.0"}.items():
    _add(f"raster_rasterizevector_{_n.lower()}", lambda s, d, n=_n: _cells(vector.rasterize_vector(_boxes(s, d), n, "3z", None if n.startswith("MASK") else "value", tilesize=TILE), 6), _BOX + f"SELECT gx, gy, ({_s})::DOUBLE AS v FROM k GROUP BY 1, 2")


def _friction(s: SparkSession, d: str) -> Raster:
    return con(raster_a(s, d) > 25, raster_a(s, d) / 10, 1)


def _path_start(s: SparkSession) -> DataFrame:
    return vector.points(s, [(-100.0, 12.0)])


def _cost(s: SparkSession, d: str, most: float = -1.0) -> Raster:
    return cost.cost_distance(_path_start(s), local.fill(_friction(s, d), 1).map(lambda v: F.coalesce(v, F.lit(4.0))), most)


# Bellman and Ford's relaxation, a step of all cells a round, until no cell gets cheaper
_NEXT = ", s AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {y}, {x}, {'sqrt(2)' if x and y else '1.0'})" for k, (y, x, _) in enumerate(cost.STEPS)) + ") t(k, dy, dx, far))\n"
_FIELD = _GRID + ", f AS (SELECT gx, gy, CASE WHEN a.v > 25 THEN CAST(a.v / 10 AS FLOAT)::DOUBLE ELSE 1.0 END AS f FROM g LEFT JOIN a USING (gx, gy))\n" + _NEXT
_COST = (
    ", w AS (SELECT p.gx AS x, p.gy AS y, q.gx, q.gy, (p.f + q.f) * 0.5 * s.far * {m} AS w FROM f p CROSS JOIN s JOIN f q ON q.gx = p.gx + s.dx AND q.gy = p.gy + s.dy)\n"
    ", d(gx, gy, c) USING KEY (gx, gy) AS (SELECT gx, gy, 0.0::DOUBLE FROM f WHERE gx = 28 AND gy = 27\n"
    "  UNION SELECT w.gx, w.gy, min(d.c + w.w) FROM d JOIN w ON w.x = d.gx AND w.y = d.gy LEFT JOIN recurring.d r ON r.gx = w.gx AND r.gy = w.gy WHERE d.c + w.w < coalesce(r.c, 'infinity'::DOUBLE) - 1e-7 {most} GROUP BY 1, 2)\n"
)
_RECURSIVE = "WITH RECURSIVE" + _WITH[4:]


def _recursive(name: str, f, sql: str) -> None:
    _add(name, f)
    _SQL[name] = _RECURSIVE + sql


_recursive("raster_costdistance", lambda s, d: _cells(_cost(s, d), 0), _FIELD + _COST.format(m=_M, most="") + "SELECT gx, gy, round(CAST(c AS FLOAT)::DOUBLE, 0) + 0.0 AS v FROM d")
_recursive("raster_costdistance_limit", lambda s, d: _cells(_cost(s, d, 4_000_000.0), 0), _FIELD + _COST.format(m=_M, most="AND d.c + w.w <= 4000000.0 + 1e-8") + "SELECT gx, gy, round(CAST(c AS FLOAT)::DOUBLE, 0) + 0.0 AS v FROM d")
_three = "rtrim(rtrim(({})::DECIMAL(38, 3)::VARCHAR, '0'), '.')"
_recursive(
    "raster_leastcostpath",
    lambda s, d: cost.least_cost_path(_cost(s, d), vector.points(s, [(-30.0, -60.0), (-170.0, 80.0), (-100.0, 12.0)])).select("feature_id", "wkt", F.col("attrs")["DISTANCE_M"].alias("distance")),
    _FIELD + _COST.format(m=_M, most="") + ", c AS (SELECT gx, gy, CAST(c AS FLOAT)::DOUBLE AS c FROM d)\n"
    # the lowest neighbour, of equal ones the first by rows; none where no neighbour is lower
    ", o AS (SELECT c.gx, c.gy, arg_min([n.gx, n.gy], [n.c, n.gy - c.gy, n.gx - c.gx]) AS to_, min(n.c) < any_value(c.c) AS go FROM c CROSS JOIN s JOIN c n ON n.gx = c.gx + s.dx AND n.gy = c.gy + s.dy GROUP BY 1, 2)\n"
    ", t AS (SELECT * FROM (VALUES (0::BIGINT, 53::BIGINT, 53::BIGINT, 0::BIGINT), (1, 3, 3, 0), (2, 28, 27, 0)) t(feature_id, gx, gy, step) UNION ALL SELECT t.feature_id, o.to_[1], o.to_[2], t.step + 1 FROM t JOIN o USING (gx, gy) WHERE o.go)\n"
    ", l AS (SELECT *, CASE WHEN lag(gx) OVER p IS NULL THEN 0.0 WHEN gx <> lag(gx) OVER p AND gy <> lag(gy) OVER p THEN sqrt(2) ELSE 1.0 END * CAST(" + _M + " AS FLOAT)::DOUBLE AS far FROM t WINDOW p AS (PARTITION BY feature_id ORDER BY step))\n"
    "SELECT feature_id, 'LINESTRING (' || string_agg((gx * 2.8125 - 180.0)::DOUBLE::VARCHAR || ' ' || (90.0 - gy * 2.8125)::DOUBLE::VARCHAR, ', ' ORDER BY step) || ')' AS wkt, " + _three.format("round(sum(far), 3)") + " AS distance FROM l GROUP BY 1",
)
_add("raster_inlinecsv", lambda s, d: Engine(s).run("InlineCsv('name,x,y', \"'a, b',10,-5;c,20,30.5\")").select("wkt", F.col("attrs")["name"].alias("name")), "SELECT * FROM (VALUES ('POINT (10.0 -5.0)', 'a, b'), ('POINT (20.0 30.5)', 'c')) t(wkt, name)")
# the interval that holds the point is halved bit by bit; even bits are of the longitude
_add(
    "raster_geohash",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", geometry.geohash(((F.col("user_id") * 17) % 180 - 90).cast("double"), ((F.col("event_id") * 37) % 360 - 180).cast("double"), 8).alias("hash")),
    ", e AS (SELECT event_id, ((event_id * 37) % 360 - 180)::DOUBLE AS lon, ((user_id * 17) % 180 - 90)::DOUBLE AS lat FROM events)\n"
    ", h AS (SELECT event_id, list_transform(range(40), lambda i: CASE WHEN i % 2 = 0 THEN floor((lon + 180.0) / (360.0 / pow(2, i // 2 + 1))) % 2 ELSE floor((lat + 90.0) / (180.0 / pow(2, i // 2 + 1))) % 2 END) AS b FROM e)\n"
    "SELECT event_id, array_to_string(list_transform(range(8), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + 16 * b[5 * c + 1] + 8 * b[5 * c + 2] + 4 * b[5 * c + 3] + 2 * b[5 * c + 4] + b[5 * c + 5])::BIGINT, 1)), '') AS hash FROM h",
)
_add("raster_greatcircle", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.round(geometry.great_circle(((F.col("user_id") * 17) % 180 - 90).cast("double"), ((F.col("event_id") * 37) % 360 - 180).cast("double"), F.lit(0.0), F.lit(0.0)) / 1000, 3).alias("km")), "SELECT event_id, round(2 * 6378137.0 * asin(sqrt(least(1.0, pow(sin((0 - radians((user_id * 17) % 180 - 90)) / 2), 2) + cos(radians((user_id * 17) % 180 - 90)) * pow(sin(radians(0 - ((event_id * 37) % 360 - 180)) / 2), 2)))) / 1000, 3) AS km FROM events")
_SCALE = ColorScale(((10.0, (0, 0, 0, 255)), (30.0, (200, 100, 50, 255)), (50.0, (255, 255, 255, 255))), "Absolute")


def _colors(s: SparkSession, d: str) -> DataFrame:
    from ..functions.colors import colored

    return _cells(colored(raster_a(s, d), _SCALE)).where("band < 3")


_add("raster_colorscale", _colors, _GRID + " UNION ALL ".join(f"SELECT gx, gy, {k}::BIGINT AS band, (CASE WHEN a.v IS NULL THEN 0 WHEN a.v < 10 THEN 0 WHEN a.v < 30 THEN floor((a.v - 10) / 20 * {m} + 0.5) WHEN a.v < 50 THEN floor({m} + (a.v - 30) / 20 * (255 - {m}) + 0.5) ELSE 255 END)::DOUBLE AS v FROM g LEFT JOIN a USING (gx, gy)" for k, m in enumerate((200, 100, 50))))


def _catalog(s: SparkSession, d: str) -> DataFrame:
    """Saved with its pyramid, found again by name, and cropped at the scan."""
    import uuid

    from ..runtime import shared_dir
    from ..sources.catalog import Catalog

    c = Catalog(s, f"{shared_dir(s)}/gridloom/catalog-{uuid.uuid4().hex[:8]}")
    c.save(aggregate.build_pyramid(raster_a(s, d), "MAX", 2), "a")
    return _cells(c.raster("a", 2, WINDOW))


_add("raster_save_and_scan", _catalog, "SELECT gx // 2 AS gx, gy // 2 AS gy, max(v) AS v FROM a GROUP BY 1, 2")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict:
    return dict(_SQL)
