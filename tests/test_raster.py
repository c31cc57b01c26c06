"""The raster engine on closed-form and brute-force fixtures."""

import math
import struct
import zlib
from heapq import heappop, heappush

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import grid
from gridloom.functions import aggregators, geometry
from gridloom.functions.colors import GREY, ColorScale
from gridloom.grid import Bounds
from gridloom.meta import RasterMeta, widest
from gridloom.operators import aggregate, cost, focal, local, vector
from gridloom.plans import serve
from gridloom.plans.engine import Engine
from gridloom.plans.parser import ParseError, parse, statements
from gridloom.plans.registry import lookup, mapop, names
from gridloom.raster import Raster, con, from_cells
from gridloom.sources import images, vectors
from gridloom.sources.catalog import Catalog

TS, SIDE = 8, 24
META = RasterMeta(3, TS, 1, "float", (), Bounds(-180, -90 + 180 / 32 * 8, -180 + 180 / 32 * 24, 90))


def fixture(holes=0.25, seed=1, low=1, high=50):
    rng = np.random.default_rng(seed)
    a = rng.integers(low, high, (SIDE, SIDE)).astype(float)
    a[rng.random((SIDE, SIDE)) < holes] = np.nan
    return a


def raster(spark, a, **meta):
    j, i = np.nonzero(~np.isnan(a))
    rows = [(int(x), int(y), float(a[y, x])) for y, x in zip(j, i)]
    return from_cells(spark.createDataFrame(rows, "gx long, gy long, v double"), META.with_(**meta))


def values(r, shape=(SIDE, SIDE), band=0):
    out = np.full(shape, np.nan)
    for c in r.cells().where(F.col("band") == band).collect():
        out[c.gy, c.gx] = c.v
    return out


def same(a, b, tol=1e-5):
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


def test_grid_arithmetic():
    assert grid.resolution(1, 512) == 180 / 512 and grid.resolution(0, 512) == 0
    assert grid.tile_xy(grid.tile_id(5, 3, 4), 4) == (5, 3)
    assert grid.bounds_to_tiles(Bounds(-180, -90, 180, 90), 2, 512) == grid.TileBounds(0, 0, 3, 1)
    assert grid.bounds_to_tiles(Bounds(-90, 0, 0, 90), 2, 512) == grid.TileBounds(1, 1, 1, 1)
    assert grid.zoom_for_pixel_size(grid.resolution(7, 512), 512) == 7 and grid.zoom_for_pixel_size(1e-12, 512) == 0
    assert grid.lat_lon_to_pixel(89.99, -179.99, 3, 8) == (0, 0)
    assert grid.pixel_to_lat_lon(0, 0, 3, 8) == (90.0, -180.0)
    assert widest("byte", "int", "short") == "int"
    m = META.with_(stats=((1.0, 2.0),), tags=(("a", "b"),))
    assert RasterMeta.from_json(m.to_json()) == m


def test_operators_of_rasters(spark):
    a, b = fixture(), fixture(seed=2)
    x, y = raster(spark, a), raster(spark, b)
    for got, want in [(x + y, a + b), (3 - x, 3 - a), (x / y, a / b), (2**x, np.float32(2.0) ** np.float32(a)), (-x, -a), (x & y, np.where(np.isnan(a + b), np.nan, np.nan_to_num(a).astype(int) & np.nan_to_num(b).astype(int))), (x > y, np.where(np.isnan(a + b), np.nan, a > b)), (abs(x - y), abs(a - b))]:
        same(values(got), want)
    same(values(x.log(10)), np.log10(a))
    assert len((x + y * x).sources) == 2


def test_division_and_special_values(spark):
    a = np.array([[0.0, -1.0, 5.0, np.nan]])
    x = raster(spark, np.pad(a, ((0, SIDE - 1), (0, SIDE - 4)), constant_values=np.nan))
    assert values(5 / x)[0, :4].tolist()[:3] == [math.inf, -5.0, 1.0]
    log = values(local.log(x))[0, :4]
    assert log[0] == -math.inf and np.isnan(log[1]) and log[2] == np.float32(math.log(5))
    big = x.map(lambda v: v * float("inf"))
    assert values(big.binary(big, "eq"))[0, 2] == 0.0 and values(big.binary(big, "ne"))[0, 2] == 1.0
    assert values(x.unary("not"))[0, :3].tolist() == [1.0, 0.0, 0.0]


def test_con_with_nodata_and_missing_tiles(spark):
    a, b = fixture(), fixture(0.0, 2)
    x, y = raster(spark, a), local.crop(raster(spark, b), Bounds(-180, 45, -136, 90))
    inner = np.full_like(b, np.nan)
    inner[:8, :8] = b[:8, :8]
    same(values(con(x > 25, y, x)), np.where(np.isnan(a), np.nan, np.where(a > 25, inner, a)))
    same(values(con(x > 25, 1, None)), np.where(a > 25, 1, np.nan))
    with pytest.raises(ValueError):
        con(x, 1)


def test_local_operators(spark):
    a, b = fixture(), fixture(seed=2, high=9)
    x, y = raster(spark, a), raster(spark, b)
    same(values(local.is_nodata(x)), np.isnan(a).astype(float))
    two = local.band_combine(x, y)
    same(values(two, band=1), b)
    same(values(local.band_extract(two, 2)), b)
    same(values(local.convert(x * 9, "byte")), np.minimum(a * 9, 254))
    same(values(local.convert(x * 9, "byte", "mod")), np.fmod(a * 9, 254))
    with pytest.raises(ValueError):
        local.convert(x, "double", "fit")
    same(values(local.normalize(x)), (a - np.nanmin(a)) / (np.nanmax(a) - np.nanmin(a)))
    stack = np.stack([a, b, a + 3])
    r = lambda n: values(local.statistics(n, x, y, x + 3))
    with np.errstate(all="ignore"):
        import warnings

        warnings.simplefilter("ignore")
        same(r("min"), np.nanmin(stack, 0))
        same(r("median"), np.nanmedian(stack, 0))
        same(r("stddev"), np.nanstd(stack, 0))
    same(r("count"), (~np.isnan(stack)).sum(0).astype(float))
    q = {z.k: z.value for z in aggregate.quantiles(x, 4).collect()}
    s = np.sort(a[~np.isnan(a)])
    assert q == {k: s[min(math.ceil(k / 4 * len(s)), len(s) - 1)] for k in (1, 2, 3)}


def test_normalize_of_constant_bands(spark, tmp_path):
    a = fixture()
    flat = np.where(np.isnan(a), np.nan, 50.0)
    rows = lambda r, band=0: {(c.gx, c.gy): c.v for c in r.cells().where(F.col("band") == band).collect()}
    there = {(int(x), int(y)) for y, x in zip(*np.nonzero(~np.isnan(a)))}
    # 0 / 0: NaN in cells that have a value, and no row where there is none; other bands keep their own range
    both = local.normalize(local.band_combine(raster(spark, flat), raster(spark, a)))
    got = rows(both)
    assert set(got) == there and all(math.isnan(v) for v in got.values())
    same(values(both, band=1), (a - np.nanmin(a)) / (np.nanmax(a) - np.nanmin(a)))
    got = rows(local.normalize(raster(spark, a), 20, 20))
    assert set(got) == there
    for (x, y), v in got.items():
        assert math.isnan(v) if a[y, x] == 20 else v == math.copysign(math.inf, a[y, x] - 20)
    # the registered query against its SQL, on a table whose cells all have 50 as their maximum
    import duckdb

    import __spark_entry__ as e

    t = ["l_partkey long, l_suppkey long, l_quantity double", "o_custkey long, o_orderkey long, o_totalprice double"]
    spark.createDataFrame([(k, k // 7, q) for k in range(200) for q in (9.0, 50.0)], t[0]).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 1, 1.0)], t[1]).write.parquet(str(tmp_path / "orders.parquet"))
    for n in ("lineitem", "orders"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    ordered = lambda rows: sorted((x, y, repr(v)) for x, y, v in rows)
    want = ordered(duckdb.sql(e.oracle_sql()["raster_normalize"]).fetchall())
    assert {v for _, _, v in want} == {"nan"} and ordered(map(tuple, e.queries()["raster_normalize"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("stat,f", [("sum", np.nansum), ("min", np.nanmin), ("median", np.nanmedian), ("stddev", lambda v: np.nanstd(v, ddof=1) if (~np.isnan(v)).sum() > 1 else 0.0)])
@pytest.mark.parametrize("w", [3, 4, 19])
def test_focal_equals_brute_force(spark, stat, f, w):
    a = fixture(0.4)
    before = w // 2 if w % 2 else w // 2 - 1
    p = np.pad(a, ((before, w - 1 - before),) * 2, constant_values=np.nan)
    want = np.array([[np.nan if np.isnan(a[j, i]) else f(p[j : j + w, i : i + w]) for i in range(SIDE)] for j in range(SIDE)])
    same(values(focal.focal_stat(stat, raster(spark, a), w)), want, 1e-4)


def test_terrain_of_planes(spark):
    m = grid.meters(3, TS)
    yy, xx = np.mgrid[0:SIDE, 0:SIDE]
    inner = (slice(1, -1),) * 2
    east = raster(spark, xx * m)
    same(values(focal.slope(east, "deg"))[inner], 45.0, 1e-3)
    same(values(focal.aspect(east, "deg"))[inner], 270.0, 1e-3)
    same(values(focal.aspect(raster(spark, yy * m), "deg"))[inner], np.full((22, 22), -57.2957795), 1e-3)  # due north counts as flat
    same(values(focal.aspect(raster(spark, -yy * m), "deg"))[inner], 180.0, 1e-3)
    same(values(focal.slope(raster(spark, xx * 0.0), "percent")), 0.0)
    s8 = focal.slope8(east, "deg")
    same(values(s8, band=2)[inner], 45.0, 1e-3)
    same(values(s8, band=6)[inner], -45.0, 1e-3)
    with pytest.raises(ValueError):
        focal.slope(east, "furlongs")


def test_kernel_keeps_mass_and_crosses_tiles(spark):
    a = np.zeros((SIDE, SIDE))
    a[11, 7] = 100.0
    sigma = grid.meters(3, TS)
    got = values(focal.kernel("gaussian", raster(spark, a), sigma))
    assert got.sum() == pytest.approx(100, rel=1e-4) and np.unravel_index(got.argmax(), got.shape) == (11, 7)
    same(got[11, 4:11], got[11, 4:11][::-1], 1e-4)
    assert values(focal.kernel("laplacian", raster(spark, a), sigma))[11, 7] < 0


def test_aggregators_and_pyramid(spark):
    a = fixture()
    for rule in aggregators.RULES:
        same(values(aggregate.coarser(raster(spark, a), rule), (12, 12)), aggregators.reduce(a, rule))
    assert aggregators.reduce(np.array([[1.0, 2.0], [2.0, 2.0]]), "MEAN", True)[0, 0] == 1.0
    levels = aggregate.build_pyramid(raster(spark, np.ones((SIDE, SIDE))))
    assert [r.meta.zoom for r in levels] == [3, 2, 1] and {c.v for c in levels[2].cells().collect()} == {1.0}
    with pytest.raises(ValueError):
        aggregate.coarser(raster(spark, a), "BEST")


def dijkstra(f, start, m, most=-1):
    best = np.full(f.shape, np.inf)
    heap = []
    for y, x in start:
        best[y, x] = 0.0
        heappush(heap, (0.0, y, x))
    while heap:
        c, y, x = heappop(heap)
        if c > best[y, x]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                v, u = y + dy, x + dx
                if (dy or dx) and 0 <= v < f.shape[0] and 0 <= u < f.shape[1] and not np.isnan(f[v, u]):
                    n = c + (f[y, x] + f[v, u]) / 2 * m * math.hypot(dy, dx)
                    if n < best[v, u] and (most <= 0 or n <= most):
                        best[v, u] = n
                        heappush(heap, (n, v, u))
    return np.where(np.isinf(best), np.nan, best)


def test_cost_distance_and_path(spark):
    f = fixture(0.2)
    f[9, 9] = f[3, 20] = 2.0
    m, r = grid.meters(3, TS), grid.resolution(3, TS)
    at = lambda y, x: (x * r - 180 + r / 2, 90 - y * r - r / 2)
    start = vector.points(spark, [at(9, 9), at(3, 20)])
    got = cost.cost_distance(start, raster(spark, f))
    want = dijkstra(f, [(9, 9), (3, 20)], m)
    same(values(got), want, 1e-4)
    most = float(np.nanmedian(want))
    same(values(cost.cost_distance(start, raster(spark, f), most)), np.where(want <= most, want, np.nan), 1e-4)
    y, x = map(int, np.argwhere(~np.isnan(want))[-1])
    path = cost.least_cost_path(got, vector.points(spark, [at(y, x), at(9, 9)])).collect()
    ends = {p.feature_id: geometry.parse_wkt(p.wkt)[1][0] for p in path}
    last = ends[0][-1]
    assert (round((last[0] + 180) / r), round((90 - last[1]) / r)) in [(9, 9), (20, 3)]
    assert float(path[0].attrs["COST_S"]) == pytest.approx(want[y, x], rel=1e-4) or float(path[1].attrs["COST_S"]) == pytest.approx(want[y, x], rel=1e-4)
    assert {p.feature_id: p.attrs["DISTANCE_M"] for p in path}[1] == "0"


def test_directional_friction(spark):
    one = raster(spark, np.ones((SIDE, SIDE)))
    eight = local.band_combine(*[one] * 8)
    r = grid.resolution(3, TS)
    start = vector.points(spark, [(-180 + 4.5 * r, 90 - 4.5 * r)])
    same(values(cost.cost_distance(start, eight)), values(cost.cost_distance(start, one)), 1e-4)


def test_rasterize(spark):
    r = grid.resolution(3, TS)
    box = f"POLYGON (({-180 + 2 * r} {90 - 10 * r}, {-180 + 12 * r} {90 - 10 * r}, {-180 + 12 * r} {90 - 2 * r}, {-180 + 2 * r} {90 - 2 * r}, {-180 + 2 * r} {90 - 10 * r}))"
    f = spark.createDataFrame([(0, box, {"v": "3"}), (1, box, {"v": "4"}), (2, None, {}), (3, "POLYGON ((broken", {})], vector.FEATURES)
    want = np.full((SIDE, SIDE), np.nan)
    want[2:10, 2:12] = 7
    same(values(vector.rasterize_vector(f, "SUM", "3z", "v", tilesize=TS)), want)
    line = spark.createDataFrame([(0, f"LINESTRING ({-180 + 0.5 * r} {90 - 0.5 * r}, {-180 + 15.5 * r} {90 - 0.5 * r})", {})], vector.FEATURES)
    assert np.argwhere(values(vector.rasterize_vector(line, "MASK2", "3z", tilesize=TS)) == 1).tolist() == [[0, k] for k in range(16)]
    assert len(vector.rasterize_vector(line, "MASK2", "3z", None, "3p", tilesize=TS).cells().collect()) > 16
    with pytest.raises(ValueError):
        vector.rasterize_vector(line, "GAUSSIAN", "3z")
    with pytest.raises(ValueError):
        vector.rasterize_points(line, "MASK", "3z", "v")
    assert vector.cell_size("12z", 512) == 12 and vector.cell_size("30m", 512) == grid.zoom_for_pixel_size(30 / grid.METERS_PER_DEGREE, 512)


def test_parser(spark):
    assert statements("a = 1; b = 2 # c\nf(1,\n 2)") == ["a = 1", "b = 2", "f(1,  2)"]
    x = raster(spark, fixture(0.0))
    a = fixture(0.0)
    run = Engine(spark, x=x, x2=x).run
    same(values(run("-[x] + 2 * [x] - 3 - 1")), a - 4)
    same(values(run("CON([x] >= 10 && !([x] gt 20), 1, 0)")), ((a >= 10) & (a <= 20)).astype(float))
    same(values(run("y = [x] ** 2\ny / [x]")), a, 1e-4)
    same(values(run('statistics("sum", "x*")')), 2 * a)
    same(values(run("2 * (3 + 4) & 6 | 1 + [x] * 0")), np.full_like(a, (14 & 6) | 1))
    assert run("1 + 2 * 3") == 7
    for bad in ["", "[x] +", "nosuch([x])", "y + 1", "sin = 3", "f('a", "[x] ? 1", "([x]"]:
        with pytest.raises(ParseError):
            run(bad)
    with pytest.raises(ParseError):
        run("[missing] + 1")
    assert parse("a = nan; a") and lookup("BandCombine") and "lcp" in names()

    @mapop("twice")
    def twice(r):
        return r * 2

    same(values(run("twice([x])")), 2 * a)
    same(values(x.twice()), 2 * a)


def test_every_name_is_registered():
    want = """add + minus - rminus mult * div / rdiv pow ** rpow && and || or xor == eq != <> ne > gt >= ge gte < lt <= le lte & | ^ abs uminus ~ ! sin cos tan log isnodata isnull
    isnodatabounds isnullbounds con bandcombine bc bandextract extract be convert changeclassification normalize crop cropexact fill fillbounds mosaic focalstat tpi kernel slope aspect slope8
    directionalslope dirslope statistics stats quantiles buildpyramid bp rasterizevector rasterize rasterizevectorexact rasterizeexact rasterizepoints rasterizepointsexact costdistance cd
    leastcostpath lcp inlinecsv csv ingest export zoom save"""
    assert not [n for n in want.split() if lookup(n) is None]


def test_catalog_cli_and_serving(spark, tmp_path):
    from gridloom.__main__ import main

    a = fixture()
    c = Catalog(spark, str(tmp_path / "cat"))
    c.save(aggregate.build_pyramid(raster(spark, a), "MAX"), "a")
    assert c.rasters() == ["a"] and sorted(c.meta("a")) == [1, 2, 3]
    same(values(c.raster("a")), a)
    m = c.meta("a")[3].stats[0]
    assert m[0] == np.nanmin(a) and m[3] == (~np.isnan(a)).sum()
    same(values(Engine(spark, c).run("zoom([a], 2)"), (12, 12)), aggregators.reduce(a, "MAX"))
    with pytest.raises(ParseError):
        Engine(spark, c).run("zoom([a] + 1, 2)")
    part = c.raster("a", 3, Bounds(-180, 45, -136, 90))
    assert part.tiles().count() == 1 and "PushedFilters: [IsNotNull(tx)" in part.sources[0]._jdf.queryExecution().toString()
    main(["mapalgebra", c.path, "b", "-e", "x = [a] + 1; save(x, 'saved') * 2"], spark)
    same(values(c.raster("b")), (a + 1) * 2)
    assert c.rasters() == ["a", "b", "saved"]
    assert main(["tags", c.path, "b", "-t", "k=v"], spark) == [(("k", "v"),)]
    assert main(["findholes", c.path, "a"], spark) == [] and len(main(["generatekeys", c.path, "a", "-n", "2"], spark)) == 2
    assert serve.pick_zoom([1, 2, 3], Bounds(-180, -90, 180, 90), 16, TS) == 1
    png = serve.get_map(c, "a", Bounds(-180, 0, -90, 90), 20, 10)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (20, 10)
    assert serve.get_tile(c, "a", 3, 0, 3, mask="b", mask_max=50) and serve.get_tile(c, "a", 3, 7, 0) is None
    assert serve.legend(GREY) and serve.describe(c, "a")[3]["bands"] == 1
    c.save(vector.points(spark, [(1, 2)]), "pts")
    assert c.find("pts").count() == 1 and c.find("none") is None


def test_images_round_trip(spark, tmp_path):
    a = fixture()
    r = raster(spark, a)
    data = images.export(r, "In-Memory", single=True)
    bands, b, nodata = images.read_tiff(data)
    assert (b.w, b.n) == (-180.0, 90.0) and np.isnan(nodata)
    same(bands[0][:SIDE, :SIDE], a)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.tif").write_bytes(data)
    same(values(images.ingest(str(tmp_path / "in"), categorical=True, tilesize=TS, spark=spark)), a)
    res = grid.resolution(3, TS)
    text = f"ncols 3\nnrows 2\nxllcorner -180\nyllcorner {90 - 2 * res}\ncellsize {res}\nNODATA_value -9\n1 2 -9\n4 5 6\n"
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2/y.asc").write_text(text)
    got = values(images.ingest(str(tmp_path / "in2"), tilesize=TS, spark=spark))
    same(got[:2, :3], np.array([[1, 2, np.nan], [4, 5, 6]]))
    paths = images.export(r, str(tmp_path / "t-$X-$Y"), format="png", colorscale=ColorScale(((0, (0, 0, 0, 255)), (50, (255, 0, 0, 255)))))
    assert len(paths) == 9 and paths[0].endswith("t-0-1.png")
    raw = open(paths[0], "rb").read()
    at = raw.index(b"IDAT")
    assert len(zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]])) == TS * (1 + 4 * TS)
    assert len(images.export(r, str(tmp_path / "m"), mosaic=2)) == 4 and len(images.export(r, str(tmp_path / "c"), count=2, random=True)) == 2


def shapefile(points):
    body = b"".join(struct.pack(">2i", k + 1, 10) + struct.pack("<i2d", 1, x, y) for k, (x, y) in enumerate(points))
    body += struct.pack(">2i", 9, 2) + struct.pack("<i", 0)
    ring = [(0, 0), (0, 1), (1, 1), (0, 0)]
    poly = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    body += struct.pack(">2i", 10, len(poly) // 2) + poly
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8) + body


def test_vector_sources(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("x\ty\tname\n1\t2\ta\n3\t4\tb\n")
    got = vectors.read_delimited(spark, str(tmp_path / "p.tsv"))
    assert [(r.wkt, r.attrs["name"]) for r in got.orderBy("wkt").collect()] == [("POINT (1.0 2.0)", "a"), ("POINT (3.0 4.0)", "b")]
    vectors.write_delimited(got, str(tmp_path / "out"), ["name"])
    assert vectors.read_delimited(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "s.shp").write_bytes(shapefile([(1.5, 2.5), (3, 4)]))
    dbf = struct.pack("<B3BIHH20x", 3, 0, 0, 0, 4, 65, 6) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15 + b"\r" + b" one   two   nul   tri  "
    (tmp_path / "s.dbf").write_bytes(dbf)
    rows = {r.wkt: r.attrs["NAME"] for r in vectors.read_shapefile(spark, str(tmp_path / "s.shp")).collect()}
    assert rows["POINT (1.5 2.5)"] == "one" and rows["POLYGON ((0.0 0.0, 0.0 1.0, 1.0 1.0, 0.0 0.0))"] == "tri" and len(rows) == 3
    with pytest.raises(ValueError):
        vectors.inline_csv("a,b", "1,2,3", spark)


def test_vector_tiles(spark, tmp_path):
    import sqlite3

    def field(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    feature = bytes([2 << 3 | 2, 2, 0, 0, 3 << 3, 1]) + field(4, bytes([9, 0x80, 0x40, 0x80, 0x40][:1]) + b"\x80\x20\x80\x20")
    layer = field(1, b"roads") + field(2, feature) + field(3, b"k") + field(4, field(1, b"v")) + bytes([5 << 3, 0x80, 0x20, 15 << 3, 2])
    db = sqlite3.connect(tmp_path / "t.mbtiles")
    db.execute("CREATE TABLE tiles (zoom_level, tile_column, tile_row, tile_data)")
    db.execute("INSERT INTO tiles VALUES (1, 0, 1, ?)", (field(3, layer),))
    db.commit()
    db.close()
    r = vectors.read_vector_tiles(spark, str(tmp_path / "t.mbtiles")).first()
    kind, rings = geometry.parse_wkt(r.wkt)
    assert kind == "POINT" and r.attrs == {"layer": "roads", "k": "v"} and rings[0][0] == pytest.approx((-90.0, 66.51326), abs=1e-4)


def test_geometry():
    assert geometry.parse_wkt("POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))") == ("POLYGON", [[(0, 0), (1, 0), (1, 1), (0, 0)]])
    assert not geometry.is_wkt("POINT (1") and not geometry.is_wkt(None) and geometry.is_wkt("POINT EMPTY")
    assert geometry.point_in_rings(0.6, 0.5, [[(0, 0), (1, 0), (1, 1), (0, 0)]])
    assert geometry.segments_cross((0, 0), (2, 2), (0, 2), (2, 0)) and not geometry.segments_cross((0, 0), (1, 0), (0, 1), (1, 1))
    s, w, n, e = geometry.geohash_decode("ezs42")
    assert s < 42.6 < n and w < -5.6 < e and geometry.geohash_adjacent("ezs42", "n") == "ezs48"
    assert geometry.size_string("2k") == 2048 and geometry.size_string("1t") == 1 << 40
    lat, lon = geometry.destination(0, 0, 90, grid.METERS_PER_DEGREE)
    assert abs(lat) < 1e-9 and lon == pytest.approx(1.0)


def test_geohash_column(spark):
    assert spark.range(1).select(geometry.geohash(F.lit(42.6), F.lit(-5.6), 5).alias("g")).first().g == "ezs42"


def test_streaming_mosaic(spark, tmp_path):
    from gridloom.streaming.ingest import merge_cells, versions

    c = Catalog(spark, str(tmp_path / "cat"))
    schema = "gx long, gy long, v double"
    spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], schema).coalesce(1).write.parquet(str(tmp_path / "src"))
    go = lambda: merge_cells(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), c, "r", META, str(tmp_path / "ck"), {"availableNow": True}).awaitTermination()
    go()
    spark.createDataFrame([(0, 0, 9.0), (2, 0, 3.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    go()
    v = versions(c, "r")
    assert len(v) == 2 and values(c.raster(f"r@{v[-1]}"))[0, :3].tolist() == [1.0, 2.0, 3.0]


def test_entry_imports():
    import __spark_entry__ as e

    assert len(e.queries()) > 90 and set(e.oracle_sql()) <= set(e.queries())


def test_geohashes_equal_bisection(spark):
    def bisected(lat, lon, length):
        lo, hi, out = [-180.0, -90.0], [180.0, 90.0], ""
        for c in range(length):
            v = 0
            for k in range(5):
                a = (5 * c + k) % 2
                mid = (lo[a] + hi[a]) / 2
                up = (lon, lat)[a] >= mid
                (lo if up else hi)[a] = mid
                v = 2 * v + up
            out += "0123456789bcdefghjkmnpqrstuvwxyz"[v]
        return out

    at = [(57.64911, 10.40744), (42.6, -5.6), (-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (-0.1, 179.99)] + [((u * 17) % 180 - 90.0, (e * 37) % 360 - 180.0) for u, e in ((k * 7 % 101, k) for k in range(300))]
    df = spark.createDataFrame(at, "lat double, lon double")
    for length in (1, 5, 8, 11):
        got = df.select("lat", "lon", geometry.geohash(F.col("lat"), F.col("lon"), length).alias("g")).collect()
        assert [r.g for r in got] == [bisected(r.lat, r.lon, length) for r in got]
    assert bisected(57.64911, 10.40744, 11) == "u4pruydqqvj"


def test_projections_known_points_and_round_trips():
    from gridloom.functions import projections as P

    x, y = P.of_code(32631).forward(2.2945, 48.8582)
    assert abs(x - 448251.8) < 0.2 and abs(y - 5411932.7) < 0.2
    x, y = P.of_code(3857).forward(90.0, 85.05112877980659)
    assert abs(x - 10018754.171395) < 1e-3 and abs(y - 20037508.342789) < 1e-3
    text = 'PROJCS["RGF93",GEOGCS["g",DATUM["d",SPHEROID["GRS 1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",700000.0],PARAMETER["False_Northing",6600000.0],PARAMETER["Central_Meridian",3.0],PARAMETER["Standard_Parallel_1",44.0],PARAMETER["Standard_Parallel_2",49.0],PARAMETER["Latitude_Of_Origin",46.5],UNIT["Meter",1.0]]'
    lambert = P.of_wkt(text)
    x, y = lambert.forward(2.3522, 48.8566)
    assert abs(x - 652469.0) < 0.5 and abs(y - 6862035.3) < 0.5
    feet = P.of_wkt(text.replace('UNIT["Meter",1.0]', 'UNIT["Foot_US",0.3048006096012192]'))
    assert feet.unit == 0.3048006096012192 and np.allclose(feet.inverse(*feet.forward(2.0, 47.0)), (2.0, 47.0))
    rng = np.random.default_rng(1)
    for p, lon, lat in [(P.of_code(32733), (12, 18), (-70, -1)), (P.of_code(3857), (-179, 179), (-80, 80)), (lambert, (-4, 9), (41, 51)), (P.Projection("albers", lon0=-96, lat0=23, lat1=29.5, lat2=45.5), (-120, -70), (25, 48)), (P.Projection("albers", lon0=132, lat0=0, lat1=-18, lat2=-36), (115, 150), (-40, -12))]:
        a, b = rng.uniform(*lon, 40), rng.uniform(*lat, 40)
        c, d = p.inverse(*p.forward(a, b))
        assert np.abs(c - a).max() < 1e-9 and np.abs(d - b).max() < 1e-9
    assert P.of_wkt('GEOGCS["GCS_WGS_1984"]') is P.DEGREES
    with pytest.raises(ValueError):
        P.of_code(2056)


def test_geometry_clips_meets_and_mends():
    from gridloom.functions import geometry as G
    from gridloom.grid import Bounds

    box = Bounds(0, 0, 10, 10)
    ring = [(-5.0, 2.0), (5.0, 2.0), (5.0, 8.0), (-5.0, 8.0), (-5.0, 2.0)]
    kind, rings = G.clip("POLYGON", [ring], box)
    rng = np.random.default_rng(2)
    for x, y in rng.uniform(0, 10, (300, 2)):
        assert G.point_in_rings(x, y, rings) == G.point_in_rings(x, y, [ring])
    star = [(5 + (9 if k % 2 else 3) * math.cos(k), 5 + (9 if k % 2 else 3) * math.sin(k)) for k in range(0, 44)]
    cut = G.clip("POLYGON", [star + star[:1]], box)[1]
    assert all(G.point_in_rings(x, y, cut) == G.point_in_rings(x, y, [star]) for x, y in rng.uniform(0.01, 9.99, (500, 2)))
    assert G.clip("LINESTRING", [[(-1.0, 5.0), (3.0, 5.0), (3.0, 20.0), (6.0, 20.0), (6.0, 9.0)]], box) == ("MULTILINESTRING", [[(0.0, 5.0), (3.0, 5.0), (3.0, 10.0)], [(6.0, 10.0), (6.0, 9.0)]])
    assert G.clip("POLYGON", [[(20.0, 20.0), (30.0, 20.0), (30.0, 30.0), (20.0, 20.0)]], box)[1] == []
    square = ("POLYGON", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]])
    for other, want in [(("POINT", [[(2.0, 2.0)]]), True), (("POINT", [[(9.0, 2.0)]]), False), (("LINESTRING", [[(-1.0, 2.0), (9.0, 3.0)]]), True), (("LINESTRING", [[(5.0, 0.0), (5.0, 9.0)]]), False), (("POLYGON", [[(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0), (-9.0, -9.0)]]), True)]:
        assert G.intersects(square, other) == G.intersects(other, square) == want
    assert G.intersects(("POINT", [[(1.0, 1.0)]]), ("LINESTRING", [[(0.0, 0.0), (2.0, 2.0)]])) and not G.intersects(("POINT", [[(1.0, 1.1)]]), ("LINESTRING", [[(0.0, 0.0), (2.0, 2.0)]]))
    assert G.colinear((0, 0), (1, 1), (5, 5)) and not G.colinear((0, 0), (1, 1), (5, 5.1))
    assert G.distance((0, 3), (-1, 0), (1, 0)) == 3 and G.distance((5, 0), (-1, 0), (1, 0)) == 4 and G.distance((0, 3), (4, 0)) == 5
    assert G.fix_wkt("polygon((0 0, 4 0, 4 0, 4 4") == "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0))"
    assert G.fix_wkt("no geometry") is None and G.fix_wkt(None) is None and G.fix_wkt("POINT (1 2)") == "POINT (1.0 2.0)"


def test_ingest_of_projected_images_and_categories(spark, tmp_path):
    """A plane in UTM coordinates comes out as the plane at each cell's place; sides that disagree are refused."""
    import struct as st

    from gridloom import grid
    from gridloom.functions import projections as P
    from gridloom.grid import Bounds
    from gridloom.sources import images

    (tmp_path / "in").mkdir()
    p = P.of_code(32633)
    b = Bounds(300_000.0, 5_000_000.0, 500_000.0, 5_200_000.0)
    n = 200
    x, y = b.w + (np.arange(n) + 0.5) * 1000, b.n - (np.arange(n) + 0.5) * 1000
    plane = x[None, :] / 1000 + y[:, None] / 10000
    data = images.write_tiff([plane], b, -1.0)
    degrees = st.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    assert degrees in data
    data = data.replace(degrees, st.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, 32633))
    (tmp_path / "in" / "a.tif").write_bytes(data)
    r = images.ingest(str(tmp_path / "in"), 8, tilesize=32, spark=spark)
    rows = r.cells().collect()
    size = grid.resolution(8, 32)
    lon, lat = np.array([-180 + (v.gx + 0.5) * size for v in rows]), np.array([90 - (v.gy + 0.5) * size for v in rows])
    ex, ny = p.forward(lon, lat)
    inside = (ex > b.w + 1000) & (ex < b.e - 1000) & (ny > b.s + 1000) & (ny < b.n - 1000)
    got = np.array([v.v for v in rows])
    assert inside.sum() > 100 and np.abs(got - (ex / 1000 + ny / 10000))[inside].max() < 0.05
    assert ((ex >= b.w) & (ex <= b.e) & (ny >= b.s) & (ny <= b.n)).all() and r.meta.nodata == (-1.0,)
    with pytest.raises(ValueError):
        images.ingest(str(tmp_path / "in"), skip_preprocessing=True, spark=spark)
    assert images.ingest(str(tmp_path / "in"), 8, skip_preprocessing=True, tilesize=32, spark=spark).cells().count() == len(rows)
    for k, names in enumerate((["a", "b"], ["a", "c"])):
        (tmp_path / "in" / f"{k}.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\n1 2 3 4\n")
        (tmp_path / "in" / f"{k}.asc.aux.xml").write_text('<PAMDataset><PAMRasterBand band="1"><CategoryNames>' + "".join(f"<Category>{x}</Category>" for x in names) + "</CategoryNames></PAMRasterBand></PAMDataset>")
    (tmp_path / "in" / "a.tif").unlink()
    with pytest.raises(ValueError, match="different categories"):
        images.ingest(str(tmp_path / "in"), categorical=True, tilesize=32, spark=spark)
    assert images.ingest(str(tmp_path / "in"), categorical=True, skip_categories=True, tilesize=32, spark=spark).meta.categories == ()
    (tmp_path / "in" / "1.asc").unlink()
    (tmp_path / "in" / "1.asc.aux.xml").unlink()
    assert images.ingest(str(tmp_path / "in"), categorical=True, tilesize=32, protection="A&(B|C)", spark=spark).meta.categories == ((1, ("a", "b")),)
    with pytest.raises(ValueError, match="protection"):
        images.ingest(str(tmp_path / "in"), protection="A&(B;", tilesize=32, spark=spark)


def test_jpeg_is_read_back(spark):
    """Java's reader sees about what was written."""
    from gridloom.sources import images

    y, x = np.mgrid[0:45, 0:70]
    red, green, blue = 120 + 100 * np.sin(x / 9), 3.0 * y, 255.0 - 3 * x
    for bands in ([red], [red, green, blue], [red, green, blue, red * 0 + 255]):
        data = images.write_jpeg(bands)
        jvm = spark._jvm
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
        assert (image.getWidth(), image.getHeight()) == (70, 45)
        cells = image.getRaster()
        for k, want in enumerate(bands[:3]):
            got = np.array([[cells.getSample(i, j, k) for i in range(0, 70, 7)] for j in range(0, 45, 7)])
            assert np.abs(got - np.clip(want, 0, 255)[::7, ::7]).max() < 14


def test_export_levels_sizes_and_formats(spark, tmp_path):
    from gridloom.sources import images

    rng = np.random.default_rng(3)
    r = from_array(spark, rng.uniform(0, 200, (64, 128)))
    whole = images.read_tiff(images.export(r, "In-Memory", single=True))[0][0]
    half = images.read_tiff(images.export(r, "In-Memory", single=True, zoom=r.meta.zoom - 1))[0][0]
    assert half.shape == (whole.shape[0] // 2, whole.shape[1] // 2) and np.allclose(half, whole.reshape(half.shape[0], 2, half.shape[1], 2).mean((1, 3)), atol=1e-3)
    assert images.read_tiff(images.export(r, "In-Memory", max_size=f"{whole.size * 4 - 1}b"))[0][0].shape == half.shape
    paths = images.export(r, str(tmp_path / "l"), single=True, all_levels=True, format="jpg")
    assert len(paths) == r.meta.zoom and all(open(p, "rb").read(2) == b"\xff\xd8" for p in paths)
    with pytest.raises(ValueError):
        images.export(r, str(tmp_path / "x"), zoom=r.meta.zoom + 1)
    with pytest.raises(ValueError):
        images.export(r, str(tmp_path / "x"), max_size="1m")
    with pytest.raises(ValueError):
        images.export(r, str(tmp_path / "x"), format="gif")


def from_array(spark, a):
    """A raster of the whole grid at zoom 3 with tiles of 16 cells."""
    from gridloom.grid import Bounds
    from gridloom.meta import RasterMeta
    from gridloom.raster import from_cells

    rows = [(int(x), int(y), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return from_cells(spark.createDataFrame(rows, "gx long, gy long, v double"), RasterMeta(3, 16, 1, "float", (), Bounds()))


def test_versions_statistics_and_commands(spark, tmp_path):
    import json as js

    from gridloom.__main__ import main
    from gridloom.functions.colors import ColorScale
    from gridloom.grid import Bounds
    from gridloom.operators import aggregate, vector
    from gridloom.plans import serve
    from gridloom.sources import images
    from gridloom.sources.catalog import Catalog

    c = Catalog(spark, str(tmp_path / "cat"))
    a = np.arange(64 * 128, dtype=float).reshape(64, 128)
    r = from_array(spark, a)
    first = c.save(r, "a")
    again = c.save(r + 1, "a")
    assert first.cells().agg({"v": "min"}).first()[0] == 0 and again.cells().agg({"v": "min"}).first()[0] == 1  # a reader of the version before goes on
    c.save(r, "a")
    assert len(c._versions("a")) == 2 and len(list((tmp_path / "cat/rasters/a/tiles/zoom=3").iterdir())) == 2
    assert main(["quantiles", c.path, "a", "-n", "4"], spark) == [(0, k, float(-(-k * a.size // 4))) for k in (1, 2, 3)]
    assert c.meta("a")[3].quantiles == ((2048.0, 4096.0, 6144.0),)
    assert main(["calcstats", c.path, "a"], spark)[3][0][:2] == (0.0, 8191.0) and c.meta("a")[3].quantiles
    assert sum(x[3] for x in main(["printsplits", c.path, "a"], spark)) == 32
    assert "spark.master" in main(["showconf", c.path], spark) and main(["cleancache", c.path, "--older", "9999"], spark) == []
    scale = ColorScale(((0.0, (0, 0, 0, 255)), (1.0, (100, 0, 0, 255)), (2.0, (200, 0, 0, 255))), "Quantile")
    (tmp_path / "s.json").write_text(scale.to_json())
    assert main(["colorscale", c.path, "mine", "-i", str(tmp_path / "s.json")], spark) == ["mine"] and c.color_scale("mine") == scale
    c.save(vector.points(spark, [(1.0, 2.0), (-3.0, 7.5)]), "p")
    assert main(["vectorinfo", c.path, "p"], spark)["bounds"] == [-3.0, 2.0, 1.0, 7.5]
    c.save(aggregate.build_pyramid(c.raster("a"), "MEAN"), "a")
    # services: values, images of several rasters, tiles
    world = Bounds()
    got = images.read_tiff(serve.get_coverage(c, "a", world, 128, 64))
    assert np.array_equal(got[0][0], a) and got[1] == world and serve.describe_coverage(c, "a")["width"] == 128
    c.save(r, "fine")
    small = images.read_tiff(serve.get_coverage(c, "fine", world, 32, 16))[0][0]
    assert np.allclose(small, a.reshape(16, 4, 32, 4).mean((1, 3)), rtol=1e-4)
    assert serve.get_map(c, "a", world, 20, 10, scale)[:4] == b"\x89PNG" and serve.get_map(c, "a", world, 20, 10, format="jpg")[:2] == b"\xff\xd8"
    half = local_crop(r, Bounds(-180, -90, 0, 90))
    c.save(half, "west")
    assert serve.get_mosaic(c, ["west", "a"], world, 64, 32)[:4] == b"\x89PNG"
    assert len(serve.describe_tiles(c, "a", 3)) == 32 and set(serve.coverages(c)) == {"a", "fine", "west"}
    assert js.loads(scale.to_json())["scaling"] == "Quantile"
    reader = serve.TileReader(c, "a", 3, most=2)
    for tx, ty in ((0, 3), (7, 0), (0, 3), (3, 2)):
        assert np.array_equal(reader.get(tx, ty)[0], a[(3 - ty) * 16 : (4 - ty) * 16, tx * 16 : (tx + 1) * 16])
    assert serve.TileReader(c, "west", 3).get(7, 0) is None and len(reader._held) == 2
    assert [t for t, _ in reader.scan(5, 9)] == [5, 6, 7, 8, 9] and "<north>90.0</north>" in serve.kml("a & b", world, "x.png")


def local_crop(r, b):
    from gridloom.operators import local

    return local.crop(r, b)


def test_large_features_are_cut_and_painted_the_same(spark, monkeypatch):
    from gridloom.operators import vector

    rows = [(1, "POLYGON ((-170 -80, 170 -70, 100 80, -160 60, -170 -80), (-50 -30, 60 -20, 10 40, -50 -30))", {"v": "3"}), (2, "LINESTRING (-179 -89, 0 0, 100 70, 179 -60)", {"v": "5"}), (3, "MULTIPOLYGON (((0 0, 60 0, 60 60, 0 60, 0 0)), ((-90 10, -30 10, -30 70, -90 10)))", {"v": "7"}), (4, "POINT (10 20)", {"v": "1"})]
    f = spark.createDataFrame(rows, vector.FEATURES)
    out = []
    for split, part in ((1000, 16), (1, 3), (1, 1)):
        monkeypatch.setattr(vector, "SPLIT", split)
        monkeypatch.setattr(vector, "PART", part)
        for width in (None, "300000m"):
            got = vector.rasterize_vector(f, "SUM", "4z", "v", width=width, tilesize=16).cells().select("gx", "gy", "v").collect()
            out.append(sorted(map(tuple, got)))
    assert out[0] and out[0] == out[2] == out[4] and out[1] and out[1] == out[3] == out[5]


def test_readers_of_features_and_weights(spark, tmp_path):
    from gridloom.functions.aggregators import weighted_mean
    from gridloom.grid import Bounds
    from gridloom.operators import focal, vector
    from gridloom.sources import vectors

    (tmp_path / "f.tsv").write_text("GEOMETRY\tname\n" + "".join(f"POINT ({k} {k})\tn{k}\n" for k in range(50)))
    f = vectors.read_delimited(spark, str(tmp_path / "f.tsv"), least=10).cache()
    assert f.rdd.getNumPartitions() == 5 and f.count() == 50 and vectors.feature_bounds(f) == Bounds(0, 0, 49, 49)
    assert vectors.by_bounds(f, Bounds(9.5, 0, 20, 20)).count() == 11 and vectors.feature_bounds(f.limit(0)) is None
    one = f.select("feature_id").first()[0]
    assert vectors.by_id(f, one).count() == 1
    a = np.random.default_rng(4).uniform(0, 9, (64, 128))
    k = np.array([[0, 1, 0], [2, 3, 4], [0, 5, 0]])
    got = np.full((64, 128), np.nan)
    for r in focal.weighted(from_array(spark, a), k).cells().collect():
        got[r.gy, r.gx] = r.v
    p = np.pad(a, 1)
    want = sum(k[y, x] * p[y : y + 64, x : x + 128] for y in range(3) for x in range(3)) / k.sum()
    assert np.allclose(got, want, rtol=1e-5)
    assert weighted_mean([0, 10, 20, 30], 0.25, 0.5) == 12.5 and weighted_mean([0, float("nan"), 20, 30], 1.0, 0.5) == 30
    g = {(r.gx, r.gy): r.v for r in vector.paint_gaussian(vector.points(spark, [(0.0, 0.0), (0.0, 0.0)]), 5.0, 2.8125, tilesize=16).cells().collect()}
    assert abs(g[64, 32] - 2 * math.exp(-2 * (2.8125 / 2) ** 2 / 50)) < 1e-9 and (70, 32) not in g


def test_shapefiles_with_a_projection(spark, tmp_path):
    import struct as st

    from gridloom.functions import projections as P
    from gridloom.sources import vectors

    p = P.of_code(32633)
    x, y = (float(v) for v in p.forward(15.5, 47.0))
    record = st.pack("<i2d", 1, x, y)
    body = st.pack(">2i", 1, len(record) // 2) + record
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + body)
    assert not vectors.read_shapefile(spark, str(tmp_path / "a.shp")).first().wkt.startswith("POINT (15.")
    (tmp_path / "a.prj").write_text('PROJCS["WGS 84 / UTM zone 33N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",15],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1]]')
    from gridloom.functions.geometry import parse_wkt

    (lon, lat) = parse_wkt(vectors.read_shapefile(spark, str(tmp_path / "a.shp")).first().wkt)[1][0][0]
    assert abs(lon - 15.5) < 1e-9 and abs(lat - 47.0) < 1e-9
