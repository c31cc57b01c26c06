"""Feature sources: inline tables, delimited files, shapefiles, databases and SQLite vector tiles."""

from __future__ import annotations

import csv
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projections
from ..functions.geometry import parse_wkt, to_wkt
from ..grid import Bounds
from ..operators.vector import FEATURES
from ..runtime import ship

_X, _Y, _GEOMETRY = ("x", "lon", "longitude"), ("y", "lat", "latitude"), ("geometry", "geom", "wkt")


def features(df: DataFrame) -> DataFrame:
    """(feature_id, wkt, attrs) from columns: a geometry column of WKT, or x and y."""
    low = {c.lower(): c for c in df.columns}
    geometry = next((low[c] for c in _GEOMETRY if c in low), None)
    x, y = next((low[c] for c in _X if c in low), None), next((low[c] for c in _Y if c in low), None)
    if geometry:
        wkt, own = F.col(geometry), {geometry}
    elif x and y:
        wkt, own = F.concat(F.lit("POINT ("), F.col(x).cast("double").cast("string"), F.lit(" "), F.col(y).cast("double").cast("string"), F.lit(")")), {x, y}
    else:
        raise ValueError("no geometry column and no x and y columns")
    rest = [c for c in df.columns if c not in own]
    attrs = F.create_map(*[z for c in rest for z in (F.lit(c), F.col(c).cast("string"))]).cast("map<string,string>") if rest else F.create_map().cast("map<string,string>")
    return df.select(F.monotonically_increasing_id().alias("feature_id"), wkt.alias("wkt"), attrs.alias("attrs"))


def inline_csv(columns: str, rows: str, spark: SparkSession | None = None) -> DataFrame:
    """A literal table: names split by commas, records by semicolons, quotes by apostrophes."""
    spark = spark or SparkSession.active()
    read = lambda s: next(csv.reader(io.StringIO(s.strip()), quotechar="'", skipinitialspace=True))
    names = [c.strip() for c in read(columns)]
    data = [read(r) for r in rows.split(";") if r.strip()]
    if any(len(r) != len(names) for r in data):
        raise ValueError("a record has another number of values than there are columns")
    return features(spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in names)))


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str | None = None, least: int = 0) -> DataFrame:
    """CSV or TSV by ending; without column names the first line has them. A file split is a task, or, with `least`,
    so many features at least, dealt out anew."""
    sep = sep or ("," if path.endswith(".csv") else "\t")
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
    df = reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else reader.option("header", True).csv(path)
    if least > 0:
        df = df.repartition(max(1, df.count() // least))
    return features(df)


def feature_bounds(f: DataFrame) -> Bounds | None:
    """The union of all geometries' bounds; one row a task leaves Python, and one reaches the driver."""
    ship(f.sparkSession)

    def go(batches):
        out = [np.inf, np.inf, -np.inf, -np.inf]
        for b in batches:
            for wkt in b.column(0).to_pylist():
                try:
                    pts = [p for ring in parse_wkt(wkt)[1] for p in ring] if wkt else []
                except ValueError:
                    pts = []
                for x, y in pts:
                    out = [min(out[0], x), min(out[1], y), max(out[2], x), max(out[3], y)]
        if out[0] <= out[2]:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], ["w", "s", "e", "n"])

    got = f.select("wkt").mapInArrow(go, "w double, s double, e double, n double").agg(F.min("w"), F.min("s"), F.max("e"), F.max("n")).first()
    return None if got[0] is None else Bounds(*got)


def by_id(f: DataFrame, *ids: int) -> DataFrame:
    return f.where(F.col("feature_id").isin(list(ids)))


def by_bounds(f: DataFrame, bounds: Bounds) -> DataFrame:
    """Features that share a point with the bounds."""
    from ..functions.geometry import intersects

    ship(f.sparkSession)
    b = bounds
    box = ("POLYGON", [[(b.w, b.s), (b.e, b.s), (b.e, b.n), (b.w, b.n), (b.w, b.s)]])

    def meets(wkt) -> bool:
        try:
            kind, rings = parse_wkt(wkt or "")
        except ValueError:
            return False
        # the box holds its own sides
        return any(b.w <= x <= b.e and b.s <= y <= b.n for r in rings for x, y in r) or intersects((kind, rings), box)

    def go(batches):
        for t in batches:
            yield t.filter(pa.array([meets(x) for x in t.column(t.schema.get_field_index("wkt")).to_pylist()], pa.bool_()))

    return f.mapInArrow(go, f.schema)


def write_delimited(f: DataFrame, path: str, names: list[str], sep: str = "\t") -> None:
    """One file a task; nothing is collected."""
    f.select(*(F.col("attrs")[n].alias(n) for n in names), F.col("wkt").alias("GEOMETRY")).write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, geometry: str = "wkt", key: str | None = None, rows: int = 10_000, **options: str) -> DataFrame:
    """A query's rows; with a numeric key column, read in ranges of about `rows` of them."""
    r = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return features(r.option("query", query).load().withColumnRenamed(geometry, "wkt"))
    low, high, n = r.option("query", f"SELECT min({key}) AS a, max({key}) AS b, count(*) AS c FROM ({query}) q").load().first()
    parts = max(1, -(-n // rows))
    return features(r.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", low or 0).option("upperBound", (high or 0) + 1).option("numPartitions", parts).load().withColumnRenamed(geometry, "wkt"))


def parse_shp(data: bytes) -> list[tuple[str, list[list[tuple[float, float]]]] | None]:
    """Geometries of a .shp file by record; None for null shapes. Types with Z and M lose those values."""
    out, at = [], 100
    while at + 12 <= len(data):
        (size,) = struct.unpack(">i", data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + 2 * size]
        (kind,) = struct.unpack("<i", body[:4])
        k = kind % 10
        if k == 1:
            out.append(("POINT", [[struct.unpack("<2d", body[4:20])]]))
        elif k in (3, 5):
            parts, n = struct.unpack("<2i", body[36:44])
            first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            pts = list(zip(xy[::2], xy[1::2]))
            rings = [pts[a:z] for a, z in zip(first, first[1:])]
            out.append(("POLYGON" if k == 5 else "LINESTRING" if parts == 1 else "MULTILINESTRING", rings))
        elif k == 8:
            (n,) = struct.unpack("<i", body[36:40])
            xy = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
            out.append(("MULTIPOINT", [list(zip(xy[::2], xy[1::2]))]))
        else:
            out.append(None)
        at += 8 + 2 * size
    return out


def parse_dbf(data: bytes) -> list[dict[str, str]]:
    """Records of a dBase file as strings; deleted ones are kept so that rows match shapes."""
    n, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        row, p = {}, head + k * width + 1
        for name, size in fields:
            row[name] = data[p : p + size].decode("latin-1").strip()
            p += size
        out.append(row)
    return out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """.shp files (a glob, too) with their .dbf, in degrees: coordinates are reprojected where a .prj says so. A file is
    a task, as its records have no index of their own."""
    ship(spark)
    side = lambda ending, name: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(_beside(path)).select(F.regexp_replace("path", r"(?i)\." + ending + "$", "").alias("base"), F.col("content").alias(name))
    shp = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"\.[sS][hH][pP]$", "").alias("base"), F.col("content").alias("shp"))

    def go(batches):
        for b in batches:
            wkt, attrs = [], []
            for s, d, j in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows = parse_dbf(d) if d else []
                p = projections.of_wkt(j.decode("utf-8", "replace")) if j else projections.DEGREES
                for k, g in enumerate(parse_shp(s)):
                    if g:
                        kind, rings = g
                        if p is not projections.DEGREES:
                            rings = [list(zip(*(v.tolist() for v in p.inverse(*np.array(r).T)))) for r in rings]
                        wkt.append(to_wkt(kind, rings))
                        attrs.append(list((rows[k] if k < len(rows) else {}).items()))
            yield pa.RecordBatch.from_arrays([pa.array(wkt, pa.string()), pa.array(attrs, pa.map_(pa.string(), pa.string()))], ["wkt", "attrs"])

    out = shp.join(side("dbf", "dbf"), "base", "left").join(side("prj", "prj"), "base", "left").select("shp", "dbf", "prj").mapInArrow(go, "wkt string, attrs map<string,string>")
    return out.select(F.monotonically_increasing_id().alias("feature_id"), "wkt", "attrs").select(*[x.split()[0] for x in FEATURES.split(", ")])


def _beside(path: str) -> str:
    """The folder of a file or of a glob of files."""
    return path.rsplit("/", 1)[0] if "/" in path else "."


def read_vector_tiles(spark: SparkSession, path: str, layers: list[str] | None = None, zoom: int | None = None) -> DataFrame:
    """Features of an SQLite file of Mapbox vector tiles, by (layer, geometry in degrees); ranges of rowids are tasks."""
    import sqlite3

    from .mvt import decode_tile

    ship(spark)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        z = zoom if zoom is not None else db.execute("SELECT max(zoom_level) FROM tiles").fetchone()[0]
        low, high = db.execute("SELECT min(rowid), max(rowid) FROM tiles").fetchone()
    if low is None:
        return spark.createDataFrame([], FEATURES)

    def go(batches):
        for b in batches:
            for start in b.column(0).to_pylist():
                wkt, attrs = [], []
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    for x, y, data in db.execute("SELECT tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ? AND rowid >= ? AND rowid < ?", (z, start, start + 1000)):
                        for layer, g, a in decode_tile(data, z, x, (1 << z) - 1 - y):
                            if layers is None or layer in layers:
                                wkt.append(to_wkt(*g))
                                attrs.append([("layer", layer), *a.items()])
                yield pa.RecordBatch.from_arrays([pa.array(wkt, pa.string()), pa.array(attrs, pa.map_(pa.string(), pa.string()))], ["wkt", "attrs"])

    out = spark.range(low, high + 1, 1000).mapInArrow(go, "wkt string, attrs map<string,string>")
    return out.select(F.monotonically_increasing_id().alias("feature_id"), "wkt", "attrs")
