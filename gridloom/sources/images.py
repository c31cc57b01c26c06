"""Images in and out: ESRI ASCII grids, PNG, JPEG and TIFF with a world position; export by tile, block, level or whole."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import grid
from ..functions import projections
from ..functions.projections import DEGREES, Projection
from ..grid import Bounds
from ..meta import RasterMeta
from ..raster import TILES, Raster
from ..runtime import ship


def _ascii_header(data: bytes) -> tuple[dict[str, float], int]:
    """The header of an ESRI ASCII grid, and where its cells begin."""
    head, at = {}, 0
    while (m := _ASCII_LINE.match(data, at)) is not None:
        head[m[1].decode().lower()] = float(m[2])
        at = m.end()
    return head, at


_ASCII_LINE = re.compile(rb"\s*([A-Za-z_]+)\s+(\S+)")


def _ascii_bounds(head: dict[str, float]) -> Bounds:
    w, h, d = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    x = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - d / 2
    y = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - d / 2
    return Bounds(x, y, x + w * d, y + h * d)


def read_ascii(data: bytes) -> tuple[np.ndarray, Bounds]:
    """Cells (NaN for nodata) and bounds of an ESRI ASCII grid."""
    head, at = _ascii_header(data)
    w, h = int(head["ncols"]), int(head["nrows"])
    a = np.array(data[at:].split()[: w * h], float).reshape(h, w)
    if "nodata_value" in head:
        a[a == head["nodata_value"]] = np.nan
    return a, _ascii_bounds(head)


def write_tiff(bands: list[np.ndarray], bounds: Bounds | None = None, nodata: float | None = None) -> bytes:
    """Uncompressed little-endian float32 TIFF, with the tags that place it in degrees."""
    h, w = bands[0].shape
    a = np.stack(bands, -1).astype("<f4").tobytes()
    n = len(bands)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, n, [32] * n), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(a)), (284, 3, 1, 1), (339, 3, n, [3] * n)]
    if bounds is not None:
        tags += [(33550, 12, 3, [(bounds.e - bounds.w) / w, (bounds.n - bounds.s) / h, 0.0]), (33922, 12, 6, [0.0, 0.0, 0.0, bounds.w, bounds.n, 0.0]), (34735, 3, 16, [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326])]
    if nodata is not None:
        s = (repr(float(nodata)) if nodata == nodata else "nan").encode() + b"\0"
        tags.append((42113, 2, len(s), s))
    at = 8 + len(a)
    extra_at, extra, rows = at + 2 + 12 * len(tags) + 4, b"", b""
    code = {3: "H", 4: "I", 12: "d"}
    for tag, kind, count, v in tags:
        body = v if isinstance(v, bytes) else struct.pack(f"<{count}{code[kind]}", *(v if isinstance(v, list) else [v]))
        if len(body) > 4:
            rows += struct.pack("<HHII", tag, kind, count, extra_at + len(extra))
            extra += body + b"\0" * (len(body) % 2)
        else:
            rows += struct.pack("<HHI", tag, kind, count) + body.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + a + struct.pack("<H", len(tags)) + rows + struct.pack("<I", 0) + extra


def _tags(data: bytes) -> tuple[str, dict]:
    """Byte order and tags of a TIFF."""
    e = "<" if data[:2] == b"II" else ">"
    if data[2:4] not in (b"*\0", b"\0*"):
        raise ValueError("not a TIFF")
    (at,) = struct.unpack(e + "I", data[4:8])
    (n,) = struct.unpack(e + "H", data[at : at + 2])
    size, code = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}, {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
    t: dict = {}
    for k in range(n):
        p = at + 2 + 12 * k
        tag, kind, count = struct.unpack(e + "HHI", data[p : p + 8])
        where = p + 8 if size.get(kind, 1) * count <= 4 else struct.unpack(e + "I", data[p + 8 : p + 12])[0]
        body = data[where : where + size.get(kind, 1) * count]
        t[tag] = body if kind == 2 else struct.unpack(f"{e}{count}{code[kind]}", body) if kind in code else ()
    return e, t


def _tiff_place(t: dict) -> tuple[Bounds | None, float | None]:
    nodata = float(t[42113].split(b"\0")[0]) if 42113 in t else None
    if 33550 not in t or 33922 not in t:
        return None, nodata
    w, h, (sx, sy) = t[256][0], t[257][0], t[33550][:2]
    x, y = t[33922][3] - t[33922][0] * sx, t[33922][4] + t[33922][1] * sy
    return Bounds(x, y - h * sy, x + w * sx, y), nodata


def _tiff_projection(t: dict) -> Projection:
    """From the geographic keys: the code of a projected system, else degrees."""
    keys = t.get(34735, ())
    own = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    return projections.of_code(own.get(3072, 0)) if own.get(1024) == 1 else DEGREES


def read_tiff(data: bytes) -> tuple[list[np.ndarray], Bounds | None, float | None]:
    """Bands, bounds (in the image's own coordinates) and nodata of an uncompressed or deflated TIFF in strips."""
    e, t = _tags(data)
    w, h, per = t[256][0], t[257][0], t.get(277, (1,))[0]
    if t.get(259, (1,))[0] not in (1, 8, 32946) or 322 in t or t.get(284, (1,))[0] != 1 or t.get(317, (1,))[0] != 1:
        raise ValueError("only strips of plain or deflated pixels are read")
    kind = e + {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}[t.get(339, (1,))[0], t[258][0]]
    strips = [data[a : a + c] for a, c in zip(t[273], t[279])]
    if t.get(259, (1,))[0] != 1:
        strips = [zlib.decompress(s) for s in strips]
    a = np.frombuffer(b"".join(strips), kind)[: w * h * per].reshape(h, w, per).astype(float)
    bounds, nodata = _tiff_place(t)
    return [np.where(a[..., k] == nodata, np.nan, a[..., k]) if nodata is not None else a[..., k] for k in range(per)], bounds, nodata


def write_png(bands: list[np.ndarray]) -> bytes:
    """Grey, colour or colour with opacity from one, three or four bands of 0 to 255."""
    a = np.stack(bands, -1)
    h, w, n = a.shape
    a = np.clip(np.nan_to_num(a), 0, 255).astype(np.uint8)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * n)], 1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _zigzag() -> np.ndarray:
    """The places of an 8 x 8 block along its diagonals, to and fro."""
    return np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def write_jpeg(bands: list[np.ndarray], coarse: int = 2) -> bytes:
    """Baseline JPEG of one band (grey) or three and more (colour; opacity is left out), 0 to 255; nodata as 0.

    coarse: how fast quantisation steps grow with frequency. Codes have fixed lengths: 4 bits for the sizes of means, 8 for
    the runs of other coefficients, so that the tables follow from a rule.
    """
    a = [np.clip(np.nan_to_num(np.asarray(x, float)), 0, 255) for x in bands[: 3 if len(bands) >= 3 else 1]]
    h, w = a[0].shape
    if len(a) == 3:
        r, g, b = a
        a = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    k = np.arange(8)
    turn = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    turn[0] /= np.sqrt(2)
    steps = 1 + coarse * (k[:, None] + k[None, :])
    order = _zigzag()
    runs = [0x00, 0xF0, *((run << 4) | size for run in range(16) for size in range(1, 11))]
    code = {x: f"{i:08b}" for i, x in enumerate(runs)}
    parts = []
    for x in a:
        x = np.pad(x, ((0, -h % 8), (0, -w % 8)), "edge") - 128
        x = x.reshape(x.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        parts.append(np.rint(turn @ x @ turn.T / steps).astype(int).reshape(-1, 64)[:, order])
    bits: list[str] = []

    def number(v: int) -> tuple[int, str]:
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    last = [0] * len(parts)
    for row in range(len(parts[0])):
        for c, p in enumerate(parts):
            block = p[row]
            size, text = number(int(block[0]) - last[c])
            last[c] = int(block[0])
            bits.append(f"{size:04b}{text}")
            before = 0
            for at in np.flatnonzero(block[1:]).tolist():
                run = at - before
                bits.append(code[0xF0] * (run // 16))
                size, text = number(int(block[at + 1]))
                bits.append(code[(run % 16) << 4 | size] + text)
                before = at + 1
            if before < 63:
                bits.append(code[0x00])
    whole = "".join(bits)
    whole += "1" * (-len(whole) % 8)
    body = int(whole, 2).to_bytes(len(whole) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda mark, x: bytes([0xFF, mark]) + struct.pack(">H", len(x) + 2) + x
    n = len(parts)
    lengths = lambda at, many: bytes(many if i == at else 0 for i in range(1, 17))
    return (
        b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + bytes(steps.ravel()[order].tolist()))
        + part(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n)))
        + part(0xC4, b"\0" + lengths(4, 12) + bytes(range(12))) + part(0xC4, b"\x10" + lengths(8, len(runs)) + bytes(runs))
        + part(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\0\x3f\0") + body + b"\xff\xd9"
    )


def _place(name: str, data: bytes) -> tuple[Bounds, Projection, int, int, int, float | None]:
    """Bounds in the image's coordinates, projection, width, height, bands and nodata, without reading its cells."""
    if name.lower().endswith((".tif", ".tiff")):
        _, t = _tags(data)
        b, nodata = _tiff_place(t)
        if b is None:
            raise ValueError(f"{name} has no position")
        return b, _tiff_projection(t), t[256][0], t[257][0], t.get(277, (1,))[0], nodata
    head, _ = _ascii_header(data)
    return _ascii_bounds(head), DEGREES, int(head["ncols"]), int(head["nrows"]), 1, head.get("nodata_value")


def _degrees(b: Bounds, p: Projection) -> Bounds:
    return b if p is DEGREES else Bounds(*p.degree_bounds(b.w, b.s, b.e, b.n))


def _categories(files) -> dict[int, set[tuple[str, ...]]]:
    """Names of categories by band, from the .aux.xml files beside images; all that differ."""
    import xml.etree.ElementTree as xml

    def go(batches):
        for b in batches:
            path, band, names = [], [], []
            for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in xml.fromstring(d).iter("PAMRasterBand"):
                    path.append(p)
                    band.append(int(x.get("band", "1")))
                    names.append([c.text or "" for c in x.iter("Category")])
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(band, pa.int32()), pa.array(names, pa.list_(pa.string()))], ["path", "band", "names"])

    out: dict = {}
    for r in files.mapInArrow(go, "path string, band int, names array<string>").where("size(names) > 0").select("band", "names").distinct().collect():
        out.setdefault(r.band, set()).add(tuple(r.names))
    return out


def ingest(path: str, zoom: float | None = None, skip_preprocessing=False, nodata: float | None = None, categorical=False, skip_categories=False, protection: str = "", tilesize: int = 512, spark: SparkSession | None = None) -> Raster:
    """Images (.asc, .tif; a glob or folder, too) on the zoom's grid of degrees, reprojected where they say so: bilinear,
    or nearest if categorical. An image is read where it is and leaves tiles; tiles of several images are merged tile
    by tile, the first path's cells first. The default zoom is the finest that any image needs; only sizes reach the
    driver. skip_preprocessing: no look at all images before, which needs a zoom; bounds are then the world. nodata:
    instead of the images' own, which is kept as the raster's where all say the same. Of categorical images with names
    of categories (in .aux.xml files beside them) all must have the same ones, unless skip_categories.
    """
    yes = lambda x: x in (True, "true", "True", "TRUE", 1.0)
    spark = spark or SparkSession.active()
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    files = found.where(F.lower("path").rlike(r"\.(asc|tif|tiff)$"))
    nearest = yes(categorical)

    def load(name: str, data: bytes):
        b, p, w, h, n, own = _place(name, data)
        bands = read_tiff(data)[0] if name.lower().endswith((".tif", ".tiff")) else [read_ascii(data)[0]]
        return [np.where(x == nodata, np.nan, x) if nodata is not None else x for x in bands], b, p

    def sizes(batches):
        for t in batches:
            out = []
            for name, d in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                b, p, w, h, n, own = _place(name, d)
                g = _degrees(b, p)
                out.append((g.w, g.s, g.e, g.n, min((g.e - g.w) / w, (g.n - g.s) / h) if p is not DEGREES else (g.e - g.w) / w, n, own))
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.float64()) for c in cols[:5]), pa.array(list(cols[5]), pa.int32()), pa.array(list(cols[6]), pa.float64())], ["w", "s", "e", "n", "d", "bands", "nodata"])

    kinds = "w double, s double, e double, n double, d double, bands int, nodata double"
    if yes(skip_preprocessing):
        if not zoom:
            raise ValueError("without preprocessing a zoom must be given")
        one = files.limit(1).mapInArrow(sizes, kinds).first()
        whole = (-180.0, -90.0, 180.0, 90.0, None, one.bands, one.bands, one.nodata, one.nodata, 0) if one else (None,)
    else:
        whole = files.mapInArrow(sizes, kinds).agg(F.min("w"), F.min("s"), F.max("e"), F.max("n"), F.min("d"), F.max("bands"), F.min("bands"), F.min("nodata"), F.max("nodata"), F.count_if(F.col("nodata").isNull())).first()
    if whole[0] is None:
        raise FileNotFoundError(path)
    if whole[5] != whole[6]:
        raise ValueError("images have different numbers of bands")
    nb = whole[5]
    names: dict = {}
    if nearest and not yes(skip_categories):
        aux = found.where(F.lower("path").endswith(".aux.xml"))
        names = _categories(aux)
        if any(len(x) > 1 for x in names.values()):
            raise ValueError("images have different categories: " + "; ".join(f"band {b}: {sorted(x)}" for b, x in sorted(names.items()) if len(x) > 1))
    z = int(zoom) if zoom else grid.zoom_for_pixel_size(whole[4], tilesize)
    r, ts = grid.resolution(z, tilesize), tilesize

    def tiles(batches):
        from ..operators.tiling import to_arrow

        for t in batches:
            for name, d in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                bands, b, p = load(name, d)
                h, w = bands[0].shape
                own = grid.bounds_to_tiles(_degrees(b, p), z, ts)
                for ty in range(own.s, own.n + 1):
                    for tx in range(own.w, own.e + 1):
                        at = grid.tile_bounds(tx, ty, z, ts)
                        lon, lat = at.w + (np.arange(ts) + 0.5) * r, at.n - (np.arange(ts) + 0.5) * r
                        if p is DEGREES:
                            x, y = np.broadcast_to(lon, (ts, ts)), np.broadcast_to(lat[:, None], (ts, ts))
                        else:
                            x, y = p.forward(*np.meshgrid(lon, lat))
                        fx, fy = (x - b.w) / (b.e - b.w) * w, (b.n - y) / (b.n - b.s) * h
                        ok = (fx >= 0) & (fx < w) & (fy >= 0) & (fy < h)
                        if not ok.any():
                            continue
                        rows = [np.where(ok, _sample(a, np.where(ok, fy, 0), np.where(ok, fx, 0), nearest), np.nan) for a in bands]
                        some = [k for k, v in enumerate(rows) if not np.isnan(v).all()]
                        if some:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array([(ty << z) + tx] * len(some), pa.int64()), pa.array(some, pa.int32()), to_arrow([rows[k] for k in some])], ["path", "tile_id", "band", "cells"])

    def merge(key, table):
        from ..operators.tiling import from_arrow, to_arrow

        out = np.full(ts * ts, np.nan)
        for k in np.argsort(np.array(table.column("path").to_pylist()), kind="stable"):
            a = from_arrow(table.column("cells")[int(k)])
            out = np.where(np.isnan(out), a, out)
        tid, band = key[0].as_py(), key[1].as_py()
        return pa.table({"tile_id": pa.array([tid], pa.int64()), "tx": pa.array([tid % (1 << z)], pa.int64()), "ty": pa.array([tid >> z], pa.int64()), "band": pa.array([band], pa.int32()), "cells": to_arrow([out])})

    got = files.mapInArrow(tiles, "path string, tile_id long, band int, cells array<double>").groupBy("tile_id", "band").applyInArrow(merge, TILES)
    value = float(nodata) if nodata is not None else whole[7] if whole[7] is not None and whole[7] == whole[8] and not whole[9] else None
    meta = RasterMeta(z, ts, nb, "float", () if value is None else (value,) * nb, Bounds(*whole[:4]), "Categorical" if nearest else "Continuous", "MODE" if nearest else "MEAN", categories=tuple((b, next(iter(x))) for b, x in sorted(names.items())), protection=protection_level(protection))
    return Raster(meta, (got,))


def protection_level(label: str | None) -> str:
    """A label that is stored with a raster: words of letters, digits and underscores joined by & | and brackets."""
    s = (label or "").strip()
    if s and not re.fullmatch(r"[\w&|()\s-]+", s):
        raise ValueError(f"not a protection level: {s!r}")
    if s.count("(") != s.count(")"):
        raise ValueError(f"not a protection level: {s!r}")
    return s


def _sample(a: np.ndarray, fy: np.ndarray, fx: np.ndarray, nearest: bool) -> np.ndarray:
    """Values at places inside an image, in its pixels; bilinear among those that are valid."""
    h, w = a.shape
    if nearest:
        return a[np.clip(fy.astype(int), 0, h - 1), np.clip(fx.astype(int), 0, w - 1)]
    y, x = np.clip(fy - 0.5, 0, h - 1), np.clip(fx - 0.5, 0, w - 1)
    j, i = np.minimum(y.astype(int), max(0, h - 2)), np.minimum(x.astype(int), max(0, w - 2))
    t, s = y - j, x - i
    total, weight = np.zeros(fy.shape), np.zeros(fy.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            v = a[np.minimum(j + dy, h - 1), np.minimum(i + dx, w - 1)]
            f = (t if dy else 1 - t) * (s if dx else 1 - s) * ~np.isnan(v)
            total += f * np.nan_to_num(v)
            weight += f
    with np.errstate(invalid="ignore"):
        return total / np.where(weight > 0, weight, np.nan)


def stitch(r: Raster) -> tuple[list[np.ndarray], Bounds]:
    """All tiles in one array a band, for results that are small on purpose: tiles come one by one."""
    ts, z = r.meta.tilesize, r.meta.zoom
    t = r.tile_range()
    out = [np.full(((t.n - t.s + 1) * ts, (t.e - t.w + 1) * ts), np.nan) for _ in range(r.meta.bands)]
    for row in r.tiles().select("tx", "ty", "band", "cells").toLocalIterator():
        if t.w <= row.tx <= t.e and t.s <= row.ty <= t.n:
            y, x = (t.n - row.ty) * ts, (row.tx - t.w) * ts
            out[row.band][y : y + ts, x : x + ts] = np.array([np.nan if v is None else v for v in row.cells]).reshape(ts, ts)
    a, b = grid.tile_bounds(t.w, t.s, z, ts), grid.tile_bounds(t.e, t.n, z, ts)
    return out, Bounds(a.w, a.s, b.e, b.n)


def _at_level(r: Raster, zoom: int) -> Raster:
    from ..operators.aggregate import coarser

    if zoom > r.meta.zoom:
        raise ValueError(f"the raster ends at zoom {r.meta.zoom}; {zoom} is finer")
    while r.meta.zoom > max(1, zoom):
        r = coarser(r)
    return r


def export(r: Raster, name: str, single=False, zoom=-1, count=-1, mosaic=-1, format: str = "tif", random=False, tms=False, colorscale=None, tileids: str = "", bounds=None, all_levels=False, max_size=-1, nodata: float | None = None, seed: int = 0):
    """Write an image a tile, a block of mosaic x mosaic tiles, or one for all, into a folder that executors share.

    name: a path with $X $Y $ZOOM $ID $LAT $LON for tiles. Executors write their own tiles; only `single` gathers tiles
    on the driver. zoom: a level, the raster's own or a coarser one. all_levels: that one and all below it; a name
    without $ZOOM gets it. max_size: bytes of a single image's cells at most ("64m"), else a coarser level is taken.
    count: so many tiles, random ones if asked for. tileids: ids split by commas. colorscale: a scale that is applied
    before PNG or JPEG. nodata: the value that nodata gets in TIFF, NaN unless given. Returns the paths; "In-Memory"
    returns the bytes of a single image.
    """
    from ..functions.geometry import size_string
    from ..operators.local import crop

    format = {"jpeg": "jpg", "tiff": "tif"}.get(format.lower(), format.lower())
    if zoom is not None and float(zoom) >= 1:
        r = _at_level(r, int(zoom))
    most = size_string(str(max_size)) if isinstance(max_size, str) and max_size else int(max_size or -1)
    if most > 0:
        if not single and name != "In-Memory":
            raise ValueError("max_size is for a single image")
        while (t := r.tile_range()).count * r.meta.tilesize**2 * r.meta.bands * 4 > most and r.meta.zoom > 1:
            r = _at_level(r, r.meta.zoom - 1)
    if all_levels:
        if name == "In-Memory":
            raise ValueError("all levels don't go into one image in memory")
        own = name if "$ZOOM" in name else f"{name}-$ZOOM"
        rest = dict(single=single, count=count, mosaic=mosaic, format=format, random=random, tms=tms, colorscale=colorscale, tileids=tileids, bounds=bounds, nodata=nodata, seed=seed)
        out = []
        for z in range(r.meta.zoom, 0, -1):
            r = _at_level(r, z)
            out += export(r, own.replace("$ZOOM", str(z)) if single else own, **rest)
        return out
    if bounds is not None:
        r = crop(r, bounds)
    if colorscale is not None:
        from ..functions.colors import colored

        r = colored(r, colorscale)
    if format not in ("tif", "png", "jpg"):
        raise ValueError(f"images are written as tif, png or jpg, not {format!r}")
    ts, z, nb = r.meta.tilesize, r.meta.zoom, r.meta.bands
    none = float("nan") if nodata is None else float(nodata)

    def draw(b, at=None):
        if format == "tif":
            return write_tiff([np.where(np.isnan(x), none, x) for x in b], at, none)
        return write_png(b) if format == "png" else write_jpeg(b)

    if single or name == "In-Memory":
        bands, at = stitch(r)
        data = draw(bands, at)
        if name == "In-Memory":
            return data
        path = name if name.endswith(f".{format}") else f"{name}.{format}"
        with open(path, "wb") as f:
            f.write(data)
        return [path]
    ship(r.spark)
    ids = r.tiles().select("tile_id").distinct()
    if tileids:
        ids = ids.where(F.col("tile_id").isin([int(x) for x in str(tileids).split(",")]))
    if count and int(count) > 0:
        ids = ids.orderBy(F.rand(seed) if random else F.col("tile_id")).limit(int(count))
    n = max(1, int(mosaic))
    t = r.tiles().join(ids, "tile_id", "left_semi").withColumn("bx", F.floor(F.col("tx") / n)).withColumn("by", F.floor(F.col("ty") / n))

    def write(key, table):
        from ..operators.tiling import from_arrow

        bx, by = key[0].as_py(), key[1].as_py()
        bands = [np.full((n * ts, n * ts), np.nan) for _ in range(nb)]
        for tx, ty, band, c in zip(*(table.column(k).to_pylist() for k in ("tx", "ty", "band")), table.column("cells")):
            y, x = (n - 1 - (ty - by * n)) * ts, (tx - bx * n) * ts
            bands[band][y : y + ts, x : x + ts] = from_arrow(c).reshape(ts, ts)
        tx, ty = bx * n, by * n
        a, b = grid.tile_bounds(tx, ty, z, ts), grid.tile_bounds(tx + n - 1, ty + n - 1, z, ts)
        row = grid.tiles_high(z) - 1 - ty if tms else ty
        tokens = {"$ZOOM": z, "$ID": (ty << z) + tx, "$LAT": a.s, "$LON": a.w, "$X": tx, "$Y": row}
        path = name if any(k in name for k in tokens) else f"{name}-$ID"
        for k, v in tokens.items():
            path = path.replace(k, str(v))
        path = path if path.endswith(f".{format}") else f"{path}.{format}"
        with open(path, "wb") as f:
            f.write(draw(bands, Bounds(a.w, a.s, b.e, b.n)))
        return pa.table({"path": [path]})

    return sorted(x.path for x in t.select("tx", "ty", "band", "cells", "bx", "by").groupBy("bx", "by").applyInArrow(write, "path string").collect())
