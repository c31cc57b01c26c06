"""Geometry without libraries: WKT, clipping tests, great circles, geohashes, size strings."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import EARTH_RADIUS

Point = tuple[float, float]
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_KINDS = ("POINT", "LINESTRING", "LINEARRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
_RING = re.compile(r"\(([^()]*)\)")


def parse_wkt(wkt: str) -> tuple[str, list[list[Point]]]:
    """(kind, rings): points of each part in order; POINT gives one part of one point. Z values are dropped."""
    s = wkt.strip().upper()
    kind = s.split("(", 1)[0].replace(" Z", "").strip()
    if kind.endswith("EMPTY"):
        return kind.split()[0], []
    if kind not in _KINDS or s.count("(") != s.count(")"):
        raise ValueError(f"not a geometry: {wkt[:60]!r}")
    rings = []
    for body in _RING.findall(s):
        pts = [tuple(map(float, re.findall(_NUMBER, p)[:2])) for p in body.split(",")]
        if any(len(p) != 2 for p in pts):
            raise ValueError(f"not a geometry: {wkt[:60]!r}")
        rings.append(pts)
    if kind == "MULTIPOINT" and not rings:
        raise ValueError(f"not a geometry: {wkt[:60]!r}")
    return kind, rings


def is_wkt(s: str | None) -> bool:
    try:
        return s is not None and bool(parse_wkt(s)[0])
    except ValueError:
        return False


def to_wkt(kind: str, rings: list[list[Point]]) -> str:
    body = lambda r: ", ".join(f"{x!r} {y!r}" for x, y in r)
    if not rings:
        return f"{kind} EMPTY"
    return f"{kind} ({', '.join(f'({body(r)})' for r in rings)})" if kind in ("POLYGON", "MULTILINESTRING") else f"{kind} ({body(rings[0])})"


def point_in_rings(x: float, y: float, rings: list[list[Point]]) -> bool:
    """Even-odd rule, so holes are rings like others."""
    inside = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                inside = not inside
    return inside


def segments_cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    s, t, u, v = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    if s * t < 0 and u * v < 0:
        return True
    on = lambda p, q, r, z: z == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return on(a, b, c, s) or on(a, b, d, t) or on(c, d, a, u) or on(c, d, b, v)


def great_circle(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Metres on the sphere of the equator's radius."""
    a, b = F.radians(lat0), F.radians(lat1)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, length: int = 8) -> Column:
    """Geohash as a column expression: interleaved bits of the scaled coordinates, five to a character."""
    bits = 5 * length
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * (1 << nx)), F.lit((1 << nx) - 1))
    y = F.least(F.floor((lat + 90.0) / 180.0 * (1 << ny)), F.lit((1 << ny) - 1))
    out = []
    for c in range(length):
        v = F.lit(0).cast("long")
        for k in range(5):
            i = 5 * c + k
            src, top = (x, nx - 1 - i // 2) if i % 2 == 0 else (y, ny - 1 - i // 2)
            v = v * 2 + F.shiftright(src, top).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substring(F.lit(_BASE32), v.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def geohash_decode(code: str) -> tuple[float, float, float, float]:
    """(south, west, north, east)"""
    lo, hi, even = [-90.0, -180.0], [90.0, 180.0], True
    for ch in code.lower():
        v = _BASE32.index(ch)
        for k in (16, 8, 4, 2, 1):
            axis = 1 if even else 0
            mid = (lo[axis] + hi[axis]) / 2
            (lo if v & k else hi)[axis] = mid
            even = not even
    return lo[0], lo[1], hi[0], hi[1]


def geohash_adjacent(code: str, direction: str) -> str:
    """The neighbour to n, s, e or w, around the antimeridian."""
    s, w, n, e = geohash_decode(code)
    lat = (s + n) / 2 + {"n": n - s, "s": s - n}.get(direction, 0.0)
    lon = ((w + e) / 2 + {"e": e - w, "w": w - e}.get(direction, 0.0) + 180) % 360 - 180
    bits = 5 * len(code)
    nx, ny = (bits + 1) // 2, bits // 2
    x, y = min(int((lon + 180) / 360 * (1 << nx)), (1 << nx) - 1), min(max(int((lat + 90) / 180 * (1 << ny)), 0), (1 << ny) - 1)
    out = ""
    for c in range(len(code)):
        v = 0
        for k in range(5):
            i = 5 * c + k
            v = v * 2 + (x >> (nx - 1 - i // 2) & 1 if i % 2 == 0 else y >> (ny - 1 - i // 2) & 1)
        out += _BASE32[v]
    return out


def destination(lat: float, lon: float, bearing: float, metres: float) -> tuple[float, float]:
    """Along a great circle from a point, bearing in degrees from north."""
    a, b, d = math.radians(lat), math.radians(bearing), metres / EARTH_RADIUS
    y = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(b))
    x = math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(y))
    return math.degrees(y), (math.degrees(x) + 180) % 360 - 180


def size_string(s: str) -> int:
    """"64m" and the like in bytes, by powers of 1024 up to e."""
    m = re.fullmatch(rf"\s*({_NUMBER})\s*([bkmgtpe]?)b?\s*", s.lower())
    if not m:
        raise ValueError(f"not a size: {s!r}")
    return int(float(m[1]) * 1024 ** "bkmgtpe".index(m[2] or "b"))


def colinear(a: Point, b: Point, c: Point, tolerance: float = 1e-12) -> bool:
    """Whether three points lie on a line: twice the triangle's area is no more than the tolerance."""
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) <= tolerance


def distance(p: Point, a: Point, b: Point | None = None) -> float:
    """From a point to another, or to a segment."""
    if b is None:
        return math.hypot(p[0] - a[0], p[1] - a[1])
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / length)) if length else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def _clip_ring(ring: list[Point], box) -> list[Point]:
    """A closed ring cut by the four sides of a box in turn."""
    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    for axis, at, keep in ((0, box.w, 1), (0, box.e, -1), (1, box.s, 1), (1, box.n, -1)):
        out: list[Point] = []
        for p, q in zip(pts[-1:] + pts[:-1], pts):
            was, is_ = keep * (p[axis] - at) >= 0, keep * (q[axis] - at) >= 0
            if was != is_:
                t = (at - p[axis]) / (q[axis] - p[axis])
                other = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
                out.append((at, other) if axis == 0 else (other, at))
            if is_:
                out.append(q)
        pts = out
        if not pts:
            return []
    return [*pts, pts[0]]


def _clip_line(line: list[Point], box) -> list[list[Point]]:
    """The parts of a line inside a box."""
    out: list[list[Point]] = []
    for a, b in zip(line, line[1:]):
        t0, t1, d = 0.0, 1.0, (b[0] - a[0], b[1] - a[1])
        for axis, low, high in ((0, box.w, box.e), (1, box.s, box.n)):
            if d[axis] == 0:
                if not low <= a[axis] <= high:
                    t0, t1 = 1.0, 0.0
                continue
            u, v = sorted(((low - a[axis]) / d[axis], (high - a[axis]) / d[axis]))
            t0, t1 = max(t0, u), min(t1, v)
        if t0 > t1:
            continue
        p = a if t0 == 0 else (a[0] + t0 * d[0], a[1] + t0 * d[1])
        q = b if t1 == 1 else (a[0] + t1 * d[0], a[1] + t1 * d[1])
        if out and out[-1][-1] == p:
            out[-1].append(q)
        else:
            out.append([p, q])
    return out


def clip(kind: str, rings: list[list[Point]], box) -> tuple[str, list[list[Point]]]:
    """A geometry's part inside a box, empty if there is none. Where a cut would part a polygon in two, the parts stay
    joined along the box's side, which changes no point's inside."""
    if "POLYGON" in kind:
        return kind, [r for r in (_clip_ring(ring, box) for ring in rings) if len(r) > 3]
    if "LINE" in kind:
        parts = [p for line in rings for p in _clip_line(line, box)]
        return ("MULTILINESTRING" if len(parts) > 1 else "LINESTRING"), parts
    return kind, [p for p in ([q for q in ring if box.w <= q[0] <= box.e and box.s <= q[1] <= box.n] for ring in rings) if p]


def _edges(kind: str, rings: list[list[Point]]) -> list[tuple[Point, Point]]:
    close = lambda r: r + r[:1] if "POLYGON" in kind and r[0] != r[-1] else r
    return [e for r in rings for e in zip(close(r), close(r)[1:])]


def intersects(a: tuple[str, list[list[Point]]], b: tuple[str, list[list[Point]]]) -> bool:
    """Whether two geometries (kind, rings) share a point."""
    points = [[p for r in g[1] for p in r] for g in (a, b)]
    if not all(points):
        return False
    box = [(min(p[k] for p in ps), max(p[k] for p in ps)) for ps in points for k in (0, 1)]
    if box[0][0] > box[2][1] or box[2][0] > box[0][1] or box[1][0] > box[3][1] or box[3][0] > box[1][1]:
        return False
    for (kind, rings), other in ((a, points[1]), (b, points[0])):
        if "POLYGON" in kind and any(point_in_rings(*p, rings) for p in other):
            return True
    ea, eb = _edges(*a), _edges(*b)
    if not ea and not eb:
        return bool(set(points[0]) & set(points[1]))
    if not ea or not eb:
        return any(distance(p, *e) == 0 for p in points[0 if not ea else 1] for e in (eb or ea))
    return any(segments_cross(*x, *y) for x in ea for y in eb)


def fix_wkt(wkt: str | None) -> str | None:
    """A geometry's text put right where that is plain: upper case, missing closing brackets, repeated points, rings that
    don't close. None if it is no geometry."""
    if wkt is None:
        return None
    s = re.sub(r"\s+", " ", wkt).strip().upper()
    s += ")" * (s.count("(") - s.count(")"))
    try:
        kind, rings = parse_wkt(s)
    except ValueError:
        return None
    out = []
    for r in rings:
        r = [p for k, p in enumerate(r) if k == 0 or p != r[k - 1]]
        if "POLYGON" in kind or kind == "LINEARRING":
            r = r if r[0] == r[-1] else [*r, r[0]]
            if len(r) < 4:
                continue
        out.append(r)
    if rings and not out:
        return None
    if kind == "MULTIPOLYGON":
        return f"{kind} (({'), ('.join('(' + ', '.join(f'{x!r} {y!r}' for x, y in r) + ')' for r in out)}))"
    return to_wkt(kind, out)
