"""Neighbourhood operators on tiles with rims: statistics, terrain, kernels."""

from __future__ import annotations

import math
import warnings

import numpy as np

from .. import grid
from ..raster import Raster
from .tiling import rimmed

#: The conversion from radians that slopes and aspects are defined with (fixed value).
RAD_2_DEG = 57.2957795
STATS = ("count", "max", "mean", "median", "min", "range", "stddev", "sum", "variance")


def _single(a: np.ndarray) -> np.ndarray:
    return a.astype(np.float32).astype(float)


def _box(a: np.ndarray, w: int) -> np.ndarray:
    """Sums over all w x w windows."""
    c = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    c[1:, 1:] = a.cumsum(0).cumsum(1)
    return c[w:, w:] - c[:-w, w:] - c[w:, :-w] + c[:-w, :-w]


def _extreme(a: np.ndarray, w: int, f) -> np.ndarray:
    for axis in (0, 1):
        n = a.shape[axis] - w + 1
        out = np.take(a, range(n), axis)
        for k in range(1, w):
            out = f(out, np.take(a, range(k, k + n), axis))
        a = out
    return a


def window_size(size, zoom: int, tilesize: int) -> int:
    """"3p" and 3: pixels; "300m": metres, rounded up."""
    s = str(size).strip().lower()
    n = math.ceil(float(s[:-1]) / grid.meters(zoom, tilesize)) if s.endswith("m") else int(float(s.rstrip("p")))
    if n < 1:
        raise ValueError(f"no window of size {size!r}")
    return n


def window_stat(a: np.ndarray, stat: str, w: int, ignore: bool = True) -> np.ndarray:
    """A statistic of the valid cells of all w x w windows of a; where none is valid (or, unless ignore, not all are), NaN."""
    ok = ~np.isnan(a)
    n = np.rint(_box(ok.astype(float), w))
    base = float(a[ok].mean()) if ok.any() else 0.0
    if not np.isfinite(base):
        base = 0.0
    with np.errstate(invalid="ignore", divide="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        if stat in ("sum", "mean", "variance", "stddev"):
            d = np.where(ok, a - base, 0.0)
            s = _box(d, w)
            if stat == "sum":
                out = s + n * base
            elif stat == "mean":
                out = s / n + base
            else:
                out = np.where(n > 1, np.maximum(0, (_box(d * d, w) - s * s / n) / (n - 1)), 0.0)
                out = np.sqrt(out) if stat == "stddev" else out
        elif stat == "count":
            out = n
        elif stat in ("min", "max", "range"):
            high, low = (_extreme(a, w, f) for f in (np.fmax, np.fmin))
            out = {"min": low, "max": high, "range": high - low}[stat]
        elif stat == "median":
            rows = np.lib.stride_tricks.sliding_window_view(a, (w, w))
            out = np.stack([np.nanmedian(r.reshape(len(r), -1), 1) for r in rows])
        else:
            raise ValueError(f"unknown focal statistic {stat!r}")
    return np.where((n > 0) if ignore else (n == w * w), out, np.nan)


def _sides(w: int) -> tuple[int, int]:
    """Cells before and after the centre; of an even window the centre is left of and above the middle."""
    before = w // 2 if w % 2 else w // 2 - 1
    return before, w - 1 - before


def focal_stat(stat: str, r: Raster, size, ignore_nodata=True) -> Raster:
    """A statistic of each cell's neighbourhood; nodata cells stay nodata. Variance and deviation are of the sample."""
    stat = str(stat).lower()
    if stat not in STATS:
        raise ValueError(f"unknown focal statistic {stat!r}; known are {', '.join(STATS)}")
    ignore = ignore_nodata if isinstance(ignore_nodata, bool) else str(ignore_nodata).lower() in ("true", "1", "yes", "1.0")
    w = window_size(size, r.meta.zoom, r.meta.tilesize)
    before, after = _sides(w)
    ts = r.meta.tilesize
    kind = {"count": "int", "min": r.meta.tile_type, "max": r.meta.tile_type, "range": r.meta.tile_type}.get(stat, "float")

    def f(a):
        centre = a[before : before + ts, before : before + ts]
        out = np.where(np.isnan(centre), np.nan, window_stat(a, stat, w, ignore))
        return [_single(out) if kind == "float" else out]

    return rimmed(r, before, before, after, after, f, r.meta.with_(tile_type=kind))


def tpi(r: Raster, size=67) -> Raster:
    """Topographic position: a cell less the mean of its neighbours, itself and nodata left out."""
    w = window_size(size, r.meta.zoom, r.meta.tilesize)
    before, after = _sides(w)
    ts = r.meta.tilesize

    def f(a):
        c = a[before : before + ts, before : before + ts]
        n = window_stat(a, "count", w)
        with np.errstate(invalid="ignore", divide="ignore"):
            return [_single(np.where(n > 1, c - (window_stat(a, "sum", w) - c) / (n - 1), np.nan))]

    return rimmed(r, before, before, after, after, f, r.meta.with_(tile_type="float"))


def _gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eighths of weighted differences to the east and to the north; nodata neighbours count as the centre."""
    c = a[1:-1, 1:-1]
    z = lambda y, x: (lambda p: np.where(np.isnan(p), c, p))(a[1 + y : a.shape[0] - 1 + y, 1 + x : a.shape[1] - 1 + x])
    east = (z(-1, 1) + 2 * z(0, 1) + z(1, 1)) - (z(-1, -1) + 2 * z(0, -1) + z(1, -1))
    north = (z(-1, 1) + 2 * z(-1, 0) + z(-1, -1)) - (z(1, 1) + 2 * z(1, 0) + z(1, -1))
    return east / 8, north / 8


def _units(theta: np.ndarray, units: str) -> np.ndarray:
    if units == "deg":
        return _single(theta * RAD_2_DEG)
    if units == "rad":
        return _single(theta)
    return _single(np.tan(theta) * (100.0 if units == "percent" else 1.0))


def _check_units(units: str) -> str:
    u = str(units).lower()
    if u not in ("deg", "rad", "gradient", "percent"):
        raise ValueError('units must be "deg", "rad", "gradient", or "percent"')
    return u


def slope(r: Raster, units: str = "rad") -> Raster:
    """Steepness from the 3 x 3 neighbourhood's weighted differences."""
    units, m = _check_units(units), grid.meters(r.meta.zoom, r.meta.tilesize)

    def f(a):
        x, y = _gradients(a)
        return [_units(np.arccos(np.minimum(1.0, m / np.sqrt(x * x + y * y + m * m))), units)]

    return rimmed(r, 1, 1, 1, 1, f, r.meta.with_(tile_type="float"))


def aspect(r: Raster, units: str = "rad", flat: float = -1.0) -> Raster:
    """Direction that a cell faces, clockwise from north; the flat value (in radians, before units) where it is level."""
    units, m = _check_units(units), grid.meters(r.meta.zoom, r.meta.tilesize)
    turn = 2 * math.pi

    def f(a):
        x, y = _gradients(a)
        up = m / np.sqrt(x * x + y * y + m * m)
        t = turn - np.mod(np.arctan2(-y, -x) + 1.5 * math.pi, turn)
        level = (np.abs(up - 1.0) <= 2.3e-16) | (np.abs(t - turn) <= 1e-15)
        return [_units(np.where(np.isnan(up), np.nan, np.where(level, flat, t)), units)]

    return rimmed(r, 1, 1, 1, 1, f, r.meta.with_(tile_type="float"))


def slope8(r: Raster, units: str = "rad") -> Raster:
    """Slopes to the eight neighbours as bands: up, up right, right, and so on clockwise; nodata neighbours are level."""
    units, m = _check_units(units), grid.meters(r.meta.zoom, r.meta.tilesize)
    steps = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]

    def f(a):
        c = a[1:-1, 1:-1]
        out = []
        for y, x in steps:
            p = a[1 + y : a.shape[0] - 1 + y, 1 + x : a.shape[1] - 1 + x]
            d = np.where(np.isnan(p) & ~np.isnan(c), 0.0, p - c)
            out.append(_units(np.arctan2(d, m * (math.sqrt(2) if y and x else 1.0)), units))
        return out

    return rimmed(r, 1, 1, 1, 1, f, r.meta.with_(tile_type="float", bands=8), 8)


def kernel(method: str, r: Raster, sigma: float) -> Raster:
    """Smoothing by a Gaussian of `sigma` metres, nodata as 0; "laplacian" applies the 3 x 3 Laplacian to that."""
    method = str(method).lower()
    if method not in ("gaussian", "laplacian"):
        raise ValueError(f"unknown kernel {method!r}")
    s = float(sigma) / grid.meters(r.meta.zoom, r.meta.tilesize)
    half = max(1, math.ceil(3 * s))
    g = np.exp(-0.5 * (np.arange(-half, half + 1) / s) ** 2)
    g /= g.sum()
    rim = half + (method == "laplacian")
    ts = r.meta.tilesize

    def f(a):
        centre = a[rim : rim + ts, rim : rim + ts]
        b = np.nan_to_num(a, nan=0.0)
        b = np.apply_along_axis(np.convolve, 0, b, g, "valid")
        b = np.apply_along_axis(np.convolve, 1, b, g, "valid")
        if method == "laplacian":
            b = b[:-2, 1:-1] + b[2:, 1:-1] + b[1:-1, :-2] + b[1:-1, 2:] - 4 * b[1:-1, 1:-1]
        return [_single(np.where(np.isnan(centre), np.nan, b))]

    return rimmed(r, rim, rim, rim, rim, f, r.meta.with_(tile_type="float"))


def weighted(r: Raster, weights) -> Raster:
    """Sums of neighbours by a matrix of weights with odd sides, over the sum of all weights; nodata counts as 0 with its
    weight, and nodata cells stay nodata."""
    k = np.asarray(weights, float)
    if k.ndim != 2 or not (k.shape[0] % 2 and k.shape[1] % 2) or k.sum() == 0:
        raise ValueError("weights are a matrix with odd sides and a sum")
    up, left, ts = k.shape[0] // 2, k.shape[1] // 2, r.meta.tilesize

    def f(a):
        centre = a[up : up + ts, left : left + ts]
        b = np.nan_to_num(a, nan=0.0)
        out = sum(k[y, x] * b[y : y + ts, x : x + ts] for y in range(k.shape[0]) for x in range(k.shape[1]))
        return [_single(np.where(np.isnan(centre), np.nan, out / k.sum()))]

    return rimmed(r, left, up, left, up, f, r.meta.with_(tile_type="float"))
