"""Operators by name, for scripts and for methods of rasters. Names are compared in lower case."""

from __future__ import annotations

from collections.abc import Callable

_OPS: dict[str, Callable] = {}


def mapop(*names: str) -> Callable:
    """Register an operator: a function of rasters, feature frames, numbers and strings."""

    def add(f: Callable) -> Callable:
        for n in names:
            _OPS[n.lower()] = f
        return f

    return add


def lookup(name: str) -> Callable | None:
    if not _OPS:
        _builtin()
    return _OPS.get(name.lower())


def names() -> list[str]:
    lookup("")
    return sorted(_OPS)


def _builtin() -> None:
    from ..functions import expressions as X
    from ..grid import Bounds
    from ..operators import aggregate, cost, focal, local, vector
    from ..raster import Raster, con
    from ..sources import images, vectors

    def two(name):
        def op(a, b):
            if isinstance(a, Raster):
                return a.binary(b, name)
            if isinstance(b, Raster):
                f, kind = X.binary(name)
                return b.map(lambda v: f(X.lit(a), v), kind)
            return _plain(name, a, b)

        return op

    words = {"add": "+", "minus": "-", "mult": "*", "div": "/", "pow": "**", "and": "&&", "or": "||", "eq": "==", "ne": "!= <>", "gt": ">", "ge": ">= gte", "lt": "<", "le": "<= lte", "bitand": "&", "bitor": "|", "bitxor": "^"}
    for name in X.BINARY:
        mapop(name, *words.get(name, "").split())(two(name))
    for name, other in {"abs": "", "uminus": "", "bitnot": "~", "not": "!", "sin": "", "cos": "", "tan": ""}.items():
        mapop(name, *other.split())(lambda a, name=name: a.unary(name) if isinstance(a, Raster) else _plain(name, a))
    mapop("log")(local.log)
    mapop("con")(con)
    mapop("isnodata", "isnull")(lambda r: local.is_nodata(r))
    mapop("isnodatabounds", "isnullbounds")(local.is_nodata)
    mapop("bandcombine", "bc")(local.band_combine)
    mapop("bandextract", "extract", "be")(local.band_extract)
    mapop("convert")(local.convert)
    mapop("changeclassification")(local.change_classification)
    mapop("normalize")(local.normalize)
    mapop("crop")(lambda r, *b: local.crop(r, *b[:4]))
    mapop("cropexact")(lambda r, *b: local.crop_exact(r, *b[:4]))
    mapop("fill")(lambda r, v: local.fill(r, v))
    mapop("fillbounds")(local.fill)
    mapop("mosaic")(local.mosaic)
    mapop("statistics", "stats")(local.statistics)
    mapop("findholes")(local.find_holes)
    mapop("focalstat")(focal.focal_stat)
    mapop("tpi")(focal.tpi)
    mapop("kernel")(focal.kernel)
    mapop("weightedkernel")(focal.weighted)
    mapop("slope")(focal.slope)
    mapop("aspect")(focal.aspect)
    mapop("slope8", "directionalslope", "dirslope")(focal.slope8)
    mapop("quantiles")(lambda r, n, fraction=1.0: aggregate.with_quantiles(r, int(n), float(fraction)))
    mapop("buildpyramid", "bp")(lambda r, rule=None: aggregate.build_pyramid(r, rule)[0])
    mapop("inlinecsv", "csv")(vectors.inline_csv)
    mapop("ingest")(images.ingest)
    mapop("export")(images.export)

    mapop("zoom")(_of_scans("zoom"))
    mapop("save")(_of_scans("save"))

    def bounded(f):
        """(V, how, size, [column], [width], [w, s, e, n or raster])"""

        def op(v, how, size, *rest, **kw):
            rest = list(rest)
            bounds = None
            if rest and isinstance(rest[-1], Raster):
                bounds = rest.pop().meta.bounds
            elif len(rest) >= 4 and all(isinstance(x, (int, float)) for x in rest[-4:]):
                bounds = Bounds(*map(float, rest[-4:]))
                rest = rest[:-4]
            return f(v, how, size, *rest, bounds=bounds, **kw)

        return op

    mapop("rasterizevector", "rasterize", "rasterizevectorexact", "rasterizeexact")(bounded(vector.rasterize_vector))
    mapop("rasterizepoints", "rasterizepointsexact")(bounded(vector.rasterize_points))

    def cost_distance(points, *rest):
        rest = list(rest)
        if rest and not isinstance(rest[0], Raster):
            z = int(rest.pop(0))
            if rest[0].meta.zoom != z:
                raise ValueError(f"friction has zoom {rest[0].meta.zoom}, not {z}")
        r = rest.pop(0)
        most = float(rest.pop(0)) if rest and isinstance(rest[0], (int, float)) else -1.0
        b = Bounds(*map(float, rest[:4])) if len(rest) >= 4 else rest[0].meta.bounds if rest else None
        return cost.cost_distance(points, r, most, b)

    mapop("costdistance", "cd")(cost_distance)
    mapop("leastcostpath", "lcp")(cost.least_cost_path)


def _of_scans(name: str):
    """Known by name; the engine runs these itself, as they need its catalog."""

    def op(*_):
        raise ValueError(f"{name} is for scripts with a catalog")

    return op


def _plain(name: str, *a):
    """Constants among themselves are folded."""
    import math

    f = {
        "add": lambda x, y: x + y, "minus": lambda x, y: x - y, "mult": lambda x, y: x * y, "div": lambda x, y: x / y if y else math.copysign(math.inf, x) if x else math.nan, "pow": lambda x, y: x**y,
        "rminus": lambda x, y: y - x, "rdiv": lambda x, y: y / x, "rpow": lambda x, y: y**x, "gt": lambda x, y: float(x > y), "ge": lambda x, y: float(x >= y), "lt": lambda x, y: float(x < y), "le": lambda x, y: float(x <= y),
        "eq": lambda x, y: float(abs(x - y) <= 1e-8), "ne": lambda x, y: float(abs(x - y) > 1e-8), "and": lambda x, y: float(abs(x) > 1e-8 and abs(y) > 1e-8), "or": lambda x, y: float(abs(x) > 1e-8 or abs(y) > 1e-8), "xor": lambda x, y: float((abs(x) > 1e-8) != (abs(y) > 1e-8)),
        "bitand": lambda x, y: float(int(x) & int(y)), "bitor": lambda x, y: float(int(x) | int(y)), "bitxor": lambda x, y: float(int(x) ^ int(y)), "uminus": lambda x: -x, "abs": abs, "bitnot": lambda x: float(~int(x)), "not": lambda x: float(abs(x) <= 1e-8),
        "sin": math.sin, "cos": math.cos, "tan": math.tan,
    }[name]
    return f(*a)
