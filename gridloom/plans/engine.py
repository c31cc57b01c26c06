"""Running scripts: trees become rasters, and nothing is computed before the result is saved or read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..raster import Raster
from ..sources.catalog import Catalog
from .parser import Assign, Call, Literal, Name, Node, ParseError, Resource, parse
from .registry import lookup


class Engine:
    """Resources come from a catalog, or from rasters and feature frames given by name."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, **given) -> None:
        self.spark, self.catalog, self.given = spark, catalog, given

    def resource(self, name: str):
        if name in self.given:
            return self.given[name]
        got = self.catalog.find(name) if self.catalog else None
        if got is None:
            raise ParseError(f"no raster or vectors named {name!r}")
        return got

    def run(self, script: str) -> Raster | DataFrame:
        """The value of the last statement that has one. A tree that occurs again is built once."""
        names: dict[str, object] = {}
        built: dict[Node, object] = {}

        def value(x: Node):
            if isinstance(x, Literal):
                return x.value
            if isinstance(x, Name):
                return names[x.name]
            if x in built:
                return built[x]
            if isinstance(x, Resource):
                out = self.resource(x.name)
            else:
                args = [value(a) for a in x.args]
                if x.name == "save":
                    out = self.save(args[0], str(args[1]))
                elif x.name in ("statistics", "stats"):
                    out = lookup(x.name)(args[0], *self._matching(args[1:]))
                elif x.name == "zoom":
                    if not isinstance(x.args[0], Resource) or self.catalog is None:
                        raise ParseError("zoom reads another level of a stored raster")
                    out = self.catalog.raster(x.args[0].name, int(args[1]))
                else:
                    out = lookup(x.name)(*args)
            built[x] = out
            return out

        last = None
        for s in parse(script):
            last = value(s.value if isinstance(s, Assign) else s)
            if isinstance(s, Assign):
                names[s.name] = last
        return last

    def _matching(self, args: list):
        """Strings among the arguments are patterns of resource names."""
        import fnmatch

        for a in args:
            if isinstance(a, str):
                known = sorted({*self.given, *(self.catalog.rasters() if self.catalog else ())})
                yield from (self.resource(n) for n in fnmatch.filter(known, a))
            else:
                yield a

    def save(self, x, name: str):
        if self.catalog is None:
            raise ValueError("there is no catalog to save in")
        return self.catalog.save(x, name)


def explain(x: Raster) -> None:
    x.tiles().explain("formatted")
