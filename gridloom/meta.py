"""What is known of a raster without looking at its cells."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from .grid import Bounds

#: From narrow to wide.
TYPES = ["byte", "short", "ushort", "int", "float", "double"]
NODATA = {"byte": 255.0, "short": -32768.0, "ushort": 65536.0, "int": -2147483648.0, "float": float("nan"), "double": float("nan")}
ALIASES = {"float32": "float", "float64": "double", "int8": "byte", "int16": "short", "int32": "int"}


def tile_type(name: str) -> str:
    t = ALIASES.get(name.lower(), name.lower())
    if t not in TYPES:
        raise ValueError(f"unknown tile type {name!r}")
    return t


def widest(*types: str) -> str:
    return max(types, key=TYPES.index)


@dataclass(frozen=True)
class RasterMeta:
    zoom: int
    tilesize: int
    bands: int = 1
    tile_type: str = "float"
    nodata: tuple[float, ...] = ()
    bounds: Bounds = field(default_factory=Bounds)
    classification: str = "Continuous"
    resampling: str = "MEAN"
    stats: tuple = ()
    quantiles: tuple = ()
    categories: tuple = ()
    tags: tuple = ()
    protection: str = ""

    def nodata_of(self, band: int) -> float:
        return self.nodata[band] if band < len(self.nodata) else NODATA[self.tile_type]

    def with_(self, **how) -> RasterMeta:
        """Changed; statistics and quantiles go, unless given, and nodata follows the type."""
        base = {"stats": (), "quantiles": ()}
        if "tile_type" in how and "nodata" not in how:
            base["nodata"] = ()
        return replace(self, **(base | how))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(s: str) -> RasterMeta:
        d = json.loads(s)
        d["bounds"] = Bounds(**d["bounds"])
        fix = lambda x: tuple(map(fix, x)) if isinstance(x, list) else x
        return RasterMeta(**{k: fix(v) for k, v in d.items()})
