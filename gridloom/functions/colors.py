"""Colour scales: values to red, green, blue and opacity as column expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Color = tuple[int, int, int, int]


@dataclass(frozen=True)
class ColorScale:
    """stops: (value, colour), ascending. scaling: Absolute; MinMax (stops are shares of the range); Modulo (values
    modulo the last stop); Quantile (stops are spread over the raster's quantiles)."""

    stops: tuple[tuple[float, Color], ...]
    scaling: str = "Absolute"
    interpolate: bool = True
    nodata: Color = (0, 0, 0, 0)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(s: str) -> ColorScale:
        d = json.loads(s)
        stops = tuple((float(v), tuple(map(int, c))) for v, c in d["stops"])
        if not stops or any(len(c) != 4 for _, c in stops):
            raise ValueError("a colour scale needs stops of a value and four numbers")
        return ColorScale(tuple(sorted(stops)), d.get("scaling", "Absolute"), bool(d.get("interpolate", True)), tuple(d.get("nodata", (0, 0, 0, 0))))

    def resolved(self, low: float, high: float, quantiles: tuple[float, ...] = ()) -> tuple[tuple[float, Color], ...]:
        """Stops as values of a raster with this range and these quantiles."""
        stops, kind = self.stops, self.scaling.lower()
        if kind == "minmax":
            return tuple((low + s * (high - low), c) for s, c in stops)
        if kind == "quantile":
            q = [low, *quantiles, high]
            return tuple((q[round(k * (len(q) - 1) / max(1, len(stops) - 1))], c) for k, (_, c) in enumerate(stops))
        if kind not in ("absolute", "modulo"):
            raise ValueError(f"unknown scaling {self.scaling!r}")
        return stops

    def columns(self, v: Column, low: float = 0.0, high: float = 1.0, quantiles: tuple[float, ...] = ()) -> list[Column]:
        """Four columns of 0 to 255. Below the first stop its colour, above the last one's."""
        stops = self.resolved(low, high, quantiles)
        if self.scaling.lower() == "modulo":
            v = v % F.lit(float(stops[-1][0]))
        out = []
        for band in range(4):
            e = F.when(v.isNull() | F.isnan(v), F.lit(self.nodata[band])).when(v < stops[0][0], F.lit(stops[0][1][band]))
            for (a, c), (b, d) in zip(stops, stops[1:]):
                x = F.lit(float(c[band]))
                if self.interpolate and b > a:
                    x = x + (v - a) / (b - a) * (d[band] - c[band])
                e = e.when(v < b, F.floor(x + 0.5).cast("int"))
            out.append(e.otherwise(F.lit(stops[-1][1][band])).cast("int"))
        return out


#: A ramp for rasters that name none.
GREY = ColorScale(((0.0, (0, 0, 0, 255)), (1.0, (255, 255, 255, 255))), "MinMax")
RAINBOW = ColorScale(((0.0, (0, 0, 127, 255)), (0.25, (0, 127, 255, 255)), (0.5, (127, 255, 127, 255)), (0.75, (255, 127, 0, 255)), (1.0, (127, 0, 0, 255))), "MinMax")


def colored(r, scale: ColorScale, low: float | None = None, high: float | None = None):
    """A raster of four bands, 0 to 255, from the first band of another."""
    from ..operators.local import band_combine, band_extract, stats

    one = band_extract(r, 1) if r.meta.bands > 1 else r
    if scale.scaling.lower() in ("minmax", "quantile") and low is None:
        got = stats(one).first()
        low, high = (got.min, got.max) if got else (0.0, 1.0)
    q = r.meta.quantiles[0] if r.meta.quantiles else ()
    pick = lambda k: one.map(lambda v: scale.columns(v, low or 0.0, 1.0 if high is None else high, q)[k].cast("double"), "byte")
    return band_combine(*(pick(k) for k in range(4)))
