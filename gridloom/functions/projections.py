"""Map projections of sources, to and from degrees: Mercator on the sphere, transverse Mercator with its UTM zones, Lambert's
conformal conic and Albers' equal-area conic. Datums are taken as they are: no shifts between them.

A projection is named by an EPSG code or by the text of a .prj file. Arrays in, arrays out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

WGS84 = (6378137.0, 298.257223563)


@dataclass(frozen=True)
class Projection:
    """kind: degrees, mercator, transverse, lambert or albers; lengths in metres, `unit` metres in the source's unit."""

    kind: str = "degrees"
    a: float = WGS84[0]
    inverse_flattening: float = WGS84[1]
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    k0: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    unit: float = 1.0

    @property
    def f(self) -> float:
        return 1.0 / self.inverse_flattening if self.inverse_flattening else 0.0

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    def forward(self, lon, lat) -> tuple[np.ndarray, np.ndarray]:
        """Degrees to the source's coordinates."""
        lon, lat = np.asarray(lon, float), np.asarray(lat, float)
        if self.kind == "degrees":
            return lon, lat
        with np.errstate(all="ignore"):
            x, y = getattr(self, f"_{self.kind}")(np.radians((lon - self.lon0 + 180) % 360 - 180), np.radians(lat))
        return (x + self.fe) / self.unit, (y + self.fn) / self.unit

    def inverse(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """The source's coordinates to degrees."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        if self.kind == "degrees":
            return x, y
        with np.errstate(all="ignore"):
            lam, phi = getattr(self, f"_from_{self.kind}")(x * self.unit - self.fe, y * self.unit - self.fn)
        return (np.degrees(lam) + self.lon0 + 180) % 360 - 180, np.degrees(phi)

    # --- Mercator on the sphere of the ellipsoid's greater axis

    def _mercator(self, lam, phi):
        return self.a * lam, self.a * np.arctanh(np.sin(phi))

    def _from_mercator(self, x, y):
        return x / self.a, np.arcsin(np.tanh(y / self.a))

    # --- transverse Mercator by Krueger's series in the third flattening

    def _series(self) -> tuple[float, list[float], list[float]]:
        n = self.f / (2 - self.f)
        radius = self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return radius * self.k0, alpha, beta

    def _conformal(self, phi):
        """Tangent of the conformal latitude."""
        return np.sinh(np.arctanh(np.sin(phi)) - self.e * np.arctanh(self.e * np.sin(phi)))

    def _geographic(self, t):
        phi = np.arctan(t)
        for _ in range(8):
            phi = np.arcsin(np.tanh(np.arcsinh(t) + self.e * np.arctanh(self.e * np.sin(phi))))
        return phi

    def _meridian(self) -> float:
        xi = math.atan2(float(self._conformal(math.radians(self.lat0))), 1.0)
        return xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(self._series()[1]))

    def _transverse(self, lam, phi):
        radius, alpha, _ = self._series()
        t = self._conformal(phi)
        xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.sqrt(t * t + np.cos(lam) ** 2))
        y = xi + sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
        x = eta + sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
        return radius * x, radius * (y - self._meridian())

    def _from_transverse(self, x, y):
        radius, _, beta = self._series()
        xi, eta = y / radius + self._meridian(), x / radius
        u = xi - sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(beta))
        v = eta - sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(beta))
        return np.arctan2(np.sinh(v), np.cos(u)), self._geographic(np.sin(u) / np.sqrt(np.sinh(v) ** 2 + np.cos(u) ** 2))

    # --- conics

    def _cone(self) -> tuple[float, float, float]:
        """Lambert's constant of the cone, scale, and radius of the first latitude."""
        m = lambda p: math.cos(p) / math.sqrt(1 - (self.e * math.sin(p)) ** 2)
        p0, p1, p2 = (math.radians(v) for v in (self.lat0, self.lat1, self.lat2))
        t0, t1, t2 = (self._t(p) for p in (p0, p1, p2))
        n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t1) - math.log(t2))
        scale = self.a * self.k0 * m(p1) / (n * t1**n)
        return n, scale, scale * t0**n

    def _t(self, phi):
        return np.exp(-np.arcsinh(self._conformal(phi)))

    def _lambert(self, lam, phi):
        n, scale, r0 = self._cone()
        r = scale * self._t(phi) ** n
        return r * np.sin(n * lam), r0 - r * np.cos(n * lam)

    def _from_lambert(self, x, y):
        n, scale, r0 = self._cone()
        s = math.copysign(1.0, n)
        r = s * np.hypot(x, r0 - y)
        return np.arctan2(s * x, s * (r0 - y)) / n, self._geographic(np.sinh(-np.log((r / scale) ** (1 / n))))

    def _q(self, phi):
        s = np.sin(phi)
        if not self.e:
            return 2 * s
        return (1 - self.e**2) * (s / (1 - (self.e * s) ** 2) + np.arctanh(self.e * s) / self.e)

    def _equal(self) -> tuple[float, float, float]:
        m2 = lambda p: math.cos(p) ** 2 / (1 - (self.e * math.sin(p)) ** 2)
        p0, p1, p2 = (math.radians(v) for v in (self.lat0, self.lat1, self.lat2))
        n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (m2(p1) - m2(p2)) / float(self._q(p2) - self._q(p1))
        c = m2(p1) + n * float(self._q(p1))
        return n, c, self.a * math.sqrt(c - n * float(self._q(p0))) / n

    def _albers(self, lam, phi):
        n, c, r0 = self._equal()
        r = self.a * np.sqrt(c - n * self._q(phi)) / n
        return r * np.sin(n * lam), r0 - r * np.cos(n * lam)

    def _from_albers(self, x, y):
        n, c, r0 = self._equal()
        s = math.copysign(1.0, n)
        q = (c - (np.hypot(x, r0 - y) * n / self.a) ** 2) / n
        phi = np.arcsin(np.clip(q / 2, -1, 1))
        for _ in range(12):
            w = 1 - (self.e * np.sin(phi)) ** 2
            phi = phi + w * w / (2 * np.cos(phi)) * (q - self._q(phi)) / (1 - self.e**2)
        return np.arctan2(s * x, s * (r0 - y)) / n, phi

    def degree_bounds(self, w: float, s: float, e: float, n: float, steps: int = 32) -> tuple[float, float, float, float]:
        """(west, south, east, north) of a box of the source, from points along its edges and inside."""
        x, y = np.meshgrid(np.linspace(w, e, steps + 1), np.linspace(s, n, steps + 1))
        lon, lat = self.inverse(x, y)
        if not (np.isfinite(lon).all() and np.isfinite(lat).all()):
            raise ValueError("the box leaves the projection")
        return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())


DEGREES = Projection()


def of_code(code: int) -> Projection:
    """An EPSG code: geographic systems, spherical Mercator, and UTM zones on WGS 84, NAD 83 and ETRS 89."""
    if code in (0, 4326, 4269, 4258, 4979):
        return DEGREES
    if code in (3857, 3785, 900913, 102100, 102113):
        return Projection("mercator")
    zone, south, rf = code % 100, False, WGS84[1]
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        south = code >= 32700
    elif 26901 <= code <= 26923 or 25828 <= code <= 25838:
        rf = 298.257222101
    else:
        raise ValueError(f"EPSG:{code} is not known")
    return Projection("transverse", inverse_flattening=rf, lon0=zone * 6 - 183.0, k0=0.9996, fe=500_000.0, fn=10_000_000.0 if south else 0.0)


def of_wkt(text: str) -> Projection:
    """The text of a .prj file."""
    if not text.strip() or not re.search(r"PROJCS|PROJCRS", text, re.I):
        return DEGREES
    name = (re.search(r'PROJECTION\s*\[\s*"([^"]+)"', text, re.I) or re.search(r'METHOD\s*\[\s*"([^"]+)"', text, re.I))
    kind = name[1].lower().replace(" ", "_") if name else ""
    number = r"[-+0-9.eE]+"
    given = {k.lower().replace(" ", "_"): float(v) for k, v in re.findall(rf'PARAMETER\s*\[\s*"([^"]+)"\s*,\s*({number})', text, re.I)}
    ball = re.search(rf'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*({number})\s*,\s*({number})', text, re.I)
    unit = re.findall(rf'(?<!ANGLE)UNIT\s*\[\s*"([^"]+)"\s*,\s*({number})', text, re.I)
    lengths = [float(v) for n, v in unit if not n.lower().startswith("degree")]
    scale = lengths[-1] if lengths else 1.0
    get = lambda *names, default=0.0: next((given[n] for n in names if n in given), default)
    base = dict(
        a=float(ball[1]) if ball else WGS84[0], inverse_flattening=float(ball[2]) if ball else WGS84[1], lon0=get("central_meridian", "longitude_of_center", "longitude_of_origin"), lat0=get("latitude_of_origin", "latitude_of_center"),
        lat1=get("standard_parallel_1", default=get("latitude_of_origin")), lat2=get("standard_parallel_2", default=get("standard_parallel_1", "latitude_of_origin")), k0=get("scale_factor", default=1.0),
        fe=get("false_easting") * scale, fn=get("false_northing") * scale, unit=scale,
    )
    if "transverse_mercator" in kind or kind == "gauss_kruger":
        return Projection("transverse", **base)
    if "auxiliary_sphere" in kind or "pseudo" in kind or (kind.startswith("mercator") and re.search("web|pseudo", text, re.I)):
        return Projection("mercator", **(base | {"k0": 1.0}))
    if kind.startswith("lambert_conformal_conic"):
        return Projection("lambert", **base)
    if kind.startswith("albers"):
        return Projection("albers", **base)
    raise ValueError(f"projection {kind or text[:40]!r} is not known")
