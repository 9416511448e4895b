"""Reference systems: coordinates from degrees and back, as columns or numpy arrays, by the same formulas.

Geographic degrees, spherical web Mercator, and transverse Mercator by Krueger's series to the fourth power of the third
flattening (below a millimetre within a zone). system() knows EPSG 4326, 3857, the UTM zones and Taiwan's 3825 and 3826.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import functions as F


class _Numpy:
    sin, cos, sinh, cosh, exp, log, sqrt, asin, atan, atan2, atanh, radians, degrees = np.sin, np.cos, np.sinh, np.cosh, np.exp, np.log, np.sqrt, np.arcsin, np.arctan, np.arctan2, np.arctanh, np.radians, np.degrees


def _of(x: Any) -> Any:
    return _Numpy if isinstance(x, (int, float, np.ndarray, np.floating)) else F


@dataclass(frozen=True)
class Geographic:
    def forward(self, lon: Any, lat: Any) -> tuple[Any, Any]:
        return lon, lat

    def inverse(self, x: Any, y: Any) -> tuple[Any, Any]:
        return x, y


@dataclass(frozen=True)
class Mercator:
    radius: float = 6378137.0

    def forward(self, lon: Any, lat: Any) -> tuple[Any, Any]:
        m = _of(lon)
        return m.radians(lon) * self.radius, m.atanh(m.sin(m.radians(lat))) * self.radius

    def inverse(self, x: Any, y: Any) -> tuple[Any, Any]:
        m = _of(x)
        return m.degrees(x / self.radius), m.degrees(m.atan(m.sinh(y / self.radius)))


@dataclass(frozen=True)
class TransverseMercator:
    meridian: float
    scale: float
    east: float
    north: float
    axis: float = 6378137.0
    flattening: float = 1 / 298.257223563

    def _series(self) -> tuple[float, float, list[float], list[float], list[float]]:
        n = self.flattening / (2 - self.flattening)
        there = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
        return self.scale * self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n), there, back, latitude

    def forward(self, lon: Any, lat: Any) -> tuple[Any, Any]:
        m = _of(lon)
        radius, e, there, _, _ = self._series()
        s, along = m.sin(m.radians(lat)), m.radians(lon - self.meridian)
        t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
        xi, eta = m.atan2(t, m.cos(along)), m.atanh(m.sin(along) / m.sqrt(1 + t * t))
        x = eta + sum(a * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, a in enumerate(there, 1))
        y = xi + sum(a * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, a in enumerate(there, 1))
        return self.east + radius * x, self.north + radius * y

    def inverse(self, x: Any, y: Any) -> tuple[Any, Any]:
        m = _of(x)
        radius, _, _, back, latitude = self._series()
        xi, eta = (y - self.north) / radius, (x - self.east) / radius
        a = xi - sum(b * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, b in enumerate(back, 1))
        b = eta - sum(b * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, b in enumerate(back, 1))
        chi = m.asin(m.sin(a) / m.cosh(b))
        lat = chi + sum(d * m.sin(2 * j * chi) for j, d in enumerate(latitude, 1))
        return self.meridian + m.degrees(m.atan2(m.sinh(b), m.cos(a))), m.degrees(lat)


System = Geographic | Mercator | TransverseMercator


def system(code: str | System) -> System:
    """Of a code like EPSG:32651; a system is itself."""
    if not isinstance(code, str):
        return code
    n = int(code.upper().removeprefix("EPSG:"))
    if n == 4326:
        return Geographic()
    if n == 3857:
        return Mercator()
    if n in (3825, 3826):  # two-degree zones of Taiwan
        return TransverseMercator(119.0 if n == 3825 else 121.0, 0.9999, 250_000.0, 0.0, flattening=1 / 298.257222101)
    if n // 100 in (326, 327) and 1 <= n % 100 <= 60:
        return TransverseMercator(n % 100 * 6 - 183.0, 0.9996, 500_000.0, 0.0 if n // 100 == 326 else 10_000_000.0)
    raise ValueError(f"unknown reference system {code}")


def bounds(code: str | System, west: float, south: float, east: float, north: float, steps: int = 64) -> dict[str, float]:
    """west, south, east, north of a box of degrees in another system: of points along its sides, which bend there."""
    t = np.linspace(0.0, 1.0, steps + 1)
    lon = np.concatenate([west + t * (east - west)] * 2 + [np.full(steps + 1, west), np.full(steps + 1, east)])
    lat = np.concatenate([np.full(steps + 1, south), np.full(steps + 1, north)] + [south + t * (north - south)] * 2)
    x, y = system(code).forward(lon, lat)
    return {"west": float(x.min()), "south": float(y.min()), "east": float(x.max()), "north": float(y.max())}
