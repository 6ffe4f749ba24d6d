"""Albers equal-area conic on the GRS80 ellipsoid (Snyder 1987), as column expressions.

The published parameters of EPSG:3338 are the defaults: parallels 55 and 65 N, origin 50 N 154 W.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 axis and flattening.
AXIS = 6378137.0
FLATTENING = 1 / 298.257222101
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)


def _q(sin: float) -> float:
    return (1 - E2) * (sin / (1 - E2 * sin * sin) - math.log((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - E2 * math.sin(lat) ** 2)


class Albers:
    def __init__(self, first: float = 55.0, second: float = 65.0, lat0: float = 50.0, lon0: float = -154.0) -> None:
        p1, p2 = math.radians(first), math.radians(second)
        q1, q2 = _q(math.sin(p1)), _q(math.sin(p2))
        self.n = (_m(p1) ** 2 - _m(p2) ** 2) / (q2 - q1)
        self.c = _m(p1) ** 2 + self.n * q1
        self.rho0 = AXIS * math.sqrt(self.c - self.n * _q(math.sin(math.radians(lat0)))) / self.n
        self.lon0 = lon0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Metres east and north; longitudes wrap, so that the far west isn't cut off at 180."""
        sin = F.sin(F.radians(lat))
        q = (1 - E2) * (sin / (1 - E2 * sin * sin) - F.ln((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))
        rho = AXIS * F.sqrt(self.c - self.n * q) / self.n
        d = lon - self.lon0
        theta = self.n * F.radians(d - 360.0 * F.rint(d / 360.0))
        return rho * F.sin(theta), self.rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Degrees east and north, by Newton steps from the sphere."""
        dy = self.rho0 - y
        q = (self.c - (x * x + dy * dy) * (self.n / AXIS) ** 2) / self.n

        def step(phi: Column, _: Column) -> Column:
            sin = F.sin(phi)
            w = 1 - E2 * sin * sin
            return phi + w * w / (2 * F.cos(phi)) * (q / (1 - E2) - sin / w + F.ln((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))

        # A fold, so that the expression stays small.
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.asin(q / 2), step)
        lon = self.lon0 + F.degrees(F.atan2(x, dy)) / self.n
        return lon - 360.0 * F.rint(lon / 360.0), F.degrees(phi)


ALASKA = Albers()


def in_alaska(lat: Column, lon: Column) -> Column:
    """Latitudes 50 to 72, longitudes up to 129 W or beyond 170 E."""
    return lat.between(50, 72) & ((lon <= -129) | (lon >= 170))
