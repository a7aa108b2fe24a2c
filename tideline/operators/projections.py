"""Coordinate systems as column arithmetic: longitude and latitude to plane coordinates and
back, so that any known system goes over geographic coordinates to any other.

Transverse Mercator follows the Krueger series to the fourth power of n in both directions;
Lambert's conformal conic has one or two standard parallels; web Mercator is on the sphere.
WGS 84, ETRS89 and NAD83 (2011) are taken as one datum: they differ by less than two
metres, and shifts between datums are not applied.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XY = tuple[Column, Column]


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis and inverse flattening; GRS 80 unless said, from which WGS 84 differs
    by a tenth of a millimetre."""

    a: float = 6378137.0
    inverse: float = 298.257222101

    @property
    def n(self) -> float:
        f = 1 / self.inverse
        return f / (2 - f)

    @property
    def e(self) -> float:
        f = 1 / self.inverse
        return math.sqrt(f * (2 - f))

    def series(self, rows: tuple) -> tuple[float, ...]:
        """Sums of the powers of n, from the first on, with the factors of each row."""
        return tuple(sum(c * self.n**k for k, c in enumerate(row, 1)) for row in rows)

    def conformal(self, phi: Column) -> Column:
        """The hyperbolic tangent's argument of the conformal latitude's sine."""
        return F.atanh(F.sin(phi)) - self.e * F.atanh(self.e * F.sin(phi))

    def latitude(self, chi: Column) -> Column:
        """Latitude from conformal latitude."""
        return chi + sum((d * F.sin(2 * k * chi) for k, d in enumerate(self.series(TO_LATITUDE), 1)), F.lit(0.0))


WGS84, GRS80 = Ellipsoid(inverse=298.257223563), Ellipsoid()
#: Factors of the powers of n in the Krueger series, forward, back and from
#: conformal to geographic latitude.
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
BACK = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
TO_LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


class Geographic:
    """Degrees of longitude and latitude themselves."""

    def forward(self, lon: Column, lat: Column) -> XY:
        return lon, lat

    def back(self, x: Column, y: Column) -> XY:
        return x, y


@dataclass(frozen=True)
class TransverseMercator:
    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    on: Ellipsoid = GRS80

    @property
    def radius(self) -> float:
        n = self.on.n
        return self.scale * self.on.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def origin(self) -> float:
        """The northing of the origin's latitude."""
        phi, e = math.radians(self.lat0), self.on.e
        xi = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
        return self.radius * (xi + sum(c * math.sin(2 * k * xi) for k, c in enumerate(self.on.series(FORWARD), 1)))

    def forward(self, lon: Column, lat: Column) -> XY:
        t = F.sinh(self.on.conformal(F.radians(lat)))
        away = F.radians(lon) - math.radians(self.lon0)
        xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for k, c in enumerate(self.on.series(FORWARD), 1):
            x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
            y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        return self.east + self.radius * x, (self.north - self.origin) + self.radius * y

    def back(self, x: Column, y: Column) -> XY:
        xi, eta = (y - (self.north - self.origin)) / self.radius, (x - self.east) / self.radius
        a, b = xi, eta
        for k, c in enumerate(self.on.series(BACK), 1):
            a = a - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
            b = b - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        lat = self.on.latitude(F.asin(F.sin(a) / F.cosh(b)))
        return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + self.lon0, F.degrees(lat)


@dataclass(frozen=True)
class LambertConic:
    """With equal standard parallels, ``scale`` holds along the one."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    east: float
    north: float
    scale: float = 1.0
    on: Ellipsoid = GRS80

    def _t(self, degrees: float) -> float:
        phi, e = math.radians(degrees), self.on.e
        return math.exp(-(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))

    def _m(self, degrees: float) -> float:
        phi = math.radians(degrees)
        return math.cos(phi) / math.sqrt(1 - (self.on.e * math.sin(phi)) ** 2)

    @property
    def cone(self) -> float:
        if self.lat1 == self.lat2:
            return math.sin(math.radians(self.lat1))
        return math.log(self._m(self.lat1) / self._m(self.lat2)) / math.log(self._t(self.lat1) / self._t(self.lat2))

    @property
    def radius(self) -> float:
        return self.scale * self.on.a * self._m(self.lat1) / (self.cone * self._t(self.lat1) ** self.cone)

    @property
    def origin(self) -> float:
        return self.radius * self._t(self.lat0) ** self.cone

    def forward(self, lon: Column, lat: Column) -> XY:
        r = self.radius * F.exp(-self.cone * self.on.conformal(F.radians(lat)))
        turn = self.cone * (F.radians(lon) - math.radians(self.lon0))
        return self.east + r * F.sin(turn), (self.north + self.origin) - r * F.cos(turn)

    def back(self, x: Column, y: Column) -> XY:
        side = math.copysign(1.0, self.cone)
        dx, dy = side * (x - self.east), side * ((self.north + self.origin) - y)
        t = F.pow(F.sqrt(dx * dx + dy * dy) / abs(self.radius), F.lit(1 / self.cone))
        lat = self.on.latitude(math.pi / 2 - 2 * F.atan(t))
        return F.degrees(F.atan2(dx, dy) / self.cone) + self.lon0, F.degrees(lat)


@dataclass(frozen=True)
class WebMercator:
    radius: float = WGS84.a

    def forward(self, lon: Column, lat: Column) -> XY:
        return self.radius * F.radians(lon), self.radius * F.atanh(F.sin(F.radians(lat)))

    def back(self, x: Column, y: Column) -> XY:
        return F.degrees(x / self.radius), F.degrees(F.atan(F.sinh(y / self.radius)))


#: Codes of geographic systems, and of single plane ones.
DEGREES = (4326, 4258, 4269, 6318)
PLANES = {
    3857: WebMercator(),
    2154: LambertConic(49.0, 44.0, 46.5, 3.0, 700_000.0, 6_600_000.0),
    3034: LambertConic(35.0, 65.0, 52.0, 10.0, 4_000_000.0, 2_800_000.0),
    3347: LambertConic(49.0, 77.0, 63.390675, -91.86666666666666, 6_200_000.0, 3_000_000.0),
}
#: Families of UTM codes: first code, its zone, how many, datum, north.
UTM = ((32601, 1, 60, WGS84, True), (32701, 1, 60, WGS84, False), (25828, 28, 11, GRS80, True), (26901, 1, 23, GRS80, True), (6330, 1, 19, GRS80, True))


def epsg(name: str | None) -> int | None:
    """The code in EPSG:4326, urn:ogc:def:crs:EPSG::4326 and the like; CRS84 is 4326."""
    if name and re.search(r"CRS:?:?84$", name):
        return 4326
    found = re.search(r"EPSG:(?:[\d.]*:)?(\d+)$", name or "", re.I)
    return int(found[1]) if found else None


def system(name: str):
    """A coordinate system by its code: geographic, UTM, Lambert (the nine French zones, 3942
    to 3950, by their rule) or web Mercator; anything else is refused."""
    code = epsg(name)
    if code in DEGREES:
        return Geographic()
    for first, zone, n, on, north in UTM:
        if code is not None and first <= code < first + n:
            return TransverseMercator((zone + code - first) * 6 - 183.0, north=0.0 if north else 10_000_000.0, on=on)
    if code is not None and 3942 <= code <= 3950:
        lat = code - 3900
        return LambertConic(lat - 0.75, lat + 0.75, lat, 3.0, 1_700_000.0, (lat - 41) * 1_000_000.0 + 200_000.0)
    if code not in PLANES:
        raise ValueError(f"the coordinate system {name} is not known")
    return PLANES[code]


def transform(x: Column, y: Column, source, target) -> XY:
    """Plane or geographic coordinates of one system as those of another; systems by code or
    as objects."""
    source, target = (system(s) if isinstance(s, str) else s for s in (source, target))
    return (x, y) if source == target else target.forward(*source.back(x, y))


def reproject(lines: DataFrame, source: str, target: str) -> DataFrame:
    """Lines of one coordinate system in another; equal codes need not be known."""
    if not source or not target:
        raise ValueError("a coordinate system is missing")
    if source == target or (epsg(source) is not None and epsg(source) == epsg(target)):
        return lines
    first, then = system(source), system(target)

    def moved(points: Column, by) -> Column:
        return F.transform(points, lambda p: F.struct(*[v.alias(c) for c, v in zip("xy", by(p["x"], p["y"]))]))

    # one lambda over the other: degrees are worked out once, not wherever the second names them
    return lines.withColumn("points", F.col("points") if first == then else moved(moved(F.col("points"), first.back), then.forward))
