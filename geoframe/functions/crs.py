"""Closed forms between reference systems.  One datum is assumed throughout; anything else is refused."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np

# WGS 84 ellipsoid (fixed values)
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
GEOGRAPHIC = {"EPSG:4326", "OGC:CRS84", "EPSG:4269", "EPSG:4258", "CRS84"}

Transform = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _identity(x, y):
    return np.asarray(x, np.float64), np.asarray(y, np.float64)


def _to_mercator(lon, lat):
    return A * np.radians(lon), A * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))


def _from_mercator(x, y):
    return np.degrees(np.asarray(x) / A), np.degrees(2 * np.arctan(np.exp(np.asarray(y) / A)) - math.pi / 2)


class TransverseMercator:
    """Krueger's series to the sixth order in the third flattening."""

    def __init__(self, lon0: float, k0: float, fe: float, fn: float):
        n = FLATTENING / (2 - FLATTENING)
        self.lon0, self.k0, self.fe, self.fn = math.radians(lon0), k0, fe, fn
        self.r = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
        self.alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        self.beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]

    def forward(self, lon, lat):
        e = math.sqrt(E2)
        phi, lam = np.radians(lat), np.radians(lon) - self.lon0
        t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
        x, y = eta.copy(), xi.copy()
        for j, a in enumerate(self.alpha, 1):
            x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return self.fe + self.k0 * self.r * x, self.fn + self.k0 * self.r * y

    def inverse(self, x, y):
        e = math.sqrt(E2)
        xi, eta = (np.asarray(y) - self.fn) / (self.k0 * self.r), (np.asarray(x) - self.fe) / (self.k0 * self.r)
        xp, ep = xi.copy(), eta.copy()
        for j, b in enumerate(self.beta, 1):
            xp = xp - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            ep = ep - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        t = np.sin(xp) / np.sqrt(np.sinh(ep) ** 2 + np.cos(xp) ** 2)
        lam = np.arctan2(np.sinh(ep), np.cos(xp))
        tau = t.copy()
        for _ in range(6):  # Newton, from the conformal to the geographic latitude
            s = np.sinh(e * np.arctanh(e * tau / np.sqrt(1 + tau * tau)))
            ti = tau * np.sqrt(1 + s * s) - s * np.sqrt(1 + tau * tau)
            tau = tau + (t - ti) / np.sqrt(1 + ti * ti) * (1 + (1 - E2) * tau * tau) / ((1 - E2) * np.sqrt(1 + tau * tau))
        return np.degrees(lam + self.lon0), np.degrees(np.arctan(tau))


def _q(phi):
    e = math.sqrt(E2)
    s = np.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _phi_of_q(q):
    e = math.sqrt(E2)
    phi = np.arcsin(np.clip(np.asarray(q) / 2, -1, 1))
    for _ in range(12):
        s = np.sin(phi)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = (1 - E2 * s * s) ** 2 / (2 * np.cos(phi)) * (q / (1 - E2) - s / (1 - E2 * s * s) + np.log((1 - e * s) / (1 + e * s)) / (2 * e))
        phi = phi + np.where(np.isfinite(step), step, 0)
    return phi


class AlbersEqualArea:
    def __init__(self, lat0: float, lon0: float, lat1: float, lat2: float):
        p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
        m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
        q0, q1, q2 = (float(_q(p)) for p in (p0, p1, p2))
        self.lon0 = math.radians(lon0)
        self.n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
        self.c = m(p1) ** 2 + self.n * q1
        self.rho0 = A * math.sqrt(self.c - self.n * q0) / self.n

    def forward(self, lon, lat):
        rho = A * np.sqrt(self.c - self.n * _q(np.radians(lat))) / self.n
        theta = self.n * (np.radians(lon) - self.lon0)
        return rho * np.sin(theta), self.rho0 - rho * np.cos(theta)

    def inverse(self, x, y):
        x, y = np.asarray(x), self.rho0 - np.asarray(y)
        rho = np.hypot(x, y)
        return np.degrees(self.lon0 + np.arctan2(x, y) / self.n), np.degrees(_phi_of_q((self.c - (rho * self.n / A) ** 2) / self.n))


class CylindricalEqualArea:
    def __init__(self, lat_ts: float):
        p = math.radians(lat_ts)
        self.k = math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)

    def forward(self, lon, lat):
        return A * self.k * np.radians(lon), A * _q(np.radians(lat)) / (2 * self.k)

    def inverse(self, x, y):
        return np.degrees(np.asarray(x) / (A * self.k)), np.degrees(_phi_of_q(2 * np.asarray(y) * self.k / A))


def _projection(code: str):
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", code)
    if m and 1 <= int(m[2]) <= 60:
        return TransverseMercator(6 * int(m[2]) - 183, 0.9996, 500000.0, 0.0 if m[1] == "6" else 10000000.0)
    if code == "EPSG:3794":
        return TransverseMercator(15.0, 0.9999, 500000.0, -5000000.0)
    if code == "EPSG:5070":
        return AlbersEqualArea(23.0, -96.0, 29.5, 45.5)
    if code == "EPSG:6933":
        return CylindricalEqualArea(30.0)
    raise ValueError(f"no transformation for {code}")


def normal(code: str) -> str:
    code = code.strip().upper().replace("URN:OGC:DEF:CRS:", "").replace("::", ":")
    return "OGC:CRS84" if code in ("CRS84", "OGC:1.3:CRS84") else code


def transform(source: str, target: str) -> Transform:
    """x and y (longitude first) of one system to another."""
    source, target = normal(source), normal(target)
    if source == target or (source in GEOGRAPHIC and target in GEOGRAPHIC):
        return _identity
    to_geo = _identity if source in GEOGRAPHIC else _from_mercator if source == "EPSG:3857" else _projection(source).inverse
    from_geo = _identity if target in GEOGRAPHIC else _to_mercator if target == "EPSG:3857" else _projection(target).forward
    return lambda x, y: from_geo(*to_geo(x, y))
