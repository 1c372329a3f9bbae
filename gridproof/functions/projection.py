"""Map projections as column expressions, and geodesics on the WGS84 ellipsoid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: WGS84, and the north polar stereographic projection true at 70 N, centred on 45 W.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)
TRUE_LAT, CENTRE_LON = 70.0, -45.0
EARTH_KM = 6371.0


def _t(lat: float) -> float:
    s = ECC * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (ECC / 2)


_PHI = math.radians(TRUE_LAT)
#: rho = SCALE * t
SCALE = A * math.cos(_PHI) / math.sqrt(1 - E2 * math.sin(_PHI) ** 2) / _t(_PHI)


def to_polar(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x, y in metres."""
    p = F.radians(lat)
    s = F.sin(p) * ECC
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(ECC / 2))
    turn = F.radians(lon - CENTRE_LON)
    return t * SCALE * F.sin(turn), -t * SCALE * F.cos(turn)


def from_polar(x: Column, y: Column) -> tuple[Column, Column]:
    """lat, lon in degrees, by the series in the conformal latitude."""
    t = F.sqrt(x * x + y * y) / SCALE
    chi = F.lit(math.pi / 2) - F.atan(t) * 2
    e4, e6, e8 = E2**2, E2**3, E2**4
    lat = (
        chi
        + F.sin(chi * 2) * (E2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360)
        + F.sin(chi * 4) * (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520)
        + F.sin(chi * 6) * (7 * e6 / 120 + 81 * e8 / 1120)
        + F.sin(chi * 8) * (4279 * e8 / 161280)
    )
    lon = F.degrees(F.atan2(x, -y)) + CENTRE_LON
    return F.degrees(lat), lon - F.floor((lon + 180) / 360) * 360


def equal_area(lat: Column, lon: Column, lat0: float = 90.0, lon0: float = 0.0) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area on the sphere, in metres."""
    p, q, o = F.radians(lat), math.radians(lat0), F.radians(lon - lon0)
    k = F.sqrt(F.lit(2.0) / (1 + math.sin(q) * F.sin(p) + math.cos(q) * F.cos(p) * F.cos(o)))
    r = EARTH_KM * 1000
    return k * F.cos(p) * F.sin(o) * r, k * (F.sin(p) * math.cos(q) - F.cos(p) * F.cos(o) * math.sin(q)) * r


@F.pandas_udf(T.StructType([T.StructField("azimuth", T.DoubleType()), T.StructField("metres", T.DoubleType())]))
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    """Azimuth at the first point and distance to the second; missing where any coordinate is."""
    b = A * (1 - FLATTENING)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
    span = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam = span.copy()
    for _ in range(60):
        x = np.cos(u2) * np.sin(lam)
        y = np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
        sin_s = np.hypot(x, y)
        cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(sin_s, cos_s)
        with np.errstate(invalid="ignore", divide="ignore"):
            sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2)
        c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        new = span + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        done = np.nanmax(np.abs(new - lam), initial=0) < 1e-13
        lam = new
        if done:
            break
    k = cos2 * (A**2 - b**2) / b**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    d = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return pd.DataFrame({"azimuth": np.degrees(np.arctan2(x, y)), "metres": b * big * (sigma - d)})
