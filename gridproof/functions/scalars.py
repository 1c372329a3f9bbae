"""Scalar functions on angles, longitudes, units and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import null_if_nan

#: Unit factors to metres a second, kelvin offset, knots-like chart speed to cm/s.
UNITS = {"m/s": 1.0, "cm/s": 0.01, "mm/s": 0.001, "km/h": 1 / 3.6}
KELVIN = 273.15
CHART_SPEED = 51.444


def modulo(c: Column, n: float) -> Column:
    """Remainder that is never negative."""
    return c - F.floor(c / n) * n


def polar_to_cartesian(speed: Column, angle: Column, from_direction: bool = False) -> tuple[Column, Column]:
    a = F.radians(F.lit(270.0) - angle if from_direction else angle)
    return speed * F.cos(a), speed * F.sin(a)


def cartesian_to_polar(u: Column, v: Column, from_direction: bool = False) -> tuple[Column, Column]:
    angle = modulo(F.degrees(F.atan2(v, u)), 360.0)
    return F.sqrt(u * u + v * v), modulo(F.lit(270.0) - angle, 360.0) if from_direction else angle


def stretch(u: Column, v: Column, lat: Column) -> tuple[Column, Column]:
    """Widen u by the latitude's cosine and scale both back to the old length."""
    wide = F.when(F.cos(F.radians(lat)) != 0, u / F.cos(F.radians(lat)))
    k = F.sqrt(u * u + v * v) / F.greatest(F.sqrt(wide * wide + v * v), F.lit(1e-6))
    return wide * k, v * k


def wrap_longitude(lon: Column, centre: float = 0.0) -> Column:
    """To [centre - 180, centre + 180)."""
    return modulo(lon - centre + 180.0, 360.0) - 180.0 + centre


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def circular_mean(lon: Column) -> Column:
    """Aggregate: mean direction in [-180, 180); nothing to average gives 0."""
    mean = F.degrees(F.atan2(F.avg(F.sin(F.radians(lon))), F.avg(F.cos(F.radians(lon)))))
    return F.coalesce(wrap_longitude(mean), F.lit(0.0))


def hours_in_period(date: Column, period: str = "month") -> Column:
    """Hours of the day or month that holds the date."""
    if period == "day":
        return F.when(date.isNotNull(), F.lit(24))
    start = F.trunc(date, period)
    return F.datediff(F.add_months(start, {"month": 1, "quarter": 3, "year": 12}[period]), start) * 24


def norm(parts: Column) -> Column:
    """L2 norm of an array; null for a null array or a null part."""
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x * x))


def times(c: Column, n: float) -> Column:
    return c * n


def clip_high(c: Column, most: float) -> Column:
    """Values from ``most`` on are missing."""
    return F.when(c < most, c)


def to_hour(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts)


def epoch_seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def unit_factor(name: Column) -> Column:
    """Factor to metres a second of a unit's name; unknown names are missing."""
    n = F.regexp_replace(F.lower(F.trim(name)), r"\s+", "")
    out = F.lit(None).cast("double")
    for unit, k in UNITS.items():
        out = F.when(n == unit, k).otherwise(out)
    return out


def acos_degrees(c: Column) -> Column:
    return null_if_nan(F.degrees(F.acos(c)))


def log2(v: Column) -> Column:
    """Binary logarithm, rounded once: that of Spark is a quotient of two and a whole number for values just under a power of two."""
    near = F.rint(F.log2(v))
    least = F.least(near, F.lit(1023.0))
    return F.when(near < float("inf"), least + F.log1p(v / F.pow(F.lit(2.0), least) - 1) / math.log(2)).otherwise(near)
