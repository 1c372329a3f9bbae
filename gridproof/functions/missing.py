"""The one missing value is NULL: helpers that keep NaN out and comparisons honest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def all_present(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def greatest_of(c: Column, least: float) -> Column:
    """The larger of the two; missing stays missing, where F.greatest would skip it."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(least)))


def divided(a: Column, b: Column) -> Column:
    """a / b, with 0 / 0 missing and a / 0 infinite."""
    return F.when(b != 0, a / b).when(a == 0, None).when(b == 0, F.signum(a) * float("inf"))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a missing condition stays missing."""
    return condition.cast("double")
