"""Derived fields: delays, dynamics, extent, area, volume, pooling, encodings."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.functions.missing import flag

CELL = ["date", "channel", "i", "j"]


def delayed(field: DataFrame, days: int) -> DataFrame:
    """The value of date d - days at date d."""
    return field.withColumns({"date": F.date_add("date", days), "dataset": F.concat("dataset", F.lit(f"_t-{days}d"))})


def dynamics(field: DataFrame, days: int) -> DataFrame:
    """x(d) - x(d - days), by an equality join, so a gap gives no row."""
    before = field.select("dataset", F.date_add("date", days).alias("date"), "channel", "i", "j", F.col("value").alias("old"))
    rows = field.join(before, ["dataset", *CELL])
    return rows.select(F.concat("dataset", F.lit(f"_t-{days}d_dynamics")).alias("dataset"), *CELL, (F.col("value") - F.col("old")).alias("value"))


def extent(field: DataFrame, least: float) -> DataFrame:
    """100 where the value reaches the threshold, else 0; missing counts as 0."""
    return field.withColumn("value", F.when(F.col("value") >= least, 100.0).otherwise(0.0))


def extent01(field: DataFrame, least: float) -> DataFrame:
    """1 or 0; missing stays missing. For steps within a day, before their mean."""
    return field.withColumn("value", flag(F.col("value") >= least))


def daily_mean(steps: DataFrame, only: list[int] | None = None) -> DataFrame:
    """Mean of a day's steps (column ``step``), or of some of them."""
    rows = steps if only is None else steps.where(F.col("step").isin(only))
    return rows.groupBy("dataset", *CELL).agg(F.avg("value").alias("value"))


def scaled_by_area(field: DataFrame, grid: DataFrame, scale: float | None = None) -> DataFrame:
    """Value times cell area; areas from 1e10 on are missing. A field above 1 anywhere is in percent."""
    if scale is None:
        tops = field.groupBy("dataset", "date").agg(F.when(F.max("value") > 1, 0.01).otherwise(1.0).alias("k"))
        field = field.join(tops, ["dataset", "date"])
    else:
        field = field.withColumn("k", F.lit(scale))
    area = F.when(F.col("area") < 1e10, F.col("area"))
    return field.join(grid.select("i", "j", "area"), ["i", "j"]).select("dataset", *CELL, (F.col("value") * F.col("k") * area).alias("value"))


def volume(sic: DataFrame, thick: DataFrame, grid: DataFrame, scale: float | None = None) -> DataFrame:
    area = scaled_by_area(sic, grid, scale)
    return area.join(thick.select(*CELL, F.col("value").alias("h")), CELL).select("dataset", *CELL, (F.col("value") * F.col("h")).alias("value"))


def surface(field: DataFrame) -> DataFrame:
    return field.where("channel = 0")


def with_coordinates(field: DataFrame, grid: DataFrame, first: int) -> DataFrame:
    """The field with latitude and longitude as channels ``first`` and ``first + 1``."""
    steps = field.select("dataset", "date").distinct()
    both = F.explode(F.array(F.struct(F.lit(first).alias("channel"), F.col("lat").alias("value")), F.struct(F.lit(first + 1).alias("channel"), F.col("lon").alias("value"))))
    coords = steps.crossJoin(grid.select("i", "j", both.alias("c")))  # every step has every cell: this is the result's size
    return field.select("dataset", *CELL, "value").unionByName(coords.select("dataset", "date", "c.channel", "i", "j", "c.value"))


def time_encoding(day_of_year: Column, hour: Column, i: Column, j: Column) -> tuple[Column, Column]:
    """Waves over the grid that turn with the day of the year (from 0) and the hour."""

    def speeds(part: Column) -> tuple[Column, Column]:
        one = F.abs(F.abs(F.lit(0.5) - part) - 0.5) + 0.05
        two = F.abs(F.abs(F.lit(0.25) - part) - 0.5) + 0.05
        return one, two

    a, b = speeds(day_of_year / F.lit(365.0))
    c, d = speeds(hour / F.lit(24.0))
    f = 2 * math.pi / 10
    return (F.sin(a * j * f) + F.sin(b * i * f)) / 2, (F.cos(c * j * f) + F.cos(d * i * f)) / 2


def concat_channels(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    return first.unionByName(second.withColumn("channel", F.col("channel") + offset))


def block_mean(field: DataFrame, step: int, height: int, width: int, least: int | None = None) -> DataFrame:
    """Means of step x step blocks of whole ones; missing with fewer than ``least`` values (default half)."""
    least = step * step // 2 if least is None else least
    inside = field.where((F.col("i") < height // step * step) & (F.col("j") < width // step * step))
    keys = ["dataset", "date", "channel", F.floor(F.col("i") / step).cast("int").alias("i"), F.floor(F.col("j") / step).cast("int").alias("j")]
    return inside.groupBy(*keys).agg(F.when(F.count("value") >= least, F.avg("value")).alias("value"))


def every_nth(field: DataFrame, n: int) -> DataFrame:
    return field.where((F.col("i") % n == 0) & (F.col("j") % n == 0))


def cropped(field: DataFrame, check: bool = False) -> DataFrame:
    """Cells within the box of present values of each dataset and date; with ``check`` a gap in it is an error."""
    keys = ["dataset", "date", "channel"]
    has = field.where("value IS NOT NULL")
    box = has.groupBy(*keys).agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"), F.count("*").alias("n"))
    if check:
        full = F.col("n") == (F.col("i1") - F.col("i0") + 1) * (F.col("j1") - F.col("j0") + 1)
        box = box.withColumn("i0", F.when(full, F.col("i0")).otherwise(F.raise_error(F.lit("the box has missing cells")).cast("int")))
    rows = field.join(box, keys).where(F.col("i").between(F.col("i0"), F.col("i1")) & F.col("j").between(F.col("j0"), F.col("j1")))
    return rows.select("dataset", "date", "channel", (F.col("i") - F.col("i0")).alias("i"), (F.col("j") - F.col("j0")).alias("j"), "value")


def profile(field: DataFrame, dates: DataFrame, offset: float = 0.0) -> DataFrame:
    """date, channel, value on a spine of dates: the mean over cells, less an offset, missing where absent."""
    spine = dates.crossJoin(field.select("channel").distinct())  # channels: a short list
    have = field.groupBy("date", "channel").agg((F.avg("value") - offset).alias("value"))
    return spine.join(have, ["date", "channel"], "left")


def value_range(rows: DataFrame) -> DataFrame:
    """lo, hi of all values; symmetric if they lie on both sides of 0."""
    both = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    top = F.greatest(F.abs("lo"), F.abs("hi"))
    across = (F.col("lo") < 0) & (F.col("hi") > 0)
    return both.select(F.when(across, -top).otherwise(F.col("lo")).alias("lo"), F.when(across, top).otherwise(F.col("hi")).alias("hi"))


def transformed(field: DataFrame, f: Callable[[Column], Column], datasets: Sequence[str] | None = None) -> DataFrame:
    """The field with ``f`` of its values, of the named datasets alone if they are given; missing stays missing."""
    own = F.col("value").isNotNull() & (F.lit(True) if datasets is None else F.col("dataset").isin(list(datasets)))
    return field.withColumn("value", F.when(own, f(F.col("value"))).otherwise(F.col("value")))
