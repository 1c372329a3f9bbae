"""Cycles, bands and tables over series and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.functions.storage import stored
from gridproof.operators.aggregators import global_temporal
from gridproof.operators.align import combos
from gridproof.operators.metrics import IDENTITY, IDENTITY_OVER, applied
from gridproof.operators.quantiles import quantiles

#: Day of the year on which each month of a common year begins.
MONTH_STARTS = (1, 32, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)


def evolution(series: DataFrame, *keys: str) -> DataFrame:
    """Every day from the first to the last of a series, missing where absent."""
    span = series.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return spine.join(series.select(*keys, "date", "value"), [*keys, "date"], "left")


def _bins(series: DataFrame, by: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    last = 12 if by == "month" else 365
    rows = series.withColumn("bin", F.month("date") if by == "month" else F.dayofyear("date")).where(F.col("bin") <= last)
    spine = series.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(last))).alias("bin"))
    return rows, spine, last


def cycle(series: DataFrame, *keys: str, by: str = "month", how: Column | None = None) -> DataFrame:
    """A value for each month or day of the year (day 366 is left out); empty bins are missing.

    x: the day of a common year on which the bin begins."""
    rows, spine, _ = _bins(series, by, keys)
    have = rows.groupBy(*keys, "bin").agg((F.avg("value") if how is None else how).alias("value"))
    x = F.element_at(F.array(*map(F.lit, MONTH_STARTS)), F.col("bin")) if by == "month" else F.col("bin")
    return spine.join(have, [*keys, "bin"], "left").withColumn("x", x)


def bands(series: DataFrame, *keys: str, by: str = "month") -> DataFrame:
    """Deciles and quartiles of each bin."""
    rows, _, _ = _bins(series, by, keys)
    out = quantiles(rows, (0.1, 0.25, 0.75, 0.9), *keys, "bin")
    return out.select(*keys, "bin", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p10", "p25", "p75", "p90"))])


def sigma_band(series: DataFrame, *keys: str, by: str = "month", centre: Column | None = None) -> DataFrame:
    """Two population standard deviations about the centre of each bin."""
    rows, _, _ = _bins(series, by, keys)
    out = rows.groupBy(*keys, "bin").agg((F.avg("value") if centre is None else centre).alias("c"), F.stddev_pop("value").alias("s"))
    return out.select(*keys, "bin", (F.col("c") - F.col("s") * 2).alias("low"), (F.col("c") + F.col("s") * 2).alias("high"))


def matrix(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pair table (row, col, value) as a matrix with the mean of each row without the diagonal."""
    cells = [F.avg(F.when(F.col("col") == n, F.col("value"))).alias(n) for n in names]
    off = F.when(F.col("row") != F.col("col"), F.col("value"))
    return pairs.groupBy("row").agg(*cells, F.avg(off).alias("mean"))


def matrix_range(pairs: DataFrame) -> DataFrame:
    off = pairs.where("row <> col")
    return off.agg(F.greatest(F.min("value"), F.lit(0.0)).alias("lo"), F.max("value").alias("hi"))


def robust_range(maps: DataFrame, *keys: str) -> DataFrame:
    """Least first and greatest last percentile over the combinations of each key."""
    each = quantiles(stored(maps.select(*keys, "combo", "value"), "maps"), (0.01, 0.99), *keys, "combo")
    return each.groupBy(*keys).agg(F.min(F.get("q", F.lit(0))).alias("lo"), F.max(F.get("q", F.lit(1))).alias("hi"))


def vector_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Of time-mean vectors by cell: percentiles and range of their lengths."""
    mean = rows.groupBy(*keys, "i", "j").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    n = stored(mean.select(*keys, F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("value")), "lengths")
    out = quantiles(n, (0.0, 0.01, 0.99, 1.0), *keys)
    return out.select(*keys, *[F.get("q", F.lit(k)).alias(c) for k, c in ((1, "p1"), (2, "p99"), (0, "least"), (3, "most"))])


def scatter_stats(errors: DataFrame, *keys: str) -> DataFrame:
    """Mean error vector, radius of its spread, and a symmetric limit for drawing."""
    out = errors.groupBy(*keys).agg(*[f(c).alias(n + c) for c in ("u", "v") for f, n in ((F.avg, "mean_"), (F.stddev_pop, "sd_"))], F.max(F.greatest(F.abs("u"), F.abs("v"))).alias("top"))
    r = F.sqrt(F.col("sd_u") * F.col("sd_u") + F.col("sd_v") * F.col("sd_v"))
    return out.select(*keys, "mean_u", "mean_v", r.alias("radius"), F.greatest(F.lit(15.0), F.col("top") * 1.1, r * 1.1).alias("reach"))


def histogram(rows: DataFrame, reach: float, bins: int = 50) -> DataFrame:
    """bin, density of ``value`` in equal bins on [-reach, reach]; the upper edge is in the last bin."""
    width = 2 * reach / bins
    inside = rows.where(F.col("value").between(-reach, reach))
    k = F.least(F.floor((F.col("value") + reach) / width), F.lit(bins - 1)).cast("int")
    n = inside.agg(F.count("*").alias("all"))  # one number
    return inside.groupBy(k.alias("bin")).agg(F.count("*").alias("n")).crossJoin(n).select("bin", (F.col("n") / (F.col("all") * width)).alias("density"))


def pair_lookup(maps: DataFrame, rows: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """row, col and the map value of the pair, in either order, matched on the first two names."""
    names = F.split("combo", r"\|")
    keyed = maps.withColumn("pair", F.array_sort(F.slice(names, 1, 2)))
    wanted = F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.array_sort(F.array(F.lit(a), F.lit(b))).alias("pair")) for a in rows for b in cols if a != b])
    table = maps.sparkSession.range(1).select(F.explode(wanted).alias("w")).select("w.*")
    return keyed.join(F.broadcast(table), "pair").drop("pair")  # rows x cols names: a short table


def of_several(maps: DataFrame) -> DataFrame:
    """Rows of metrics over two datasets or more."""
    return maps.where(F.size(F.split("combo", r"\|")) >= 2)


def on_times(times: DataFrame, sources: DataFrame) -> DataFrame:
    """Each source at each time, missing where absent. times: date; sources: dataset, date, value."""
    return times.crossJoin(sources.select("dataset").distinct()).join(sources, ["dataset", "date"], "left")  # datasets: a short list


def over_reference(field: DataFrame, reference: str) -> DataFrame:
    """By date: the reference's mean, and those of the other datasets where the reference is present."""
    own = applied(combos(field.where(F.col("dataset") == reference), 1, [reference]), IDENTITY)
    others = applied(combos(field, 2, combinator=lambda names, _: [(n, reference) for n in names if n != reference]), IDENTITY_OVER)
    return global_temporal(own.unionByName(others))
