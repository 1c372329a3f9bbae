"""Aggregators: group-bys of a metric table (metric, combo, date, channel, i, j, value).

Means are kept as sum and count where they are to be merged with others. A ``Statistic`` says so for
any state: how it is made of values, how two of a key become one, and what comes out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.functions.scalars import log2

RUN = ("metric", "combo")
#: Months of the default seasons.
SEASONS = {"FMA": (2, 3, 4), "MJJ": (5, 6, 7), "ASO": (8, 9, 10), "NDJ": (11, 12, 1)}


def partial(rows: DataFrame, *keys: str, value: Column | None = None) -> DataFrame:
    """sum and cnt of the present values by key; a key without any has a missing sum and count 0."""
    v = F.col("value") if value is None else value
    return rows.groupBy(*keys).agg(F.sum(v).alias("sum"), F.count(v).alias("cnt"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt"))


def mean_of(parts: DataFrame) -> DataFrame:
    """Mean in place of sum and count; missing where nothing was counted."""
    return parts.withColumn("value", F.when(F.col("cnt") > 0, F.col("sum") / F.col("cnt"))).drop("sum", "cnt")


@dataclass(frozen=True)
class Statistic:
    """What an aggregation keeps of the values of a key, in a form that can be stored and merged.

    kind: the state's fields and types; first: aggregate expressions for them over a column of values;
    merge: the fields of one state made of two; finish: the result. A state of ``parts`` is a row for
    each part that a value can fall in (``part`` of a value), and ``finish`` takes the array of
    structs (part, state) of a key, by part."""

    name: str
    kind: str
    first: Callable[[Column], dict[str, Column]]
    merge: Callable[[Column, Column], dict[str, Column]]
    finish: Callable[[Column], Column]
    part: Callable[[Column], Column] | None = None

    def state(self, fields: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(f"struct<{self.kind}>")

    def folded(self, states: Column) -> Column:
        """One state of an array of them, in their order; missing for an empty one."""
        return F.aggregate(F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0))), F.get(states, 0), lambda a, b: self.state(self.merge(a, b)))


def _either(f: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """f of both, or the one that is there."""
    return F.coalesce(f(a, b), a, b)


MEAN = Statistic(
    "mean", "sum:double,cnt:bigint", lambda v: {"sum": F.sum(v), "cnt": F.count(v)}, lambda a, b: {"sum": _either(lambda x, y: x + y, a["sum"], b["sum"]), "cnt": a["cnt"] + b["cnt"]}, lambda s: F.when(s["cnt"] > 0, s["sum"] / s["cnt"])
)
TOTAL = Statistic("total", MEAN.kind, MEAN.first, MEAN.merge, lambda s: F.coalesce(s["sum"], F.lit(0.0)))
LEAST = Statistic("least", "of:double", lambda v: {"of": F.min(v)}, lambda a, b: {"of": F.least(a["of"], b["of"])}, lambda s: s["of"])
MOST = Statistic("most", "of:double", lambda v: {"of": F.max(v)}, lambda a, b: {"of": F.greatest(a["of"], b["of"])}, lambda s: s["of"])


def _spread_of(a: Column, b: Column) -> dict[str, Column]:
    """Count, mean and sum of squares about it of two sets together, without a difference of large sums."""
    n = a["cnt"] + b["cnt"]
    apart, share = b["mean"] - a["mean"], F.when(n > 0, b["cnt"] / n)
    return {"cnt": n, "mean": F.coalesce(a["mean"] + apart * share, a["mean"], b["mean"]), "squares": F.coalesce(a["squares"] + b["squares"] + apart * apart * a["cnt"] * share, a["squares"], b["squares"])}


DEVIATION = Statistic(
    "deviation", "cnt:bigint,mean:double,squares:double", lambda v: {"cnt": F.count(v), "mean": F.avg(v), "squares": F.var_pop(v) * F.count(v)}, _spread_of, lambda s: F.when(s["cnt"] > 0, F.sqrt(s["squares"] / s["cnt"]))
)


def leading_bits(v: Column, bits: int) -> Column:
    """The value cut towards zero to so many binary digits after its first."""
    step = F.pow(F.lit(2.0), F.floor(log2(F.abs(v))) - bits)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.floor(F.abs(v) / step) * step)


def quantile(p: float, bits: int = 7) -> Statistic:
    """The least value that a share ``p`` of the values does not pass, each cut to ``bits`` binary digits after its first.

    Its relative error is under 2 ** -bits. A key has 2 ** bits parts at most for each power of two
    between its smallest and largest size, however many values it has; counts of parts add up, so
    merged states are those of one run."""

    def finish(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x["state"]["cnt"])
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("at"))
        step = lambda a, x: F.struct((a["n"] + x["state"]["cnt"]).alias("n"), F.when(a["at"].isNull() & (a["n"] + x["state"]["cnt"] >= total * p), x["part"]).otherwise(a["at"]).alias("at"))
        return F.aggregate(F.filter(parts, lambda x: x["part"].isNotNull()), start, step, lambda a: a["at"])

    return Statistic(f"quantile_{p:g}_{bits}", "cnt:bigint", lambda v: {"cnt": F.count(v)}, lambda a, b: {"cnt": a["cnt"] + b["cnt"]}, finish, lambda v: leading_bits(v, bits))


MEDIAN = quantile(0.5)
STATISTICS = (MEAN, TOTAL, LEAST, MOST, DEVIATION, MEDIAN)


def global_temporal(rows: DataFrame) -> DataFrame:
    """Mean over cells by date; a date with missing values alone keeps its row."""
    return mean_of(partial(rows, *RUN, "date", "channel"))


def global_integrated(rows: DataFrame, area: DataFrame | None = None) -> DataFrame:
    """Sum over cells by date, times the cell's area; a date with missing values alone gives 0."""
    if area is None:
        return _total(partial(rows, *RUN, "date", "channel"))
    with_area = rows.join(area.select("i", "j", "area"), ["i", "j"])
    return _total(partial(with_area, *RUN, "date", "channel", value=F.col("value") * F.col("area")))


def _total(parts: DataFrame) -> DataFrame:
    return parts.withColumn("value", F.coalesce("sum", F.lit(0.0))).drop("sum", "cnt")


def regional_temporal(rows: DataFrame, regions: DataFrame, ids: Sequence[int] | None = None, integrated: bool = False, area: DataFrame | None = None) -> DataFrame:
    """By region and date; label 0 is no region. A region without a present value has a missing mean, or sum 0."""
    regions = regions.where("region_id <> 0")
    if ids is not None:
        regions = regions.where(F.col("region_id").isin(list(ids)))
    # the rows are read once: those of no region keep their date's place under a missing region
    inside = rows.join(regions.select("i", "j", "region_id"), ["i", "j"], "left")
    value = F.col("value")
    if area is not None:
        inside, value = inside.join(area.select("i", "j", "area"), ["i", "j"], "left"), F.col("value") * F.col("area")
    parts = partial(inside, *RUN, "region_id", "date", "channel", value=value)
    state = F.when(F.col("region_id").isNotNull(), F.struct("region_id", F.struct("sum", "cnt")))
    dates = parts.groupBy(*RUN, "date", "channel").agg(F.map_from_entries(F.collect_list(state)).alias("of"))  # an entry for each region
    every = dates.crossJoin(regions.select("region_id").distinct()).withColumn("p", F.try_element_at("of", "region_id"))  # regions: a short list
    parts = every.select(*RUN, "region_id", "date", "channel", F.col("p.sum").alias("sum"), F.coalesce("p.cnt", F.lit(0)).alias("cnt"))
    return _total(parts) if integrated else mean_of(parts)


def spatial(rows: DataFrame) -> DataFrame:
    """Mean over dates by cell."""
    return mean_of(partial(rows, *RUN, "channel", "i", "j"))


def average(rows: DataFrame) -> DataFrame:
    """One mean over all values, each cell counting alike."""
    return mean_of(partial(rows, *RUN))


def seasonal_spatial(rows: DataFrame, seasons: dict[str, Sequence[int]] = SEASONS) -> DataFrame:
    """Mean by season and cell; seasons may overlap; a month of no season is an error."""
    if bad := [m for ms in seasons.values() for m in ms if not 1 <= m <= 12]:
        raise ValueError(f"no such months: {bad}")
    of = F.create_map(*[x for m in range(1, 13) for x in (F.lit(m), F.array(*[F.lit(s) for s, ms in seasons.items() if m in ms]).cast("array<string>"))])
    own = F.element_at(of, F.month("date"))
    own = F.when(F.size(own) > 0, own).otherwise(F.raise_error(F.concat(F.lit("no season has month "), F.month("date").cast("string"))))
    return mean_of(partial(rows.withColumn("season", F.explode(own)), *RUN, "season", "channel", "i", "j"))


def at_points(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Interpolated value at each named point by date. weights: set, point, i, j, w."""
    inside = rows.join(weights, ["i", "j"])
    some = F.when(F.col("value").isNotNull(), F.col("w"))
    total = inside.groupBy(*RUN, "set", "point", "date", "channel").agg(F.sum(F.col("value") * F.col("w")).alias("a"), F.sum(some).alias("b"))
    return total.withColumn("value", F.when(F.col("b") > 0, F.col("a") / F.col("b"))).drop("a", "b")


def over_points(points: DataFrame) -> DataFrame:
    return mean_of(partial(points, *RUN, "set", "date", "channel"))


def raw(rows: DataFrame) -> DataFrame:
    return rows.select(*RUN, "date", "channel", "i", "j", "value")
