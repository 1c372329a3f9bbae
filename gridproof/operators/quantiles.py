"""Exact quantiles of groups of any size, by passes over histograms.

What ``percentile`` holds of a group in one task, all its different values, is here a histogram. A
pass deals the values between two bounds into equal bins, counts them with map-side sums, and keeps of
each wanted rank the bin that holds it, whose least and greatest value are the next bounds. Once a bin
has few enough values they are put in order. All ranks of all groups go through the same passes; two
or three do for well spread values of any number, and values that are equal stop at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridproof.functions.storage import stored

#: Bins of a pass, and values from which on a rank's bin is cut again.
BINS, FEW = 4096, 65_536


def quantiles(rows: DataFrame, shares: Sequence[float], *keys: str, value: str = "value", bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, q: for each share the quantile by linear interpolation, as an array; missing values are left out.

    Equal to ``percentile``. The rows are read once for the bounds, once for each pass and once at the end,
    so rows that are costly to make should be stored. A group without values has a missing q."""
    named = [f"g{k}" for k in range(len(keys))]
    data = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(value).cast("double").alias("v"))
    sizes = stored(data.groupBy(*named).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for k, p in enumerate(shares)]))
    asked = sizes.where("n > 0").select(*named, "n", "lo", "hi", place.alias("p")).select(*named, "n", "lo", "hi", "p.k", "p.at")
    ranks = asked.select(*named, "n", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct()
    state = ranks.select(*named, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    wide = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
    largest = sizes.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("n")))).first()[0] or 0
    while largest > few:
        state = stored(_narrowed(data, state, named, wide, bins), "bounds")
        largest = state.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("inside")))).first()[0] or 0
    found = _valued(data, state, named)
    of = lambda name: found.select(*[F.col(n).alias(f"{name}_{n}") for n in named], F.col("rank").alias(f"{name}_rank"), F.col("v").alias(name))
    on = lambda name, f: _same(named, f"{name}_") & (f("at") == F.col(f"{name}_rank"))
    met = asked.join(of("low"), on("low", F.floor)).join(of("high"), on("high", F.ceil))
    at, low, high = F.col("at"), F.col("low"), F.col("high")
    between = F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    done = met.select(*named, F.struct("k", between.alias("q")).alias("x")).groupBy(*named).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("q"))
    out = sizes.select(*[F.col(n).alias(f"all_{n}") for n in named]).join(done, _same(named, "all_"), "left")
    return out.select(*[F.col(f"all_{n}").alias(k) for k, n in zip(keys, named, strict=True)], F.when(F.size("q") > 0, F.col("q")).alias("q"))


def _same(named: Sequence[str], other: str):
    """Equality of the groups of two sides, missing keys included."""
    out = F.lit(True)
    for n in named:
        out = out & F.col(n).eqNullSafe(F.col(f"{other}{n}"))
    return out


def _within(data: DataFrame, state: DataFrame, named: Sequence[str]) -> DataFrame:
    """The values of each rank's bounds, with the rank's row."""
    s = state.select(*[F.col(n).alias(f"of_{n}") for n in named], "rank", "lo", "hi", "below")
    return data.join(s, _same(named, "of_") & F.col("v").between(F.col("lo"), F.col("hi"))).drop(*[f"of_{n}" for n in named])


def _narrowed(data: DataFrame, state: DataFrame, named: Sequence[str], wide, bins: int) -> DataFrame:
    """The state after a pass: ranks of ``wide`` bounds get those of the bin that holds them."""
    # half of each, as the difference of two large numbers of different sign is no number; bounds too near to be told
    # apart so have the greatest value in a bin of its own, so that each pass leaves something out
    width = F.col("hi") / 2 - F.col("lo") / 2
    bin_of = F.when(width > 0, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * bins), F.lit(bins - 1))).otherwise(F.when(F.col("v") < F.col("hi"), 0).otherwise(bins - 1)).cast("long")
    keys = [*named, "rank"]
    counted = _within(data, state.where(wide), named).groupBy(*keys, "below", bin_of.alias("bin")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("up_to", F.col("below") + F.sum("inside").over(w)).where((F.col("up_to") > F.col("rank")) & (F.col("up_to") - F.col("inside") <= F.col("rank")))
    return counted.select(*keys, "lo", "hi", (F.col("up_to") - F.col("inside")).alias("below"), "inside").unionByName(state.where(~wide))


def _valued(data: DataFrame, state: DataFrame, named: Sequence[str]) -> DataFrame:
    """The value at each rank."""
    keys = [*named, "rank"]
    counted = _within(data, state.where("lo < hi"), named).groupBy(*keys, "below", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("up_to", F.col("below") + F.sum("n").over(w)).where((F.col("up_to") > F.col("rank")) & (F.col("up_to") - F.col("n") <= F.col("rank")))
    return counted.select(*keys, "v").unionByName(state.where("lo = hi").select(*keys, F.col("lo").alias("v")))
