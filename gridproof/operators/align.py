"""Alignment of datasets: combinations, keyed zips, lookups, nearest times.

Fields are long tables (dataset, date, channel, i, j, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("date", "channel", "i", "j")


def names(field: DataFrame) -> list[str]:
    """The datasets in order; one short string each."""
    return [r[0] for r in field.select("dataset").distinct().orderBy("dataset").collect()]


def availability(field: DataFrame) -> DataFrame:
    return field.select("dataset", "date").distinct()


def combos(field: DataFrame, arity: int = 2, datasets: Sequence[str] | None = None, combinator: Callable[[Sequence[str], int], Iterable[tuple]] = combinations) -> DataFrame:
    """Rows (combo, date, channel, i, j, v1, v2, ...) of each combination available on the date.

    One pivot brings the datasets of a cell together; combinations are exploded from that row, so
    their number costs no further shuffle. A cell that a dataset lacks gives a missing value.
    ``datasets``: the names where they are known, else they are looked up in the field."""
    return _combined(field.select("dataset", *CELL, "value"), arity, datasets, combinator, lambda c: c["value"], ("value",))


def vector_combos(field: DataFrame, arity: int = 2, datasets: Sequence[str] | None = None, combinator: Callable[[Sequence[str], int], Iterable[tuple]] = combinations, u: int = 0, v: int = 1) -> DataFrame:
    """Rows (combo, date, channel, i, j, v1, v2, ...) as of ``combos``, each value a struct of the channels u and v; the channel is missing."""
    none = F.lit(None).cast(dict(field.dtypes)["channel"]).alias("channel")
    one = field.where(F.col("channel").isin(u, v)).select("dataset", "date", none, "i", "j", *[F.when(F.col("channel") == k, F.coalesce("value", F.lit(float("nan")))).alias(c) for c, k in (("u", u), ("v", v))])
    return _combined(one, arity, datasets, combinator, lambda c: F.struct(c["u"].alias("u"), c["v"].alias("v")), ("u", "v"))


def _combined(rows: DataFrame, arity: int, datasets: Sequence[str] | None, combinator: Callable, value: Callable[[dict[str, Column]], Column], parts: Sequence[str]) -> DataFrame:
    """Combinations of rows (dataset, cell, parts); what stands for a dataset in them is made of its parts by ``value``.

    In the pivoted row a part is null where the dataset has no row and NaN where it has a missing
    value, so whether a dataset is there on a date is told by the same columns, and both sides of
    the plan read one exchange."""
    datasets = datasets or names(rows)
    if bad := [d for d in datasets if "|" in d]:
        raise ValueError(f"a combination joins its names by |, which these hold: {bad}")
    at = {d: {p: F.col(f"d{k}_{p}") for p in parts} for k, d in enumerate(datasets)}
    there = lambda p: F.coalesce(F.col(p).cast("double"), F.lit(float("nan"))) if len(parts) == 1 else F.col(p).cast("double")
    wide = rows.groupBy(*CELL).agg(*[F.max(F.when(F.col("dataset") == d, there(p))).alias(f"d{k}_{p}") for k, d in enumerate(datasets) for p in parts])
    some = lambda d: F.coalesce(*at[d].values()).isNotNull()
    has = wide.groupBy("date").agg(*[F.max(some(d)).alias(f"has_{k}") for k, d in enumerate(datasets)])
    on = {d: F.col(f"has_{k}") for k, d in enumerate(datasets)}
    known = lambda d: value({p: F.when(~F.isnan(c), c) for p, c in at[d].items()})
    each = [F.when(_all(on[d] for d in c), F.struct(F.lit("|".join(c)).alias("combo"), *[known(d).alias(f"v{k + 1}") for k, d in enumerate(c)])) for c in combinator(datasets, arity)]
    if not each:  # fewer datasets than a combination takes
        kind = "double" if len(parts) == 1 else f"struct<{','.join(f'{p}:double' for p in parts)}>"
        each = [F.lit(None).cast(f"struct<combo:string,{','.join(f'v{k + 1}:{kind}' for k in range(arity))}>")]
    # a row of flags for each date; its size is known when the plan runs
    met = wide.join(has, "date").select(*CELL, F.explode(F.array_compact(F.array(*each))).alias("c"))
    return met.select("c.combo", *CELL, *[f"c.v{k + 1}" for k in range(arity)])


def _all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", fill: float | None = None) -> DataFrame:
    """Keyed zip of two tables with a ``value``: v1 and v2 by key.

    how: ``inner`` (common keys), ``union`` (all keys, absent ones filled), ``strict`` (keys must
    agree: the query fails on the first that doesn't)."""
    a = left.select(*keys, F.col("value").alias("v1"), F.lit(True).alias("in1"))
    b = right.select(*keys, F.col("value").alias("v2"), F.lit(True).alias("in2"))
    rows = a.join(b, list(keys), "inner" if how == "inner" else "full_outer")
    if how == "union":
        rows = rows.withColumns({"v1": F.when(F.col("in1"), F.col("v1")).otherwise(F.lit(fill).cast("double")), "v2": F.when(F.col("in2"), F.col("v2")).otherwise(F.lit(fill).cast("double"))})
    elif how == "strict":
        missing = F.concat(F.lit("key of one side alone: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
        rows = rows.withColumn("v1", F.when(F.col("in1") & F.col("in2"), F.col("v1")).otherwise(F.raise_error(missing).cast("double")))
    return rows.select(*keys, "v1", "v2")


def odd_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side alone, with the side."""
    only = lambda a, b, side: a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def component(values: Column, k: int, default: float | None = None) -> Column:
    """The k-th part of an array, from 0; the default beyond its end."""
    return F.when((F.size(values) > k) & F.lit(k >= 0), F.get(values, F.lit(k))).otherwise(F.lit(default))


def by_id(ids: Column, values: Column, wanted: Column) -> Column:
    """The value at the place of ``wanted`` among the ids; missing if it isn't there."""
    return F.get(values, F.array_position(ids, wanted).cast("int") - 1)


def nearest_time(times: DataFrame, queries: DataFrame, keys: Sequence[str], ts: str = "ts", at: str = "at", days: int = 1) -> DataFrame:
    """For each query (keys, at) the nearest time of the same keys; of two as near, the earlier.

    Times and queries are laid on one line, which is cut into pieces of so many days. Within a piece the
    neighbours are carried along it, and what lies beyond its ends comes from the line of pieces, a row
    for each, so a key with a long history is many tasks' work and no range join is needed. A query
    whose keys have no time, or that is missing itself, gets none."""
    known = times.select(*keys, F.col(ts).alias("t"), F.lit(False).alias("asked")).distinct()
    asked = queries.select(*keys, F.col(at).alias("t"), F.lit(True).alias("asked")).distinct()
    line = known.where("t IS NOT NULL").unionByName(asked).withColumn("piece", F.floor(F.datediff(F.to_date("t"), F.lit("1970-01-01").cast("date")) / days))
    own = F.when(~F.col("asked"), F.col("t"))
    # frames that end at the row take one step for each; the way ahead is the way back in the other order
    so_far = lambda w, end=0: w.rowsBetween(Window.unboundedPreceding, end)
    pieces = line.groupBy(*keys, "piece").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    w = Window.partitionBy(*keys)
    pieces = pieces.select(*[F.col(k).alias(f"of_{n}") for n, k in enumerate((*keys, "piece"))], F.last("last", True).over(so_far(w.orderBy("piece"), -1)).alias("before"), F.last("first", True).over(so_far(w.orderBy(F.desc("piece")), -1)).alias("after"))
    w = Window.partitionBy(*keys, "piece")
    line = line.withColumn("back", F.last(own, True).over(so_far(w.orderBy("t", "asked")))).withColumn("ahead", F.last(own, True).over(so_far(w.orderBy(F.desc("t"), F.desc("asked"))))).where("asked")
    met = line.join(pieces, _all(F.col(k).eqNullSafe(F.col(f"of_{n}")) for n, k in enumerate((*keys, "piece"))), "left")
    back, ahead = F.coalesce("back", "before"), F.coalesce("ahead", "after")
    gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    pick = F.when(ahead.isNull() | (gap(back, F.col("t")) <= gap(F.col("t"), ahead)), back).otherwise(ahead)
    return met.select(*keys, F.col("t").alias(at), F.when(F.col("t").isNotNull(), pick).alias("nearest"))


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], f: Callable[..., Column], how: str = "inner") -> DataFrame:
    """keys, value: ``f`` of the keys' columns and the values of both sides; a side that lacks a key is missing."""
    both = left.select(*keys, F.col("value").alias("v1")).join(right.select(*keys, F.col("value").alias("v2")), list(keys), how)
    return both.select(*keys, f(*map(F.col, keys), F.col("v1"), F.col("v2")).alias("value"))
