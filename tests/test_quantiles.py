"""Quantiles by passes and nearest times by pieces, against built-in and plain versions."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridproof.operators import align as X
from gridproof.operators.quantiles import quantiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


def samples(n=900, seed=2):
    r = random.Random(seed)
    kinds = {"even": lambda: r.random(), "ties": lambda: float(r.choice((1, 1, 1, 2, 5))), "tail": lambda: 10.0 ** r.randint(-300, 300) * r.choice((1, -1)), "same": lambda: 4.25, "tiny": lambda: r.choice((0.0, 5e-324, 1e-323)), "huge": lambda: r.choice((1, -1)) * 1.7e308 * r.random()}
    for name, f in kinds.items():
        for k in range(n):
            yield name, k % 3 if k % 7 else None, None if k % 11 == 0 else f()
    yield "one", 1, 3.5
    yield "none", 1, None


@pytest.mark.parametrize(("few", "bins"), [(65_536, 4096), (20, 64), (1, 256)])
def test_as_percentile(spark, few, bins):
    rows = list(samples(900 if few > 1 else 60))
    df = spark.createDataFrame(rows, "kind string, part int, value double").cache()
    p = F.array(*map(F.lit, SHARES))
    want = {(r.kind, r.part): r.p for r in df.groupBy("kind", "part").agg(F.percentile("value", p).alias("p")).collect()}
    got = {(r.kind, r.part): r.q for r in quantiles(df, SHARES, "kind", "part", few=few, bins=bins).collect()}
    assert got == want
    whole = df.where("kind <> 'tail'")
    assert quantiles(whole, SHARES, few=few, bins=bins).first().q == whole.agg(F.percentile("value", p).alias("p")).first().p


def test_no_values(spark):
    df = spark.createDataFrame([], "kind string, value double")
    assert quantiles(df, SHARES, "kind").count() == 0
    assert [r.q for r in quantiles(df, SHARES).collect()] == [None]


@pytest.mark.parametrize("days", [1, 7, 5000])
def test_nearest_time(spark, days):
    r = random.Random(days)
    start = dt.datetime(2019, 12, 28)
    at = lambda: start + dt.timedelta(seconds=r.randrange(40 * 86400) // 977 * 977)
    times = [(k, at()) for k in ("a", "b", None) for _ in range(150)] + [("a", None), ("far", start)]
    asked = [(k, at()) for k in ("a", "b", None, "c") for _ in range(150)] + [("a", None), ("far", start + dt.timedelta(days=900)), ("far", start - dt.timedelta(days=900)), ("a", start - dt.timedelta(days=1))]
    asked += times[:20]
    known = {}
    for k, t in sorted(((k, t) for k, t in set(times) if t is not None), key=lambda x: x[1]):
        known.setdefault(k, []).append(t)

    def nearest(k, t):
        own = known.get(k, [])
        if t is None or not own:
            return None
        p = bisect.bisect_left(own, t)
        return min(own[max(0, p - 1) : p + 1], key=lambda x: (abs(x - t), x))

    ts = spark.createDataFrame(times, "key string, ts timestamp_ntz")
    got = X.nearest_time(ts, spark.createDataFrame(asked, "key string, at timestamp_ntz"), ["key"], days=days).collect()
    assert {(r.key, r["at"]): r.nearest for r in got} == {x: nearest(*x) for x in asked} and len(got) == len(set(asked))


def test_one_key_is_many_tasks(spark):
    """A key's line is cut by days: no window holds more than a day of it, but for the line of days."""
    ts = spark.range(50_000).select(F.lit("one").alias("key"), F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ts"))
    asked = ts.select("key", F.timestamp_add("SECOND", F.lit(31), F.col("ts")).alias("at"))
    out = X.nearest_time(ts, asked, ["key"])
    assert out.where("nearest = at + INTERVAL 29 SECONDS").count() == 49_999
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 4 and sum("[key" in w and "piece" in w.split("], [")[1] for w in windows) >= 2
