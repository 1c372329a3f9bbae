"""What a task or the driver has to hold at one time, told from plans and from small tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from gridproof.operators import covers
from gridproof.operators import curvilinear as U
from gridproof.operators import grid as G
from gridproof.operators import points as P
from gridproof.plans import catalog
from gridproof.plans import views as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["g09_idw", "g09b_idw_missing", "g09d_coverage"])
def test_interpolation_sends_no_table_to_the_driver(spark, sf_dir, key):
    assert "Broadcast" not in _plan(catalog.queries()[key](spark, sf_dir))


def test_gaussian_interpolation_sends_no_table_to_the_driver(spark, sf_dir):
    assert "Broadcast" not in _plan(catalog.queries()["g09_gaussian"](spark, sf_dir))


@pytest.mark.parametrize("key", ["g09_idw", "g09b_idw_missing"])
def test_interpolation_that_has_run_broadcast_nothing(spark, sf_dir, key):
    """The sizes that a run finds may change its joins, so the plan is that of the end."""
    done = catalog.queries()[key](spark, sf_dir)
    queries = [r["query"] for r in done.collect()]
    assert len(set(queries)) == len(queries) == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    plan = _plan(done)
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_nearest_sends_no_table_to_the_driver(spark):
    points = spark.range(9).select(F.col("id").alias("point"), (F.col("id") * 3.0).alias("lat"), F.lit(1.0).alias("lon"))
    near = G.nearest(points, points.withColumnRenamed("point", "query"), 2)
    assert "Broadcast" not in _plan(near)
    assert sorted((r["query"], r["point"]) for r in near.where("rank = 1").collect()) == [(k, k) for k in range(9)]

def test_windows_send_no_table_to_the_driver(spark):
    hours = spark.range(8).select(F.lit(1).alias("buoy_id"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), F.col("id").cast("double").alias("lat"))
    wins = P.windows(hours, P.window_starts(hours, 6, ["lat"]), 6)
    assert "Broadcast" not in _plan(wins)
    assert sorted((r["step"], r["lat"]) for r in wins.collect()) == sorted((s, float(s + k)) for k in range(3) for s in range(6))


def test_first_positions_make_no_rows_of_windows(spark, sf_dir):
    """The rows of all windows, six for each start, are neither made nor sent."""
    starts, first = (_plan(catalog.queries()[key](spark, sf_dir)) for key in ("p06_starts", "p10_first"))
    for what in ("Exchange", "Generate", "Join"):
        assert first.count(what) == starts.count(what)
    at = lambda c: F.timestamp_add("HOUR", c, F.lit("2024-01-01").cast("timestamp_ntz"))
    k = F.col("id").cast("int")
    hours = spark.range(40).where("id <> 20").select((k % 2).alias("buoy_id"), at(F.floor(k / 2).cast("int")).alias("ts"), F.when(k != 9, F.col("id").cast("double")).alias("lat"), F.when(k != 30, -F.col("id").cast("double")).alias("lon"))
    wanted = P.first_positions(P.windows(hours, P.window_starts(hours, 3, ["lat"]), 3))
    got = P.start_positions(hours.withColumns({"since": F.col("ts"), "until": F.col("ts")}), 3, ["lat"])
    assert got.columns == wanted.columns and sorted(got.collect()) == sorted(wanted.collect()) and got.count() == 30


@pytest.mark.parametrize("tolerance", [45, 300, 1440])
def test_starts_of_runs_are_those_of_hours(spark, sf_dir, tolerance):
    """Before, all hours were put in order."""
    track = V.track_ev(spark, sf_dir).where("buoy_id < 4")
    some = lambda rows: rows.withColumn("lat", F.when(F.col("lat") < 78, F.col("lat")))
    hours, runs = some(P.hourly(track, tolerance, ["lat", "lon"])).cache(), some(P.hour_runs(track, tolerance, ["lat", "lon"])).cache()
    assert runs.count() <= hours.count()
    for length, required in ((1, []), (2, ["lat"]), (6, ["lat", "lon"]), (30, [])):
        wanted = hours.join(P.window_starts(hours, length, required).withColumnRenamed("start_ts", "ts"), ["buoy_id", "ts"]).select("buoy_id", "ts", "lat", "lon")
        assert sorted(map(str, map(tuple, P.start_positions(runs, length, required).collect()))) == sorted(map(str, map(tuple, wanted.collect())))


def test_cells_of_a_cover_get_smaller_with_more_points(spark, monkeypatch):
    sizes, made = [], covers.boundary
    monkeypatch.setattr(covers, "boundary", lambda edges, size: sizes.append(size) or made(edges, size))
    n = 200
    corners = [((1 + k % 2 * 9) * math.cos(k * 2 * math.pi / n), (1 + k % 2 * 9) * math.sin(k * 2 * math.pi / n)) for k in range(n)]
    edges = spark.createDataFrame([(1, *corners[k], *corners[(k + 1) % n]) for k in range(n)], "poly_id int, x1 double, y1 double, x2 double, y2 double")
    points = spark.range(4000).select(F.col("id").alias("point"), (F.col("id") * 0.618 % 22 - 11).alias("x"), (F.col("id") * 0.414 % 22 - 11).alias("y"))
    got = {r["point"] for r in covers.inside(points, edges).collect()}
    assert got == {r["point"] for r in G.in_polygons(points, edges, 1.0).collect()}
    assert sizes[0] < 1 and len(got) > 100


def test_hours_are_made_of_sorted_samples(spark):
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    track = spark.range(1).select(F.explode(F.array(at("2024-01-01 23:30:00"), at("2024-01-02 00:30:00"), at("2024-01-02 05:00:00"))).alias("ts")).select(F.lit(1).alias("buoy_id"), "ts", F.col("ts").cast("string").alias("v"))
    got = P.hourly(track, 30, ["v"])
    assert "Union" not in _plan(got)
    assert sorted((str(r["ts"])[8:16], r["v"][8:16]) for r in got.collect()) == [("01 23:00", "01 23:30"), ("02 00:00", "02 00:30"), ("02 01:00", "02 00:30"), ("02 05:00", "02 05:00")]


@pytest.mark.parametrize("tolerance", [20, 59, 60, 90])
def test_hours_of_short_tolerances_need_no_join(spark, tolerance):
    times = ["2024-01-01 00:59:30", "2024-01-01 01:00:00", "2024-01-01 04:30:00", "2024-01-01 23:10:00", "2024-01-02 00:00:00"]
    rows = [(key, s) for key in (1, None) for s in times] + [(2, "2024-01-03 12:00:00"), (3, "2024-01-03 23:59:59"), (4, None)]
    track = spark.createDataFrame(rows, "buoy_id int, s string").select("buoy_id", F.to_timestamp_ntz("s").alias("ts"), F.col("s").alias("v"))
    hour, wanted = datetime.timedelta(hours=1), {}
    for key in (1, 2, 3):
        own = [datetime.datetime.fromisoformat(s) for k, s in rows if k == key]
        first, end = min(own).replace(minute=0, second=0), max(own)
        while first < end + hour:
            near = min((abs(t - first), -t.timestamp(), t) for t in own)
            if near[0] <= datetime.timedelta(minutes=tolerance):
                wanted[key, first] = near[2]
            first += hour
    got = P.hourly(track, tolerance, ["v"])
    assert ("Join" in _plan(got)) == (tolerance >= 60)
    assert {(r["buoy_id"], r["ts"]): r["sample_ts"] for r in got.collect()} == wanted


def test_regridding_is_dealt_into_the_tasks_of_a_shuffle(spark):
    field = spark.range(12).select(F.lit("a").alias("dataset"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(0).alias("channel"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("id").cast("double").alias("value"))
    weights = spark.range(30).select(F.lit(0).alias("src_i"), F.lit(0).alias("src_j"), F.col("id").cast("int").alias("dst_i"), F.lit(0).alias("dst_j"), F.lit(1.0).alias("w"))
    got = G.regridded(field, weights)
    assert "REPARTITION_BY_NUM" in _plan(got)
    assert sorted((r["date"].day, r["i"], r["value"]) for r in got.collect()) == sorted((d + 1, k, float(d)) for d in range(12) for k in range(30))


def test_coordinates_are_made_once_for_a_distinct_cell(spark):
    cells = spark.range(90).select((F.col("id") % 3).cast("int").alias("i"), (F.col("id") % 2).cast("int").alias("j")).distinct()
    grid = cells.select("i", "j", (F.col("i") + 70.0).alias("lat"), F.when(F.col("i") < 2, F.cos("j")).alias("lon"))
    quads = U.centre_quads(grid)
    assert "COS" not in _plan(quads).split("HashAggregate")[-1]
    assert [r["quad"]["i"] for r in quads.collect()] == [0]
