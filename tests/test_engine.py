"""Edge cases of the verification engine, by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridproof.functions import projection as J
from gridproof.functions import scalars as Z
from gridproof.operators import aggregators as A
from gridproof.operators import align as X
from gridproof.operators import derived as D
from gridproof.operators import forecast as FC
from gridproof.operators import grid as G
from gridproof.operators import metrics as M
from gridproof.operators import points as P
from gridproof.plans import cycles as C
from gridproof.plans import validate as R
from gridproof.sources import catalog, readers

FIELD = "dataset string, date date, channel int, i int, j int, value double"
D1, D2, D3 = (dt.date(2020, 2, d) for d in (1, 2, 3))
T = lambda *a: dt.datetime(2024, 1, 1, *a)


def field(spark, *rows):
    return spark.createDataFrame([(d, t, 0, i, j, v) for d, t, i, j, v in rows], FIELD)


def values(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.value for r in df.collect()}


def test_missing_values_and_absent_dates(spark):
    f = field(spark, ("a", D1, 0, 0, 1.0), ("a", D1, 0, 1, None), ("b", D1, 0, 0, 3.0), ("b", D1, 0, 1, 5.0), ("a", D2, 0, 0, None), ("b", D2, 0, 0, 1.0), ("a", D3, 0, 0, 1.0))
    rows = M.applied(X.combos(f), M.MAE)
    assert values(A.global_temporal(rows), "date") == {D1: 2.0, D2: None}
    assert values(A.global_integrated(rows), "date") == {D1: 2.0, D2: 0.0}
    assert A.average(rows).first().value == 2.0
    merged = A.mean_of(A.merged(A.partial(rows, "metric", "combo", "date").unionByName(A.partial(rows, "metric", "combo", "date")), "metric", "combo"))
    assert merged.first().value == 2.0


def one(spark, metric, *v):
    row = spark.createDataFrame([v], ", ".join(f"v{k + 1} double" for k in range(len(v))))
    return row.select(metric.column()).first()[0]


def test_metrics(spark):
    assert one(spark, M.RELATIVE_ERROR, 0.0, 0.0) is None and one(spark, M.RELATIVE_ERROR, 2.0, 0.0) == math.inf
    assert one(spark, M.sic_success(), 14.9, 35.1) == 0.0 and one(spark, M.sic_success(), 14.9, 29.9) == 1.0
    assert one(spark, M.sic_success(True), 0.25, 0.45) == 0.0 and one(spark, M.sic_success(), None, 1.0) is None
    assert one(spark, M.thick_success(), 1.0, 1.0, None) == 0.0 and one(spark, M.thick_success(require_init=True), 1.0, 1.0, None) is None
    assert one(spark, M.IDENTITY_OVER, 1.0, None) is None
    chain = M.sequential(M.DIFFERENCE, M.SQUARED)
    assert chain.name == "difference→sqared" and one(spark, chain, 1.0, 4.0) == 9.0
    with pytest.raises(ValueError):
        M.sequential(M.MSE)
    short = spark.createDataFrame([(0.05, 0.0, 0.0, 0.05), (1.0, 0.0, 0.0, 2.0)], "a double, b double, c double, d double")
    assert [r[0] and round(r[0], 6) for r in short.select(M.angle_error(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [None, 90.0]


def test_zip(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, None)], "k int, value double"), spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, value double")
    assert sorted(map(tuple, X.paired(a, b, ["k"], "union", -1.0).collect())) == [(1, 2.0, -1.0), (2, None, 5.0), (3, -1.0, 6.0)]
    with pytest.raises(Exception, match="key of one side"):
        X.paired(a, b, ["k"], "strict").collect()
    assert sorted(map(tuple, X.odd_keys(a, b, ["k"]).collect())) == [(1, "left"), (3, "right")]


def test_seasons_and_cycles(spark):
    rows = M.applied(X.combos(field(spark, ("a", dt.date(2020, 1, 5), 0, 0, 1.0), ("a", D1, 0, 0, 3.0)), 1), M.IDENTITY)
    assert values(A.seasonal_spatial(rows), "season") == {"NDJ": 1.0, "FMA": 3.0}
    with pytest.raises(ValueError):
        A.seasonal_spatial(rows, {"x": [13]})
    with pytest.raises(Exception, match="no season"):
        A.seasonal_spatial(rows, {"x": [1]}).collect()
    days = spark.createDataFrame([("a", dt.date(2020, 2, 29), 1.0), ("a", dt.date(2020, 12, 31), 9.0)], "combo string, date date, value double")
    have = {k: v for k, v in values(C.cycle(days, "combo", by="day"), "bin").items() if v is not None}
    assert have == {60: 1.0} and C.cycle(days, "combo", by="day").count() == 365
    assert C.evolution(days, "combo").count() == 307


def test_derived(spark):
    f = field(spark, ("a", D1, 0, 0, 5.0), ("a", D3, 0, 0, 7.0), ("a", D3, 0, 1, None))
    assert D.dynamics(f, 1).count() == 0 and values(D.dynamics(f, 2), "date") == {D3: 2.0}
    assert values(D.extent(f, 6), "date", "j") == {(D1, 0): 0.0, (D3, 0): 100.0, (D3, 1): 0.0}
    assert values(D.extent01(f, 6), "date", "j") == {(D1, 0): 0.0, (D3, 0): 1.0, (D3, 1): None}
    with pytest.raises(Exception, match="missing cells"):
        D.cropped(field(spark, ("a", D1, 0, 0, 1.0), ("a", D1, 1, 1, 1.0)), check=True).collect()


def test_tracks(spark):
    t = spark.createDataFrame([("b", T(0, 15), 1.0), ("b", T(1, 45), 2.0)], "buoy_id string, ts timestamp_ntz, x double")
    got = {r.ts: r.x for r in P.hourly(t, 45, ["x"]).collect()}
    assert got == {T(0): 1.0, T(1): 2.0, T(2): 2.0}
    gap = spark.createDataFrame([("b", T(0), 1.0), ("b", T(1), None), ("b", T(2), 1.0)], "buoy_id string, ts timestamp_ntz, x double")
    assert P.window_starts(gap, 2, ["x"]).count() == 0 and P.window_starts(gap, 2, []).count() == 2
    twice = spark.createDataFrame([("b", T(0), 1, 5.0), ("b", T(0), 2, 6.0)], "buoy_id string, ts timestamp_ntz, k int, x double")
    assert [r.x for r in P.keep_last(twice, "k").collect()] == [6.0]
    two = spark.createDataFrame([("b", T(0), 0.0, 0.0), ("b", T(1), 0.0, 1.0), ("c", T(2), 50.0, 0.0)], "buoy_id string, ts timestamp_ntz, lat double, lon double")
    d = {(r.buoy_id, r.ts): r for r in P.drift(two).collect()}
    assert abs(d["b", T(0)].u_cm_s - 111319.490793 / 3600 * 100) < 1e-4 and d["b", T(1)].u_cm_s is None and d["c", T(2)].v_cm_s is None


def test_geodesic_and_projection(spark):
    row = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), (70.0, 5.0, 70.0, 5.0)], "a double, b double, c double, d double")
    got = [r.g for r in row.select(J.geodesic("a", "b", "c", "d").alias("g")).collect()]
    assert abs(got[0].metres - 111319.4907932) < 1e-5 and abs(got[1].metres - 54972.271) < 1e-3 and abs(got[1].azimuth % 360 - 306.86816) < 1e-4 and got[2].metres == 0
    pts = spark.createDataFrame([(60.0 + k, -175.0 + 12 * k) for k in range(29)], "lat double, lon double")
    x, y = J.to_polar(F.col("lat"), F.col("lon"))
    back = pts.select("lat", "lon", x.alias("x"), y.alias("y")).select("lat", "lon", *[c.alias(n) for n, c in zip(("a", "b"), J.from_polar(F.col("x"), F.col("y")), strict=True)])
    assert all(abs(r.lat - r.a) < 1e-6 and abs(r.lon - r.b) < 1e-6 for r in back.collect())
    lon = spark.createDataFrame([(179.0,), (-179.0,)], "lon double")
    assert abs(abs(lon.agg(Z.circular_mean(F.col("lon"))).first()[0]) - 180) < 1e-9


def test_cells(spark):
    g = G.projected_grid(spark, (-1e6, 1e6, 9), (-2e6, 0.0, 7))
    area = [r.area for r in G.cell_area(G.corners(g)).collect()]
    assert len(area) == 63 and all(3e4 < a < 1.2e5 for a in area)
    ring = [(r.i, r.j) for r in G.outline(g).orderBy("ring_order").collect()]
    assert ring[0] == ring[-1] == (0, 0) and len(ring) == 29 and ring[8] == (0, 8) and ring[14] == (6, 8)
    axis = lambda n, name: spark.range(n).select(F.col("id").alias(name), (F.col("id") * 6.0 / n).alias("lo"), ((F.col("id") + 1) * 6.0 / n).alias("hi"))
    shares = G.axis_overlaps(axis(6, "s"), axis(4, "d"), 1.0).collect()
    assert [sum(w for _, d, w in shares if d == k) for k in range(4)] == pytest.approx([1] * 4)


def test_polygons(spark):
    ring = lambda p, *xy: [(p, float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(xy, xy[1:] + xy[:1], strict=True)]
    edges = spark.createDataFrame(ring(1, (0, 0), (10, 0), (10, 10), (0, 10)) + ring(1, (4, 4), (6, 4), (6, 6), (4, 6)) + ring(2, (8, 8), (12, 8), (12, 12), (8, 12)), "poly_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.0, 9.0), (4, 20.0, 5.0)], "point int, x double, y double")
    order = spark.createDataFrame([(1, 1, 10), (2, 2, 20)], "poly_id int, poly_order int, label int")
    assert {r.point: r.label for r in G.labelled(pts, edges, order, 3.0).collect()} == {1: 10, 2: 0, 3: 20, 4: 0}


def test_interpolation(spark):
    pts = spark.createDataFrame([(k, 60.0 + k, 10.0 * k) for k in range(12)], "point long, lat double, lon double")
    q = spark.createDataFrame([(1, 65.0, 50.0), (2, 65.4, 52.0), (3, -80.0, 0.0)], "query long, lat double, lon double")
    near = G.nearest(pts, q, 3).cache()
    assert near.count() == 9 and near.where("query = 1 AND rank = 1").first().point == 5
    w = G.inverse_weights(near)
    total = {r["query"]: r.t for r in w.groupBy("query").agg(F.sum("w").alias("t")).collect()}
    assert all(abs(t - 1) < 1e-12 for t in total.values()) and w.where("query = 1 AND point = 5").first().w == 1.0
    some = spark.createDataFrame([(k, None if k == 5 else float(k)) for k in range(12)], "point long, value double")
    got = values(G.interpolated(w, some), "query")
    assert got[1] is None and got[2] is not None
    none = some.withColumn("value", F.lit(None).cast("double"))
    assert values(G.interpolated(w, none), "query") == {1: None, 2: None, 3: None}


def test_local_std_of_a_hole(spark):
    f = field(spark, *[("a", D1, i, j, None if (i, j) == (2, 2) else float(i + j)) for i in range(5) for j in range(5)])
    assert G.local_std(f, 3, 1.0).count() == 25 and G.local_std(f, 3, 1.0, masked=True).count() == 24


def test_forecast_windows(spark):
    rows = [(T(0), h, float(h)) for h in range(24)]
    fc = FC.with_valid_time(spark.createDataFrame(rows, "init_time timestamp_ntz, lead_h int, value double"))
    late = spark.createDataFrame([(dt.datetime(2024, 1, 2, 6),)], "anchor timestamp_ntz")
    win = FC.windows(fc, late, 1, 1, 1).first()
    assert (win.lead_h, win.avail, win.value) == (-1, False, 0.0)
    assert FC.anchors(fc, 3, 1).count() == 22 and FC.anchors(fc, 3, 1, incomplete=True).count() == 24
    assert [r.lead_h for r in FC.run_leads(fc, F.lit("2024-01-01").cast("timestamp_ntz"), [5, 1]).orderBy("place").collect()] == [5, 1]
    with pytest.raises(Exception, match="no lead 30"):
        FC.run_leads(fc, F.lit("2024-01-01").cast("timestamp_ntz"), [30]).collect()


def test_resume(spark, tmp_path):
    f = field(spark, *[(d, dt.date(2020, 1, n), 0, 0, float(n * (2 if d == "b" else 1))) for d in "ab" for n in range(1, 9)])
    store = R.Store(spark, str(tmp_path / "store"))
    for end in ("2020-01-04", "2020-01-04", "2020-02-01"):
        store.add(R.in_range(f, "2020-01-01", end), [M.MAE], [R.AVERAGE, R.TEMPORAL])
    want = R.run(f, [M.MAE], [R.AVERAGE, R.TEMPORAL])
    assert sorted(map(str, store.summary().collect())) == sorted(map(str, want.collect()))


def test_stream(spark, tmp_path):
    from gridproof.streaming.incremental import follow

    f = field(spark, ("a", D1, 0, 0, 1.0), ("b", D1, 0, 0, 4.0), ("a", D2, 0, 0, 1.0), ("b", D2, 0, 0, 2.0))
    f.write.parquet(str(tmp_path / "in"))
    store = R.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        follow(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")), store, [M.MAE], [R.AVERAGE], str(tmp_path / "ck")).awaitTermination()
    assert store.summary().first().value == 2.0


def test_stream_of_parts(spark, tmp_path):
    """Rows of a date that come in several batches, a dataset at a time, give what one run over all gives."""
    from gridproof.streaming.incremental import follow

    f = field(spark, ("a", D1, 0, 0, 1.0), ("b", D1, 0, 0, 4.0), ("a", D1, 0, 1, 1.0), ("b", D1, 0, 1, None), ("a", D2, 0, 0, 1.0), ("b", D2, 0, 0, 2.0), ("c", D2, 0, 0, 7.0))
    store, all_of = R.Store(spark, str(tmp_path / "store")), [R.AVERAGE, R.TEMPORAL, R.SPATIAL]
    parts = ["dataset = 'a' and j = 0", "dataset = 'b' and date = '%s'" % D1, "j = 1 and dataset = 'a'", "dataset = 'b' and date = '%s'" % D2, "dataset = 'c'"]
    for part in parts:
        f.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")), store, [M.MAE], all_of, str(tmp_path / "ck")).awaitTermination()
    want = R.run(f, [M.MAE], all_of)
    assert sorted(map(str, store.summary().collect())) == sorted(map(str, want.select(*store.summary().columns).collect()))
    store.merge(f, store.marked()[0].removeprefix(R.STREAMED), [M.MAE], all_of)
    assert store.summary().count() == want.count()
    with pytest.raises(ValueError):
        store.add(f, [M.MAE], all_of)


def test_dates_without_rows(spark, tmp_path):
    f = field(spark, ("a", D1, 0, 0, 1.0), ("b", D1, 0, 0, 4.0))
    store = R.Store(spark, str(tmp_path / "store"))
    expected = spark.createDataFrame([(D1,), (D2,)], "date date")
    store.add(f.where("false"), [M.MAE], [R.AVERAGE], expected.where(f"date = '{D2}'"))
    assert [r.date for r in store.read("dates").collect()] == [D2] and store.read("partials") is None
    store.add(f, [M.MAE], [R.AVERAGE], expected)
    assert sorted(r.date for r in store.read("dates").collect()) == [D1, D2] and store.summary().first().value == 3.0
    with pytest.raises(ValueError):
        store.merge(f, "x", [M.MAE], [R.AVERAGE])


def test_odd_names(spark):
    with pytest.raises(ValueError):
        X.combos(field(spark, ("a|b", D1, 0, 0, 1.0), ("c", D1, 0, 0, 1.0)), 2)


def test_sources(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("time_stamp (UTC),latitude,longitude,h\n1/2/20 3:04,80,10,1.5\n1577934240,81,11,2\nbad,1,2,3\n1/2/20 5:00,x,1,1\n")
    got = readers.buoy_csv(spark, str(tmp_path / "b"), ["h"]).collect()
    assert [(r.ts, r.lat, r.h) for r in got] == [(dt.datetime(2020, 1, 2, 3, 4), 80.0, 1.5), (dt.datetime(2020, 1, 2, 3, 4), 81.0, 2.0)]
    (tmp_path / "t.txt").write_text("# c\nBuoyID Year\n 1  2020\n")
    assert readers.drifting_text(spark, str(tmp_path / "t.txt"), ["BuoyID", "Year"]).collect()[0].Year == "2020"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "st1_2020_2021.csv").write_text("time,temp\n2020-01-01 00:10:00,1\n2020-01-01 00:50:00,2\n")
    (tmp_path / "s" / "st1_2021_2022.csv").write_text("time,temp\n2020-01-01 00:20:00,\n2020-01-01 01:00:00,7\n")
    got = {r.hour.hour: r.temp for r in readers.station_files(spark, str(tmp_path / "s"), ["temp", "wind"]).collect()}
    assert got == {0: 2.0, 1: 7.0}
    (tmp_path / "m.json").write_text('[{"id":"a","name":{"ru":"x","en":"A"},"location":{"longitude":1,"latitude":2}},{"id":"b","name":"B","location":{"longitude":1,"latitude":2}},{"id":"c","name":{"ru":"C"},"location":null}]')
    assert {r.station_id: r.name for r in readers.stations(spark, str(tmp_path / "m.json")).collect()} == {"a": "A", "b": "B"}
    np.save(tmp_path / "c.npy", np.array([[1.0, np.nan], [3.0, 10.0]]))
    assert {(r.i, r.j): r.value for r in readers.raster_chart(spark, str(tmp_path / "c.npy")).collect()} == {(0, 0): 10.0, (0, 1): None, (1, 0): 30.0, (1, 1): 100.0}
    np.array([[[1, -32768]], [[5, 6]]], "<f4").tofile(tmp_path / "g.dat")
    assert {(r.i, r.j): (r.lat, r.lon) for r in readers.flat_grid(spark, str(tmp_path / "g.dat"), 1, 2).collect()} == {(0, 0): (1.0, 5.0), (0, 1): (None, 6.0)}


def test_catalog(spark):
    names = ["/a/x_20200102_v.nc", "/a/x_2020-01-03.nc", "/a/y2020m01d02.nc", "/20200104/f.npy", "/a/junk.nc", "/a/x_20209902_v.nc"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {str(r.date): len(r.files) for r in catalog.by_date(df).collect()}
    assert got == {"2020-01-02": 2, "2020-01-03": 1, "2020-01-04": 1}
    mid = spark.createDataFrame([("a_20200101_20200104_x",)], "path string").select(catalog.mid_date(F.col("path"))).first()[0]
    assert str(mid) == "2020-01-02"
    two = spark.createDataFrame([("a", D1), ("b", D1)], "path string, date date")
    with pytest.raises(Exception, match="several files"):
        catalog.one_file_a_date(two).collect()


def test_similarity(spark):
    from gridproof.operators import similarity as S

    n = 33
    cells = spark.range(n * n).select(F.lit(1).alias("k"), F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    x = F.pmod(F.xxhash64("i", "j"), F.lit(100)).cast("double") / 100
    same = cells.withColumns({"x": x, "y": x})
    assert abs(S.ssim(same, ["k"], n, n).first().ssim - 1) < 1e-9
    assert abs(S.ms_ssim(same, ["k"], n, n, window=3).first().value - 1) < 1e-9
    other = cells.withColumns({"x": x, "y": 1 - x})
    assert S.ms_ssim(other, ["k"], n, n, window=3).first().value < 0.2
    with pytest.raises(ValueError):
        S.ms_ssim(same, ["k"], n, n)


def test_local_moments_over_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, j, None if rng.random() < 0.2 else float(rng.normal())) for i in range(-9, 15) for j in range(20) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "dataset string, i int, j int, value double")
    got = {(r.i, r.j): r.m for r in G.local_moments(df, 5, 2.0, side=7, m=F.col("value")).collect()}
    assert set(got) == {(i, j) for _, i, j, _ in rows}
    for i, j in got:
        near = [(v, math.exp(-0.5 * ((i - a) ** 2 + (j - b) ** 2))) for _, a, b, v in rows if v is not None and abs(i - a) <= 2 and abs(j - b) <= 2]
        want = sum(v * w for v, w in near) / sum(w for _, w in near) if near else None
        assert (got[i, j] is None) if want is None else math.isclose(got[i, j], want, abs_tol=1e-12)


def test_nearest_dense_and_sparse(spark):
    points = [(k, 80 + (k * 7 % 90) / 10, (k * 37 % 3600) / 10 - 180) for k in range(200)] + [(500, -10.0, 20.0), (501, -10.0, 20.0), (502, 90.0, 0.0)]
    queries = [(0, 85.0, 10.0), (1, -60.0, -100.0), (2, -10.0, 20.0), (3, 90.0, 50.0), (4, 0.0, 0.0), (5, 89.9999, 179.9999)]

    def at(lat, lon):
        p, o = math.radians(lat), math.radians(lon)
        return math.cos(p) * math.cos(o), math.cos(p) * math.sin(o), math.sin(p)

    for k in (1, 5, 300):
        got = G.nearest(spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame(queries, "query long, lat double, lon double"), k).collect()
        for q, lat, lon in queries:
            far = {p: math.dist(at(lat, lon), at(a, b)) for p, a, b in points}
            mine = sorted((r["rank"], r.point, r.d) for r in got if r.query == q)
            assert [m[0] for m in mine] == list(range(1, min(k, len(points)) + 1)) and len({m[1] for m in mine}) == len(mine), (q, k)
            assert all(math.isclose(d, far[p], abs_tol=1e-9) and math.isclose(d, w, abs_tol=1e-9) for (_, p, d), w in zip(mine, sorted(far.values()), strict=False)), (q, k)


def test_strict_fetches(spark):
    """What a fetch can't give is an error, as is a layer that isn't unique."""
    t0 = dt.datetime(2024, 1, 1)
    fc = FC.with_valid_time(spark.createDataFrame([(t0, 0, 1.0), (t0, 6, 2.0), (t0 + dt.timedelta(days=1), 0, 3.0)], "init_time timestamp_ntz, lead_h int, value double"))
    assert [r.lead_h for r in FC.leads_of(fc, FC.runs_with(fc, [6, 0]), [6, 0]).orderBy("place").collect()] == [6, 0]
    with pytest.raises(Exception, match="no lead 6"):
        FC.leads_of(fc, FC.runs(fc), [0, 6]).collect()
    assert FC.checked(fc, 6, 6, strict=False).count() == 3
    with pytest.raises(Exception, match="last lead"):
        FC.checked(fc, 6, 6).collect()
    with pytest.raises(Exception, match="negative lead"):
        FC.checked(fc.withColumn("lead_h", F.col("lead_h") - 1), 6, 6, strict=False).collect()
    layers = spark.createDataFrame([("t", 1), ("u", 2), ("u", 3)], "name string, level int")
    ask = lambda *names: catalog.layers(layers, spark.createDataFrame([(n,) for n in names], "name string"), ["name"])
    assert [tuple(r) for r in ask("t").collect()] == [("t", 1)]
    for n in ("u", "v"):
        with pytest.raises(Exception, match="layers that match"):
            ask(n).collect()


def test_ingestion_and_columns(spark):
    track = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 30), 70.0, 10.0, 1)], "buoy_id int, ts timestamp_ntz, lat double, lon double, n int")
    with pytest.raises(Exception, match="not a whole hour"):
        P.ingested(track, "n").collect()
    with pytest.raises(ValueError, match="lacks"):
        P.ingested(track.drop("lat"), "n")
    with pytest.raises(KeyError):
        P.batch(track, ["depth"])
    with pytest.raises(ValueError, match="column"):
        G.lat_lon(track.withColumnRenamed("lat", "phi"))
    with pytest.raises(ValueError, match="shapes"):
        G.lat_lon_grid(track.select("lat", F.lit(0).alias("i")), track.select("lon", F.lit(0).alias("i")))
    fine, coarse = (spark.createDataFrame([(a,)], "area double") for a in (1.0, 4.0))
    assert G.regrid_method(fine, coarse) == "conservative" and G.regrid_method(coarse, fine) == "bilinear"
    assert readers.absent(spark).count() == 0
    r = spark.createDataFrame([(1.0, None)], "a double, units string").select(P.decoded_time(F.col("a"), F.col("units")).alias("t")).first()
    assert r.t is None


def test_ms_ssim_against_numpy(spark):
    """Odd sides are padded by zeros at both ends, which count."""
    from gridproof.operators import similarity as S

    rng = np.random.default_rng(8)
    x, y = rng.random((2, 18, 21))
    rows = [("k", i, j, float(x[i, j]), float(y[i, j])) for i in range(18) for j in range(21)]
    got = S.ms_ssim(spark.createDataFrame(rows, "k string, i int, j int, x double, y double"), ["k"], 18, 21, 1.0, 3, S.WEIGHTS[:4]).first().value
    half = 1
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / S.SIGMA) ** 2)
    w = np.outer(w, w) / np.outer(w, w).sum()

    def mean(a):
        return sum(w[p, q] * a[p : a.shape[0] - 2 + p, q : a.shape[1] - 2 + q] for p in range(3) for q in range(3))

    want, c1, c2 = 1.0, 0.01**2, 0.03**2
    for k, power in enumerate(S.WEIGHTS[:4]):
        mx, my = mean(x), mean(y)
        cs = (2 * (mean(x * y) - mx * my) + c2) / (mean(x * x) - mx * mx + mean(y * y) - my * my + c2)
        ssim = (2 * mx * my + c1) / (mx * mx + my * my + c1) * cs
        want *= max((ssim if k == 3 else cs).mean(), 0.0) ** power
        pad = lambda a: np.pad(a, [(n % 2, n % 2) for n in a.shape])[: (a.shape[0] + a.shape[0] % 2) // 2 * 2, : (a.shape[1] + a.shape[1] % 2) // 2 * 2]
        x, y = (pad(a).reshape(pad(a).shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)) for a in (x, y))
    assert math.isclose(got, want, rel_tol=1e-9)


def test_names_with_backticks(spark):
    rows = [(n, dt.date(2024, 1, 1), 0, 0, 0, v) for n, v in (("a`b", 1.0), ("c.d", 3.0))]
    field = spark.createDataFrame(rows, "dataset string, date date, channel int, i int, j int, value double")
    assert [(r.combo, r.v1, r.v2) for r in X.combos(field).collect()] == [("a`b|c.d", 1.0, 3.0)]
