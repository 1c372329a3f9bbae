"""Queries: fetches, ingestion, regridding and sources by the library's own functions, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridproof.operators import align as X
from gridproof.operators import derived as D
from gridproof.operators import forecast as FC
from gridproof.operators import grid as G
from gridproof.operators import metrics as M
from gridproof.operators import points as P
from gridproof.operators import similarity as S
from gridproof.sources import catalog, readers

from . import cycles as C
from . import q_more, q_runs
from . import views as V
from .validate import shared_folder
from .views import sql

QUERIES, SQLS = {}, {}


def _query(key, query, select, *views, digits=9, cols=("value",)):
    QUERIES[key] = lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: V.rounded(c, digits) for c in cols}) if cols else query(spark, sf_dir)
    if select:
        SQLS[key] = sql(select, *views)


# forecasts
_LEADS = [12, 0, 6]
_query(
    "f05_leads", lambda s, d: FC.leads_of(V.fc_ev(s, d), FC.runs_with(V.fc_ev(s, d), _LEADS), _LEADS),
    "SELECT init_time, place, lead_h, valid_time, round(value, 9) AS value FROM fc_ev JOIN (VALUES (0, 12), (1, 0), (2, 6)) p(place, lead_h) USING (lead_h) JOIN whole USING (init_time)",
    V.FC_EV, "whole AS (SELECT init_time FROM fc_ev WHERE lead_h IN (0, 6, 12) GROUP BY init_time HAVING count(DISTINCT lead_h) = 3)",
)
_query(
    "f06_for_valid", lambda s, d: FC.for_valid(V.fc_ev(s, d), V.fc_ev(s, d).where("lead_h = 6").select("valid_time")).withColumn("place", F.col("place").cast("int")),
    "SELECT valid_time, init_time, lead_h, round(value, 9) AS value, (row_number() OVER (PARTITION BY valid_time ORDER BY init_time, lead_h) - 1)::INT AS place FROM fc_ev WHERE valid_time IN (SELECT valid_time FROM fc_ev WHERE lead_h = 6)", V.FC_EV,
)
_query("f02_checked", lambda s, d: FC.checked(V.fc_ev(s, d), 71, 1, strict=False), "SELECT init_time, lead_h, valid_time, round(value, 9) AS value FROM fc_ev", V.FC_EV)


def s10_analyses(spark, sf_dir):
    """Six-hourly analyses of three event types, where all three are there."""
    e = V.table(spark, sf_dir, "events")
    init = F.timestamp_add("HOUR", (F.col("user_id") % 2 * 12).cast("int"), F.date_trunc("DAY", "ts").cast("timestamp_ntz"))
    forecast = e.groupBy(init.alias("init_time"), ((F.col("event_id") % 2 + 1) * 6).cast("int").alias("lead_h"), F.col("event_type").alias("variable")).agg(F.avg("value").alias("value"))
    times = e.select(F.window(F.col("ts").cast("timestamp"), "6 hours").getField("start").cast("timestamp_ntz").alias("ts")).distinct()
    return FC.analyses(forecast, times, ["click", "view", "purchase"])


_query(
    "s10_analyses", s10_analyses, "SELECT ts, init_time, lead_h, variable, round(value, 9) AS value FROM hit WHERE ts IN (SELECT ts FROM hit GROUP BY ts HAVING count(DISTINCT variable) = 3)",
    "fc AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + to_hours((user_id % 2 * 12)::INT) AS init_time, ((event_id % 2 + 1) * 6)::INT AS lead_h, event_type AS variable, avg(value) AS value FROM events GROUP BY ALL)",
    "times AS (SELECT ts, h, CASE WHEN h < 6 THEN -12 WHEN h < 18 THEN 0 ELSE 12 END AS b FROM (SELECT DISTINCT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts FROM events) CROSS JOIN LATERAL (SELECT hour(ts)::INT AS h))",
    "hit AS (SELECT t.ts, fc.init_time, fc.lead_h, variable, value FROM times t JOIN fc ON fc.init_time = CAST(date_trunc('day', t.ts) AS TIMESTAMP) + to_hours(b) AND fc.lead_h = h - b WHERE h - b IN (6, 12) AND variable IN ('click', 'view', 'purchase'))",
)

# sources
_query(
    "s09_earliest_file", lambda s, d: readers.earliest_file(V.fc_ev(s, d).select("valid_time", F.date_format("init_time", "'run_'yyyyMMdd'.nc'").alias("path"), "lead_h", "value"), ["valid_time"]),
    "SELECT valid_time, strftime(min(init_time), 'run_%Y%m%d.nc') AS path, arg_min(lead_h, init_time) AS lead_h, round(arg_min(value, init_time), 9) AS value FROM fc_ev GROUP BY valid_time", V.FC_EV,
)
_query(
    "s12_layers", lambda s, d: catalog.layers(V.table(s, d, "events").select("event_id", "event_type", "user_id"), V.table(s, d, "events").where("user_id % 3 = 0").select("event_id"), ["event_id"]),
    "SELECT event_id, event_type, user_id FROM events WHERE user_id % 3 = 0", cols=(),
)
_requests = lambda s, d: V.table(s, d, "nation").select(F.col("n_nationkey").alias("request"), F.timestamp_add("MINUTE", (F.col("n_nationkey") * 1055).cast("int"), F.lit("2023-12-31 20:25:00").cast("timestamp_ntz")).alias("at"))
_query(
    "s20_nearest_slice", lambda s, d: readers.nearest_slice(q_more._steps(s, d), _requests(s, d), 5),
    "SELECT request, near AS nearest, s.ts, round(s.value, 9) AS value FROM (SELECT n_nationkey AS request, arg_min(ts, (abs(epoch_us(ts) - epoch_us(TIMESTAMP '2023-12-31 20:25:00' + to_minutes(n_nationkey * 1055))), ts)) AS near FROM nation CROSS JOIN steps GROUP BY 1) JOIN steps s ON s.ts BETWEEN near AND near + INTERVAL 4 HOUR",
    q_more._STEPS,
)
_query("s23_absent", lambda s, d: V.field_ev(s, d).join(readers.absent(s).select("date", "channel", "i", "j", F.col("value").alias("other")), ["date", "channel", "i", "j"], "left").select("dataset", "date", "i", "j", "value", "other"), "SELECT dataset, date, i, j, round(value, 9) AS value, NULL::DOUBLE AS other FROM field_ev", V.FIELD_EV)


def s25_grid(spark, sf_dir):
    """The suppliers' points as a grid file, read back."""
    path = f"{shared_folder(spark)}/grid"
    cells = V.grid_pt(spark, sf_dir).select(F.col("k").alias("i"), F.lit(0).alias("j"), "lat", "lon")
    readers.write_grid(cells, path, "points of suppliers")
    back = spark.read.parquet(path)
    units = {f.name: f.metadata.get("comment") for f in back.schema}
    return back.select("i", "j", "lat", "lon", F.lit(units["lat"]).alias("lat_units"), F.lit(units["lon"]).alias("lon_units"))


_query("s25_grid", s25_grid, "SELECT k AS i, 0 AS j, round(lat, 9) AS lat, round(lon, 9) AS lon, 'degrees_north' AS lat_units, 'degrees_east' AS lon_units FROM grid_pt", V.GRID_PT, cols=("lat", "lon"))
_query("s02_period_catalog", lambda s, d: readers.periods(V.table(s, d, "events"), "6h").unionByName(readers.periods(V.table(s, d, "events"), "M")), "SELECT period, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS period, ts, 6 AS kind FROM events UNION ALL SELECT CAST(date_trunc('month', ts) AS TIMESTAMP), ts, 0 FROM events) GROUP BY kind, period", cols=())
_query("s22_fused", lambda s, d: readers.fused(V.field_ev(s, d), "fusion"), "SELECT 'fusion' AS dataset, date, channel, i, j, round(avg(value), 9) AS value FROM field_ev GROUP BY ALL", V.FIELD_EV)
_query("d11_transform", lambda s, d: D.transformed(V.field_ev(s, d), F.log1p, ["click", "view"]), "SELECT dataset, date, channel, i, j, round(CASE WHEN dataset IN ('click', 'view') THEN ln(1 + value) ELSE value END, 9) AS value FROM field_ev", V.FIELD_EV)

# alignment and balances
_one = lambda s, d, name: V.field_ev(s, d).where(F.col("dataset") == name).drop("dataset")
_query(
    "x06_zipped", lambda s, d: X.zipped(_one(s, d, "click"), _one(s, d, "view"), ["date", "channel", "i", "j"], lambda date, channel, i, j, a, b: (a - F.coalesce(b, F.lit(0.0))) * (i + 1) + F.dayofmonth(date), "left"),
    "SELECT date, channel, i, j, round((a.value - coalesce(b.value, 0)) * (i + 1) + day(date), 9) AS value FROM (SELECT * FROM field_ev WHERE dataset = 'click') a LEFT JOIN (SELECT * FROM field_ev WHERE dataset = 'view') b USING (date, channel, i, j)", V.FIELD_EV,
)
_query(
    "c13_reference", lambda s, d: C.over_reference(V.field_ev(s, d), "view"),
    "SELECT 'identity' AS metric, 'view' AS combo, date, channel, round(avg(value), 9) AS value FROM field_ev WHERE dataset = 'view' GROUP BY ALL UNION ALL SELECT 'identity_over', a.dataset || '|view', a.date, 0, round(avg(x.value) FILTER (y.value IS NOT NULL), 9) FROM av a JOIN av b ON b.date = a.date AND b.dataset = 'view' AND a.dataset <> 'view' JOIN cells c ON c.date = a.date LEFT JOIN field_ev x ON x.dataset = a.dataset AND x.date = c.date AND x.i = c.i AND x.j = c.j LEFT JOIN field_ev y ON y.dataset = 'view' AND y.date = c.date AND y.i = c.i AND y.j = c.j GROUP BY ALL",
    V.FIELD_EV, "av AS (SELECT DISTINCT dataset, date FROM field_ev)", "cells AS (SELECT DISTINCT date, i, j FROM field_ev)",
)

# tracks
_records = lambda s, d: V.track_ev(s, d).select(F.col("event_id").alias("record"), F.to_date("ts").alias("date"), "lat", "lon", "value", F.col("lat").alias("height"))
_query(
    "p01_dates", lambda s, d: P.to_grid(_records(s, d), V.grid_pt(s, d).withColumnRenamed("k", "point"), ["value", "height"]),
    "SELECT date, k AS point, round(avg(value), 9) AS value, round(avg(height), 9) AS height FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM track_ev) CROSS JOIN grid_pt LEFT JOIN own USING (date, k) GROUP BY ALL",
    V.TRACK_EV, V.GRID_PT,
    f"own AS (SELECT date, k, value, height FROM (SELECT event_id, CAST(ts AS DATE) AS date, value, lat AS height, k, row_number() OVER (PARTITION BY event_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, k) AS rank FROM (SELECT *, {q_runs._XYZ} FROM track_ev) a CROSS JOIN (SELECT k, {q_runs._XYZ} FROM grid_pt) b) WHERE rank = 1)",
    cols=("value", "height"),
)
_near45 = q_runs._HR.replace("hr AS MATERIALIZED (SELECT buoy_id, h AS ts, CASE WHEN lat < 79.5 THEN lat END AS lat, lon FROM", "hr AS (SELECT buoy_id, h AS ts, lat, lon FROM").replace("86400000000", "2700000000")
_query(
    "p08_prepared", lambda s, d: P.ingested(V.track_ev(s, d), "event_id", 45, with_drift=True).select("buoy_id", "ts", "lat", "lon", "u_cm_s", "v_cm_s", "speed_cm_s").withColumns({c: F.round(c, 9) for c in ("lat", "lon")}),
    "SELECT buoy_id, ts, round(lat, 9) AS lat, round(lon, 9) AS lon, round(k * sin(radians(azimuth)), 2) AS u_cm_s, round(k * cos(radians(azimuth)), 2) AS v_cm_s, round(k, 2) AS speed_cm_s FROM (SELECT *, CASE WHEN dt > 0 THEN metres / dt * 100 END AS k FROM geo)",
    V.TRACK_EV, q_runs._HOURS, _near45, "pairs AS (SELECT *, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6::DOUBLE AS dt, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM hr WINDOW w AS (PARTITION BY buoy_id ORDER BY ts))",
    *V.geodesic_sql("pairs"), digits=2, cols=("u_cm_s", "v_cm_s", "speed_cm_s"),
)
_wins = lambda s, d: P.windows(q_runs._hr(s, d), P.window_starts(q_runs._hr(s, d), 6, ["lat"]), 6)
_query(
    "p09_batches", lambda s, d: P.batch(_wins(s, d), ["lat"], places=[0, 2, 3]),
    "SELECT good.buoy_id, start_ts, step, round(lat, 9) AS lat FROM good CROSS JOIN (SELECT unnest(range(6))::INT AS step) JOIN hr USING (buoy_id) WHERE hr.ts = start_ts + to_hours(step) AND good.buoy_id IN (SELECT buoy_id FROM (SELECT buoy_id, row_number() OVER (ORDER BY buoy_id) - 1 AS p FROM (SELECT DISTINCT buoy_id FROM good)) WHERE p IN (0, 2, 3))",
    V.TRACK_EV, q_runs._HOURS, q_runs._HR, q_runs._GOOD, cols=("lat",),
)
_units = lambda: F.element_at(F.array(*map(F.lit, ("seconds since 1990-01-01 00:00:00", "hours since 2000-1-1", "days since 1950-01-01 12:00", "minutes since 1970-01-01T06:30:00", "fortnights since 1970-01-01"))), (F.col("event_id") % 5 + 1).cast("int"))
_query(
    "p16_units", lambda s, d: V.table(s, d, "events").select("event_id", P.decoded_time(F.col("event_id") * 0.5, _units()).alias("t")),
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN TIMESTAMP '1990-01-01' + to_milliseconds(event_id * 500) WHEN 1 THEN TIMESTAMP '2000-01-01' + to_seconds(event_id * 1800) WHEN 2 THEN TIMESTAMP '1950-01-01 12:00:00' + to_seconds(event_id * 43200) WHEN 3 THEN TIMESTAMP '1970-01-01 06:30:00' + to_seconds(event_id * 30) END AS t FROM events", cols=(),
)
_axis = lambda s, d: V.table(s, d, "orders").select("o_custkey", "o_orderkey").withColumn("place", F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1")).withColumnRenamed("o_orderkey", "value")
_query(
    "p16_constant_step", lambda s, d: P.constant_step_time(_axis(s, d).withColumn("place", F.col("place").cast("long")), ["o_custkey"]),
    "SELECT o_custkey, value, place, TIMESTAMP '1900-01-01' + to_seconds(CASE WHEN place = 0 THEN v0 ELSE v0 + place * (v1 - v0) END) AS ts FROM (SELECT *, max(value) FILTER (place = 0) OVER w AS v0, max(value) FILTER (place = 1) OVER w AS v1 FROM (SELECT o_custkey, o_orderkey AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders) WINDOW w AS (PARTITION BY o_custkey))", cols=(),
)


# grids
def g06_conservative(spark, sf_dir):
    """A 20 x 20 lattice onto 7 rows and 6 columns over the same square."""
    axis = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name), (F.col("id") * (20.0 / n)).alias("lo"), ((F.col("id") + 1) * (20.0 / n)).alias("hi"))
    w = G.area_weights(G.axis_overlaps(axis(20, "s"), axis(7, "d"), 3.0), G.axis_overlaps(axis(20, "s"), axis(6, "d"), 3.0))
    return G.regridded(V.field_li(spark, sf_dir), w.where("w > 1e-12"))


_axis_sql = lambda n: f"(SELECT s, d, share FROM (SELECT s, d, (least(s + 1, (d + 1) * (20.0::DOUBLE / {n})) - greatest(s, d * (20.0::DOUBLE / {n}))) / (20.0::DOUBLE / {n}) AS share FROM (SELECT unnest(range(20))::INT AS s) CROSS JOIN (SELECT unnest(range({n}))::INT AS d)) WHERE share > 0)"
_query(
    "g06_conservative", g06_conservative, "SELECT dataset, date, channel, a_d AS i, b_d AS j, CASE WHEN count(value) = any_value(n) THEN round(sum(value * w), 9) END AS value FROM wt JOIN field_li f ON f.i = a_s AND f.j = b_s JOIN need USING (a_d, b_d) GROUP BY ALL",
    V.FIELD_LI, f"wt AS (SELECT a.s AS a_s, a.d AS a_d, b.s AS b_s, b.d AS b_d, a.share * b.share AS w FROM {_axis_sql(7)} a CROSS JOIN {_axis_sql(6)} b WHERE a.share * b.share > 1e-12)", "need AS (SELECT a_d, b_d, count(*) AS n FROM wt GROUP BY ALL)",
)


def g09c_dataset(spark, sf_dir):
    """All dates of the events' field at one site for each nation."""
    cells = V.areas(spark, sf_dir).select("i", "j", (F.col("i") * 0.7 + 60).alias("lat"), (F.col("j") * 3.0).alias("lon"))
    sites = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query"), (F.col("n_nationkey") * 0.1 + 60.03).alias("lat"), (F.col("n_nationkey") + 0.5).alias("lon"))
    return G.onto(V.field_ev(spark, sf_dir), cells, sites, 3)


_P = q_runs._PX
_SITE = [
    f"sites AS (SELECT n_nationkey AS query, {_P} FROM (SELECT *, n_nationkey * 0.1::DOUBLE + 60.03 AS lat, n_nationkey + 0.5::DOUBLE AS lon FROM nation))",
    f"cells8 AS (SELECT i, j, {_P} FROM (SELECT *, i * 0.7::DOUBLE + 60 AS lat, j * 3.0::DOUBLE AS lon FROM areas))",
    "near AS (SELECT * FROM (SELECT query, i, j, d, row_number() OVER (PARTITION BY query ORDER BY d, i, j) AS rank FROM (SELECT query, i, j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM sites a CROSS JOIN cells8 b)) WHERE rank <= 3)",
]
_query("g09c_dataset", g09c_dataset, "SELECT dataset, date, channel, query, round(sum(value / d) / sum(1 / d), 9) AS value FROM field_ev JOIN near USING (i, j) GROUP BY ALL", V.FIELD_EV, V.AREAS, *_SITE)
_query("g09_gaussian", lambda s, d: G.interpolated(G.inverse_weights(q_runs._near(s, d), "gaussian"), q_runs._val(s, d, -1), False), "SELECT query, round(sum(w * lat * 2) / sum(w), 6) AS value FROM (SELECT query, point, exp(-d * d / (2 * (SELECT median(d) FROM near) ** 2 / 9)) AS w FROM near) JOIN grid_pt ON k = point GROUP BY query", *q_runs._PT, digits=6)
_query("g13_columns", lambda s, d: G.lat_lon(V.grid_pt(s, d).withColumnsRenamed({"lat": "nav_lat", "lon": "longitude"})), "SELECT k, round(lat, 9) AS lat, round(lon, 9) AS lon FROM grid_pt", V.GRID_PT, cols=("lat", "lon"))
_query("g13_mesh", lambda s, d: G.lat_lon_grid(V.grid_pt(s, d).select(F.col("k").alias("i"), "lat"), V.table(s, d, "region").select(F.col("r_regionkey").alias("j"), (F.col("r_regionkey") * 2.0).alias("lon"))), "SELECT k AS i, r_regionkey AS j, round(lat, 9) AS lat, r_regionkey * 2.0::DOUBLE AS lon FROM grid_pt CROSS JOIN region", V.GRID_PT, cols=("lat", "lon"))


# metrics
def m19_drift_efficiency(spark, sf_dir):
    """Success of one event type against another beyond that of the day before, by the spread of the change."""
    old = V.vec_ev(spark, sf_dir).select(F.split_part(F.concat("dataset", F.lit("|")), F.lit("|"), F.lit(1)).alias("d2"), F.date_add("date", 1).alias("date"), "i", "j", F.col("u").alias("u0"), F.col("v").alias("v0"))
    rows = q_more._vectors(spark, sf_dir).join(old, ["d2", "date", "i", "j"])
    local = M.vector_norm(F.col("u2") - F.col("u0"), F.col("v2") - F.col("v0"))
    return M.drift_efficiency(rows, local, 5.0, mask=F.col("i") % 2 == 0).select("combo", "date", "i", "j", "value")


_hit = lambda u, v: f"(sqrt(({u} - u2) ** 2 + ({v} - v2) ** 2) <= greatest(0.674 * sqrt((u2 - o.u) ** 2 + (v2 - o.v) ** 2), 5.0))::INT::DOUBLE"
_query(
    "m19_drift_efficiency", m19_drift_efficiency, f"SELECT combo, x.date, x.i, x.j, CASE WHEN x.i % 2 = 0 THEN {_hit('u1', 'v1')} - {_hit('o.u', 'o.v')} END AS value FROM vecs x JOIN vec_ev o ON o.dataset = split_part(combo, '|', 2) AND x.date = o.date + 1 AND x.i = o.i AND x.j = o.j",
    V.VEC_EV, q_more._VEC,
)


def m22_ms_ssim(spark, sf_dir):
    """Similarity over four scales of two return flags' lattices, month by month; gaps count as 0."""
    f = V.field_li(spark, sf_dir).where("dataset IN ('A', 'R')").groupBy("date", "i", "j").pivot("dataset", ["A", "R"]).agg(F.first("value"))
    lattice = spark.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("i"), (F.col("id") % 20).cast("int").alias("j"))
    whole = f.select("date").distinct().crossJoin(lattice).join(f, ["date", "i", "j"], "left")
    rows = whole.select("date", "i", "j", F.coalesce("A", F.lit(0.0)).alias("x"), F.coalesce("R", F.lit(0.0)).alias("y"))
    return S.ms_ssim(rows, ["date"], 20, 20, 50.0, 3, S.WEIGHTS[:4])


def _scales(sizes: tuple[int, ...]) -> list[str]:
    """Views s0, s1, ... (date, ssim, cs) of r0 (date, i, j, x, y) and of its halves, for square fields of these sides and windows of three."""
    views, w = [], f"exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2) / {2 * S.SIGMA**2}::DOUBLE)"
    for k, n in enumerate(sizes):
        mean = lambda x: f"sum({x} * {w}) / sum({w})"
        views += [
            f"m{k} AS (SELECT a.date, a.i, a.j, {mean('b.x')} AS mx, {mean('b.y')} AS my, {mean('b.x * b.x')} AS mxx, {mean('b.y * b.y')} AS myy, {mean('b.x * b.y')} AS mxy FROM r{k} a JOIN r{k} b ON a.date = b.date AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 WHERE a.i BETWEEN 1 AND {n - 2} AND a.j BETWEEN 1 AND {n - 2} GROUP BY a.date, a.i, a.j)",
            f"c{k} AS (SELECT *, (2 * (mxy - mx * my) + 2.25::DOUBLE) / ((mxx - mx * mx) + (myy - my * my) + 2.25::DOUBLE) AS cs FROM m{k})",
            f"s{k} AS (SELECT date, greatest(avg((2 * mx * my + 0.25::DOUBLE) / (mx * mx + my * my + 0.25::DOUBLE) * cs), 0) AS ssim, greatest(avg(cs), 0) AS cs FROM c{k} GROUP BY date)",
            f"r{k + 1} AS MATERIALIZED (SELECT date, (i + {n % 2}) // 2 AS i, (j + {n % 2}) // 2 AS j, sum(x) / 4 AS x, sum(y) / 4 AS y FROM r{k} GROUP BY ALL)",
        ]
    return views


_query(
    "m22_ms_ssim", m22_ms_ssim, "SELECT date, round(" + " * ".join(f"pow(s{k}.{'cs' if k < 3 else 'ssim'}, {w}::DOUBLE)" for k, w in enumerate(S.WEIGHTS[:4])) + ", 9) AS value FROM s0 JOIN s1 USING (date) JOIN s2 USING (date) JOIN s3 USING (date)",
    V.FIELD_LI, "r0 AS MATERIALIZED (SELECT d.date, p.i, q.j, coalesce(x.value, 0) AS x, coalesce(y.value, 0) AS y FROM (SELECT DISTINCT date FROM field_li WHERE dataset IN ('A', 'R')) d CROSS JOIN (SELECT unnest(range(20))::INT AS i) p CROSS JOIN (SELECT unnest(range(20))::INT AS j) q"
    " LEFT JOIN field_li x ON x.dataset = 'A' AND x.date = d.date AND x.i = p.i AND x.j = q.j LEFT JOIN field_li y ON y.dataset = 'R' AND y.date = d.date AND y.i = p.i AND y.j = q.j)",
    *_scales((20, 10, 5, 3)),
)
