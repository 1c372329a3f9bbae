"""Queries: forecasts, tracks, stations, grids, sources and validation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridproof.functions import projection as J
from gridproof.operators import aggregators as A
from gridproof.operators import forecast as FC
from gridproof.operators import grid as G
from gridproof.operators import metrics as M
from gridproof.operators import points as P
from gridproof.operators import similarity as S

from . import validate as R
from . import views as V
from .q_metrics import _EV
from .views import sql

QUERIES, SQLS = {}, {}


def _query(key, query, select, *views, digits=9, cols=("value",)):
    QUERIES[key] = lambda spark, sf_dir: (df := query(spark, sf_dir)).withColumns({c: V.rounded(c, digits) for c in cols}) if cols else query(spark, sf_dir)
    if select:
        SQLS[key] = sql(select, *views)


# forecasts
fc = V.fc_ev
_REFS = "refs AS (SELECT DISTINCT init_time, lead_h, valid_time FROM fc_ev)"
_SPINE = "spine AS (SELECT DISTINCT valid_time AS anchor, step, valid_time + to_hours(step * 6) AS valid_time FROM fc_ev, (VALUES (0), (1), (2)) s(step))"
_SLOTS = "slots AS (SELECT * FROM (SELECT anchor, step, r.valid_time, (row_number() OVER (PARTITION BY anchor, step ORDER BY init_time DESC) - 1)::INT AS slot, init_time, lead_h FROM spine JOIN refs r USING (valid_time) WHERE init_time <= anchor) WHERE slot < 2)"
_query("f01_runs", lambda s, d: FC.runs(fc(s, d)).withColumn("leads", F.array_join(F.col("leads").cast("array<string>"), ",")), "SELECT init_time, string_agg(DISTINCT lead_h::VARCHAR, ',' ORDER BY lead_h) AS leads, min(valid_time) AS first_valid, max(valid_time) AS last_valid FROM fc_ev GROUP BY init_time", V.FC_EV, cols=())
SQLS["f01_runs"] = sql("SELECT init_time, array_to_string(list_sort(list(DISTINCT lead_h)), ',') AS leads, min(valid_time) AS first_valid, max(valid_time) AS last_valid FROM fc_ev GROUP BY init_time", V.FC_EV)
_query("f02_checks", lambda s, d: FC.lead_report(fc(s, d), 71, 1), "SELECT init_time, max(lead_h) AS max_lead, min(lead_h) < 0 AS negative, max(lead_h) = 71 AS max_ok, coalesce(bool_and(step = 1), TRUE) AS step_ok FROM (SELECT *, lead_h - lag(lead_h) OVER (PARTITION BY init_time ORDER BY lead_h) AS step FROM fc_ev) GROUP BY init_time", V.FC_EV, cols=())
_query("f03_index", lambda s, d: FC.valid_index(fc(s, d)).select("valid_time", F.array_join(F.transform("refs", lambda x: F.concat_ws("+", F.date_format(x["init_time"], "yyyyMMddHH"), x["lead_h"])), ",").alias("refs")), "SELECT valid_time, string_agg(strftime(init_time, '%Y%m%d%H') || '+' || lead_h, ',' ORDER BY init_time) AS refs FROM fc_ev GROUP BY valid_time", V.FC_EV, cols=())
_query("f05_run", lambda s, d: fc(s, d).join(fc(s, d).groupBy("init_time").agg(F.min("lead_h").alias("lead_h")), ["init_time", "lead_h"]).select("init_time", "lead_h", "value"), "SELECT init_time, min(lead_h) AS lead_h, round(arg_min(value, lead_h), 9) AS value FROM fc_ev GROUP BY init_time", V.FC_EV)
_query("f06_valid", lambda s, d: fc(s, d).select("valid_time", "init_time", "lead_h", "value"), "SELECT valid_time, init_time, lead_h, round(value, 9) AS value FROM fc_ev", V.FC_EV)
_anchors = lambda s, d: fc(s, d).select(F.col("valid_time").alias("anchor")).distinct()
_query("f08_slots", lambda s, d: FC.slots(fc(s, d), _anchors(s, d), 3, 6, 2), "SELECT * FROM slots", V.FC_EV, _REFS, _SPINE, _SLOTS, cols=())
_query("f09_anchors", lambda s, d: FC.anchors(fc(s, d), 3, 6), "SELECT anchor FROM slots GROUP BY anchor HAVING count(DISTINCT step) = 3", V.FC_EV, _REFS, _SPINE, _SLOTS, cols=())
_query("f07_window", lambda s, d: FC.windows(fc(s, d), _anchors(s, d), 3, 6, 2), "SELECT anchor, x.slot, step, round(coalesce(value, 0), 9) AS value, coalesce(s.lead_h, -1) AS lead_h, s.init_time IS NOT NULL AS avail FROM spine CROSS JOIN (VALUES (0), (1)) x(slot) LEFT JOIN slots s USING (anchor, step, slot) LEFT JOIN fc_ev f ON f.init_time = s.init_time AND f.lead_h = s.lead_h", V.FC_EV, _REFS, _SPINE, _SLOTS)
_query("f11_shape", lambda s, d: V.field_li(s, d).groupBy("dataset").agg(F.max("channel").alias("channel"), F.max("i").alias("i"), F.max("j").alias("j")), "SELECT dataset, max(channel) AS channel, max(i) AS i, max(j) AS j FROM field_li GROUP BY dataset", V.FIELD_LI, cols=())


def s10_leads(spark, sf_dir):
    init, lead = FC.analysis_lead(F.col("ts"))
    return V.table(spark, sf_dir, "events").select("event_id", init.alias("init_time"), lead.alias("lead_h"))


QUERIES["s10_leads"] = s10_leads
SQLS["s10_leads"] = "SELECT event_id, date_trunc('day', ts) + to_hours(b) AS init_time, CASE WHEN h - b IN (6, 12) THEN h - b END AS lead_h FROM (SELECT *, CASE WHEN h < 6 THEN -12 WHEN h < 18 THEN 0 ELSE 12 END AS b FROM (SELECT event_id, ts, hour(ts)::INT AS h FROM events))"

# tracks
tr = V.track_ev
_query("p02_dates", lambda s, d: tr(s, d).select("buoy_id", F.to_date("ts").alias("date")).distinct(), "SELECT DISTINCT buoy_id, CAST(ts AS DATE) AS date FROM track_ev", V.TRACK_EV, cols=())
_query("p03_doy", lambda s, d: V.table(s, d, "events").select("event_id", P.day_of_year_time(F.year("ts"), 1 + (F.col("event_id") % 36500) / 100.0).alias("t")), "SELECT event_id, make_timestamp(year(ts), 1, 1, 0, 0, 0) + to_microseconds(round(((1 + (event_id % 36500) / 100.0::DOUBLE) - 1) * 86400000000)::BIGINT) AS t FROM events", cols=())
_hour = "CAST(date_trunc('hour', {}) AS TIMESTAMP)"
_HOURS = f"hours AS MATERIALIZED (SELECT buoy_id, unnest(generate_series({_hour.format('min(ts)')}, CASE WHEN {_hour.format('max(ts)')} = max(ts) THEN max(ts) ELSE {_hour.format('max(ts)')} + INTERVAL 1 HOUR END, INTERVAL 1 HOUR)) AS h FROM track_ev GROUP BY buoy_id)"
_query("p04_hourly", lambda s, d: P.hourly(tr(s, d), 45, ["lat", "event_id"]), "SELECT buoy_id, h AS ts, t.ts AS sample_ts, round(t.lat, 9) AS lat, t.event_id FROM hours JOIN track_ev t USING (buoy_id) WHERE abs(epoch_us(t.ts) - epoch_us(h)) <= 2700000000 QUALIFY row_number() OVER (PARTITION BY buoy_id, h ORDER BY abs(epoch_us(t.ts) - epoch_us(h)), t.ts DESC) = 1", V.TRACK_EV, _HOURS, cols=("lat",))
_below = lambda rows: rows.drop("sample_ts").withColumn("lat", F.when(F.col("lat") < 79.5, F.col("lat")))
_hr = lambda s, d: _below(P.hourly(tr(s, d), 1440, ["lat", "lon"]))
_HR = """hr AS MATERIALIZED (SELECT buoy_id, h AS ts, CASE WHEN lat < 79.5 THEN lat END AS lat, lon FROM (
  SELECT buoy_id, h, CASE WHEN later THEN a_lat ELSE b_lat END AS lat, CASE WHEN later THEN a_lon ELSE b_lon END AS lon, CASE WHEN later THEN a_ts ELSE b_ts END AS sample FROM (
    SELECT h.buoy_id, h, a.lat AS a_lat, a.lon AS a_lon, a.ts AS a_ts, b.lat AS b_lat, b.lon AS b_lon, b.ts AS b_ts, b.ts IS NULL OR coalesce(epoch_us(a.ts) - epoch_us(h) <= epoch_us(h) - epoch_us(b.ts), FALSE) AS later
    FROM hours h ASOF LEFT JOIN track_ev b ON h.buoy_id = b.buoy_id AND h.h >= b.ts ASOF LEFT JOIN track_ev a ON h.buoy_id = a.buoy_id AND h.h <= a.ts))
  WHERE abs(epoch_us(sample) - epoch_us(h)) <= 86400000000)"""
_GOOD = "good AS MATERIALIZED (SELECT buoy_id, ts AS start_ts FROM (SELECT *, count(lat) OVER w AS n, count(*) OVER w AS c, max(ts) OVER w AS last FROM hr WINDOW w AS (PARTITION BY buoy_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE n = 6 AND c = 6 AND last = ts + INTERVAL 5 HOUR)"
_query("p06_starts", lambda s, d: P.window_starts(_hr(s, d), 6, ["lat", "lon"]), "SELECT * FROM good", V.TRACK_EV, _HOURS, _HR, _GOOD, cols=())
_query("p07_windows", lambda s, d: P.windows(_hr(s, d), P.window_starts(_hr(s, d), 6, ["lat"]), 6), "SELECT buoy_id, start_ts, step, start_ts + to_hours(step) AS ts, round(lat, 9) AS lat, round(lon, 9) AS lon FROM good CROSS JOIN (SELECT unnest(range(6))::INT AS step) JOIN hr USING (buoy_id) WHERE hr.ts = start_ts + to_hours(step)", V.TRACK_EV, _HOURS, _HR, _GOOD, cols=("lat", "lon"))
_query("p10_first", lambda s, d: P.start_positions(_below(P.hour_runs(tr(s, d), 1440, ["lat", "lon"])), 6, ["lat"]), "SELECT buoy_id, start_ts, round(lat, 9) AS lat, round(lon, 9) AS lon FROM good JOIN hr ON good.buoy_id = hr.buoy_id AND start_ts = ts".replace("SELECT buoy_id", "SELECT good.buoy_id"), V.TRACK_EV, _HOURS, _HR, _GOOD, cols=("lat", "lon"))
_steps = lambda s, d: tr(s, d).select("buoy_id", (F.hour("ts")).alias("step"), "value").groupBy("buoy_id", "step").agg(F.max("value").alias("value"))
_query("p12_pad", lambda s, d: P.padded(_steps(s, d), 12), "SELECT buoy_id, step, round(v, 9) AS value FROM (SELECT DISTINCT buoy_id FROM track_ev) CROSS JOIN (SELECT unnest(range(12))::INT AS step) LEFT JOIN (SELECT buoy_id, hour(ts)::INT AS step, max(value) AS v FROM track_ev GROUP BY ALL) USING (buoy_id, step)", V.TRACK_EV)
_query(
    "p05_drift", lambda s, d: P.drift(tr(s, d)).select("buoy_id", "event_id", "ts", "u_cm_s", "v_cm_s", "speed_cm_s"),
    "SELECT buoy_id, event_id, ts, round(k * sin(radians(azimuth)), 2) AS u_cm_s, round(k * cos(radians(azimuth)), 2) AS v_cm_s, round(k, 2) AS speed_cm_s FROM (SELECT *, CASE WHEN dt > 0 THEN metres / dt * 100 END AS k FROM geo)",
    V.TRACK_EV, "pairs AS (SELECT *, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6::DOUBLE AS dt, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM track_ev WINDOW w AS (PARTITION BY buoy_id ORDER BY ts))",
    *V.geodesic_sql("pairs"), digits=2, cols=("u_cm_s", "v_cm_s", "speed_cm_s"),
)
_query("p11_order", lambda s, d: P.lat_lon_order(tr(s, d).select("event_id", F.col("lon").alias("a"), F.col("lat").alias("b")), "a", "b"), "SELECT event_id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM track_ev", V.TRACK_EV, cols=("lat", "lon"))
_query("p16_numeric", lambda s, d: V.table(s, d, "events").select("event_id", P.numeric_time(F.col("event_id") * 3600 + 7).alias("t")), "SELECT event_id, TIMESTAMP '1900-01-01' + to_seconds(event_id * 3600 + 7) AS t FROM events", cols=())
_obs = lambda s, d: tr(s, d).withColumnRenamed("buoy_id", "station_id")
_ST = f"st AS (SELECT buoy_id AS station_id, {_hour.format('ts')} AS hour, arg_max(value, (ts, event_id)) AS value FROM track_ev GROUP BY ALL)"
_sh = lambda s, d: P.station_hours(_obs(s, d), "event_id")
_query("s15_station_hourly", _sh, "SELECT station_id, hour, round(value, 9) AS value FROM st", V.TRACK_EV, _ST)
_query("p13_timeline", lambda s, d: P.timeline(_sh(s, d)), "SELECT station_id, hour, round(value, 9) AS value FROM (SELECT DISTINCT station_id FROM st) CROSS JOIN (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM st) LEFT JOIN st USING (station_id, hour)", V.TRACK_EV, _ST)
_query("p14_station_window", lambda s, d: P.station_window(_sh(s, d), F.lit("2024-01-05 03:00:00").cast("timestamp_ntz"), 12), "SELECT station_id, hour, round(value, 9) AS value FROM st WHERE hour BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-05 14:00:00'", V.TRACK_EV, _ST)
_vars = lambda s, d: V.table(s, d, "events").groupBy(F.col("user_id").alias("station_id"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("variable")).agg(F.avg("value").alias("value"))
_query("p15_pivot", lambda s, d: P.wide(_vars(s, d), ["click", "view"]), f"SELECT user_id AS station_id, {_hour.format('ts')} AS hour, round(avg(value) FILTER (event_type = 'click'), 9) AS click, round(avg(value) FILTER (event_type = 'view'), 9) AS view FROM events GROUP BY ALL", cols=("click", "view"))

# grids
_HALF, _SIG = 5, 2.0
_S2 = 2 * ((11 - 1) / (2 * _SIG)) ** 2
_LOCAL = f"mom AS (SELECT a.dataset, a.date, a.channel, a.i, a.j, sum(b.value * w) / sum(w) AS m1, sum(b.value * b.value * w) / sum(w) AS m2 FROM field_li a JOIN (SELECT *, NULL AS w0 FROM field_li) b ON a.dataset = b.dataset AND a.date = b.date AND abs(a.i - b.i) <= {_HALF} AND abs(a.j - b.j) <= {_HALF} CROSS JOIN LATERAL (SELECT exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2) / {_S2}) AS w) GROUP BY ALL)"
_query("m15_local_std", lambda s, d: G.local_std(V.field_li(s, d), 11, _SIG), "SELECT dataset, date, channel, i, j, round(sqrt(greatest(m2 - m1 * m1, 0) + 1e-8), 6) AS value FROM mom", V.FIELD_LI, _LOCAL, digits=6)
_query("g11_moments", lambda s, d: G.local_moments(V.field_li(s, d), 11, _SIG, m1=F.col("value"), m2=F.col("value") * F.col("value")), "SELECT dataset, date, channel, i, j, round(m1, 8) AS m1, round(m2, 6) AS m2 FROM mom", V.FIELD_LI, _LOCAL, digits=6, cols=("m2",))
QUERIES["g11_moments"] = lambda s, d: G.local_moments(V.field_li(s, d), 11, _SIG, m1=F.col("value"), m2=F.col("value") * F.col("value")).withColumns({"m1": F.round("m1", 8), "m2": F.round("m2", 6)})


def _ssim_rows(spark, sf_dir):
    f = V.field_li(spark, sf_dir)
    x, y = (f.where(f"dataset = '{n}'").select("date", "channel", "i", "j", F.col("value").alias(c)) for n, c in (("N", "x"), ("R", "y")))
    return x.join(y, ["date", "channel", "i", "j"])


def m21(spark, sf_dir):
    return S.ssim(_ssim_rows(spark, sf_dir), ["date", "channel"], 20, 20, reach=50.0).withColumns({c: F.round(c, 6) for c in ("ssim", "cs")})


QUERIES["m21_ssim"] = m21
_S3 = 2 * ((11 - 1) / (2 * (10 / 3.0))) ** 2
SQLS["m21_ssim"] = sql(
    "SELECT date, channel, round(avg((2 * mx * my + c1) / (mx * mx + my * my + c1) * cs), 6) AS ssim, round(avg(cs), 6) AS cs FROM (SELECT *, (2 * (mxy - mx * my) + c2) / (mxx - mx * mx + myy - my * my + c2) AS cs FROM mom CROSS JOIN (SELECT 0.25::DOUBLE AS c1, 2.25::DOUBLE AS c2)) WHERE i BETWEEN 5 AND 14 AND j BETWEEN 5 AND 14 GROUP BY ALL",
    V.FIELD_LI, "xy AS (SELECT a.date, a.channel, a.i, a.j, a.value AS x, b.value AS y FROM field_li a JOIN field_li b ON a.dataset = 'N' AND b.dataset = 'R' AND a.date = b.date AND a.i = b.i AND a.j = b.j)",
    f"mom AS (SELECT a.date, a.channel, a.i, a.j, sum(b.x * w) / sum(w) AS mx, sum(b.y * w) / sum(w) AS my, sum(b.x * b.x * w) / sum(w) AS mxx, sum(b.y * b.y * w) / sum(w) AS myy, sum(b.x * b.y * w) / sum(w) AS mxy FROM xy a JOIN xy b ON a.date = b.date AND abs(a.i - b.i) <= 5 AND abs(a.j - b.j) <= 5 CROSS JOIN LATERAL (SELECT exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2) / {_S3}) AS w) GROUP BY ALL)",
)

_XYZ = "cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z"
_NEAR = f"near AS (SELECT query, point, d, rank FROM (SELECT q AS query, k AS point, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, row_number() OVER (PARTITION BY q ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), k)::INT AS rank FROM (SELECT q, {_XYZ} FROM part_pt) a CROSS JOIN (SELECT k, {_XYZ} FROM grid_pt) b) WHERE rank <= 4)"
_pts = lambda s, d: (V.grid_pt(s, d).withColumnRenamed("k", "point"), V.part_pt(s, d).withColumnRenamed("q", "query"))
_near = lambda s, d, k=4: G.nearest(*_pts(s, d), k)
_PT = (V.GRID_PT, V.PART_PT, _NEAR)
_query("g08_knn", _near, "SELECT query, point, rank, round(d, 9) AS d FROM near", *_PT, cols=("d",))
_query("x11_nearest_node", lambda s, d: _near(s, d, 1).drop("rank"), "SELECT query, point, round(d, 9) AS d FROM near WHERE rank = 1", *_PT, cols=("d",))
_WT = "wt AS (SELECT *, CASE WHEN min(d) OVER q = 0 THEN (d = 0)::INT / sum((d = 0)::INT) OVER q ELSE (1 / d) / sum(1 / d) OVER q END AS w FROM near WINDOW q AS (PARTITION BY query))"
_val = lambda s, d, gaps: V.grid_pt(s, d).select(F.col("k").alias("point"), F.when(F.col("k") % 4 > gaps, F.col("lat") * 2).alias("value"))
_query("g09_idw", lambda s, d: G.interpolated(G.inverse_weights(_near(s, d)), _val(s, d, -1), False), "SELECT query, round(sum(w * lat * 2), 9) AS value FROM wt JOIN grid_pt ON k = point GROUP BY query", *_PT, _WT)
_query("g09b_idw_missing", lambda s, d: G.interpolated(G.inverse_weights(_near(s, d)), _val(s, d, 1)), "SELECT query, round(sum(w * lat * 2) FILTER (k % 4 > 1) / nullif(sum(w) FILTER (k % 4 > 1), 0), 9) AS value FROM wt JOIN grid_pt ON k = point GROUP BY query", *_PT, _WT)
_query("g09d_coverage", lambda s, d: G.coverage(_near(s, d), 0.2, -1.0).withColumnRenamed("mask", "value"), "SELECT query, CASE WHEN avg(d) <= 0.2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS value FROM near GROUP BY query", *_PT)
_EDGE = [(1, 62, 0, 85, 10), (1, 85, 10, 70, 100), (1, 70, 100, 62, 0), (1, 66, 20, 75, 20), (1, 75, 20, 70, 50), (1, 70, 50, 66, 20), (2, 60, -100, 80, -50), (2, 80, -50, 80, 30), (2, 80, 30, 60, -100)]
_VALUES = ", ".join(f"({p}, {a}.0::DOUBLE, {b}.0::DOUBLE, {c}.0::DOUBLE, {e}.0::DOUBLE)" for p, a, b, c, e in _EDGE)
_edges = lambda s: s.createDataFrame([(p, float(a), float(b), float(c), float(e)) for p, a, b, c, e in _EDGE], "poly_id int, x1 double, y1 double, x2 double, y2 double")
_order = lambda s: s.createDataFrame([(1, 1, 10), (2, 2, 20)], "poly_id int, poly_order int, label int")
_INSIDE = f"inside AS (SELECT q AS point, poly_id FROM part_pt JOIN (VALUES {_VALUES}) e(poly_id, x1, y1, x2, y2) ON lon >= least(y1, y2) AND lon < greatest(y1, y2) AND lat < x1 + (lon - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1)"
_flat = lambda s, d: V.part_pt(s, d).select(F.col("q").alias("point"), F.col("lat").alias("x"), F.col("lon").alias("y"))
_query("g10_polygon", lambda s, d: G.in_polygons(_flat(s, d), _edges(s), 15.0), "SELECT point, poly_id FROM inside", V.PART_PT, _INSIDE, cols=())
_query("x15_labels", lambda s, d: G.labelled(_flat(s, d), _edges(s), _order(s), 15.0), "SELECT q AS point, coalesce(max(poly_id) * 10, 0)::INT AS label FROM part_pt LEFT JOIN inside ON q = point GROUP BY q", V.PART_PT, _INSIDE, cols=())
_query("g10b_convex", lambda s, d: V.field_li(s, d).select("i", "j").distinct().withColumn("inside", G.in_convex([(2, 2), (15, 4), (12, 16), (4, 12)])), "SELECT DISTINCT i, j, (j - 12) * (2 - 4) - (i - 4) * (2 - 12) <= 0 AND (j - 2) * 13 - (i - 2) * 2 <= 0 AND (j - 4) * (12 - 15) - (i - 15) * 12 <= 0 AND (j - 16) * (4 - 12) - (i - 12) * (12 - 16) <= 0 AS inside FROM field_li", V.FIELD_LI, cols=())
_query("g10c_land", lambda s, d: G.land_mask(V.part_pt(s, d), V.grid_pt(s, d).select(F.floor(F.col("lat") / 5).cast("int").alias("a"), F.floor(F.col("lon") / 5).cast("int").alias("b")), 5.0).select("q", "is_land"), "SELECT q, EXISTS (SELECT 1 FROM grid_pt g WHERE floor(g.lat / 5) = floor(p.lat / 5) AND floor(g.lon / 5) = floor(p.lon / 5)) AS is_land FROM part_pt p", V.GRID_PT, V.PART_PT, cols=())
_query("p01_points_to_grid", lambda s, d: _near(s, d, 1).join(V.part_pt(s, d).withColumnRenamed("q", "query"), "query").groupBy("point").agg(F.avg("lat").alias("value")), "SELECT point, round(avg(lat), 9) AS value FROM near JOIN part_pt ON q = query WHERE rank = 1 GROUP BY point", *_PT)


def a08_points(spark, sf_dir):
    cells = V.areas(spark, sf_dir).select((F.col("i") * 100 + F.col("j")).alias("point"), "i", "j", (F.col("i") * 0.7 + 60).alias("lat"), (F.col("j") * 3.0).alias("lon"))
    sites = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query"), (F.col("n_nationkey") * 0.1 + 60.03).alias("lat"), (F.col("n_nationkey") + 0.5).alias("lon"))
    w = G.inverse_weights(G.nearest(cells.select("point", "lat", "lon"), sites, 3)).join(cells.select("point", "i", "j"), "point")
    return A.at_points(_mae_rows(spark, sf_dir), w.select(F.lit("nations").alias("set"), F.col("query").alias("point"), "i", "j", "w")).withColumn("value", V.rounded("value", 9))


def _mae_rows(spark, sf_dir):
    return R.metric_rows(V.field_ev(spark, sf_dir), [M.MAE])


QUERIES["a08_points"] = a08_points
_PX = "cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z"
SQLS["a08_points"] = sql(
    "SELECT metric, combo, 'nations' AS set, query AS point, date, channel, round(sum(value * w) / sum(w) FILTER (value IS NOT NULL), 9) AS value FROM metric JOIN wt USING (i, j) GROUP BY ALL",
    *_EV, V.AREAS, f"sites AS (SELECT n_nationkey AS query, {_PX} FROM (SELECT *, n_nationkey * 0.1::DOUBLE + 60.03 AS lat, n_nationkey + 0.5::DOUBLE AS lon FROM nation))",
    f"cells8 AS (SELECT i, j, {_PX} FROM (SELECT *, i * 0.7::DOUBLE + 60 AS lat, j * 3.0::DOUBLE AS lon FROM areas))",
    "near AS (SELECT * FROM (SELECT query, i, j, d, row_number() OVER (PARTITION BY query ORDER BY d, i * 100 + j) AS rank FROM (SELECT query, i, j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM sites a CROSS JOIN cells8 b)) WHERE rank <= 3)",
    "wt AS (SELECT query, i, j, (1 / d) / sum(1 / d) OVER (PARTITION BY query) AS w FROM near)",
)


def g05_regrid(spark, sf_dir):
    w = G.bilinear_weights(V.part_pt(spark, sf_dir).select((F.col("q") % 18).cast("int").alias("dst_i"), (F.col("q") % 17).cast("int").alias("dst_j")).distinct().withColumns({"y": F.col("dst_i") + 0.25, "x": F.col("dst_j") + 0.5}))
    return G.regridded(V.field_li(spark, sf_dir), w).withColumn("value", V.rounded("value", 9))


QUERIES["g05_regrid"] = g05_regrid
SQLS["g05_regrid"] = sql("SELECT dataset, date, channel, dst_i AS i, dst_j AS j, CASE WHEN count(value) = 4 THEN round(sum(value * w), 9) END AS value FROM wt JOIN field_li f ON f.i = src_i AND f.j = src_j GROUP BY ALL", V.FIELD_LI, "wt AS (SELECT dst_i, dst_j, dst_i + a AS src_i, dst_j + b AS src_j, (CASE a WHEN 1 THEN 0.25::DOUBLE ELSE 0.75 END) * 0.5 AS w FROM (SELECT DISTINCT (p_partkey % 18)::INT AS dst_i, (p_partkey % 17)::INT AS dst_j FROM part) CROSS JOIN (VALUES (0), (1)) x(a) CROSS JOIN (VALUES (0), (1)) y(b))")


def z06_projection(spark, sf_dir):
    p = V.part_pt(spark, sf_dir)
    x, y = J.to_polar(F.col("lat"), F.col("lon"))
    lat, lon = J.from_polar(F.col("x"), F.col("y"))
    return p.select("q", x.alias("x"), y.alias("y")).withColumns({"lat": lat, "lon": lon}).select("q", *[F.round(c, 4).alias(c) for c in ("x", "y")], *[F.round(c, 6).alias(c) for c in ("lat", "lon")])


QUERIES["z06_projection"] = z06_projection
_T = f"(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {J.ECC} * sin(radians(lat))) / (1 + {J.ECC} * sin(radians(lat))), {J.ECC / 2}))"
SQLS["z06_projection"] = sql(f"SELECT q, round({J.SCALE} * {_T} * sin(radians(lon + 45)), 4) AS x, round(-{J.SCALE} * {_T} * cos(radians(lon + 45)), 4) AS y, round(lat, 6) AS lat, round(CASE WHEN lon = 180 THEN -180 ELSE lon END, 6) AS lon FROM part_pt", V.PART_PT)


def g04_area(spark, sf_dir):
    """Area of the cells of a grid over the supplier keys' 20 x 20 lattice."""
    cells = V.field_li(spark, sf_dir).select("i", "j").distinct().withColumns({"lat": 70 + F.col("i") * 0.2, "lon": F.col("j") * 0.4 + 10})
    return G.cell_area(G.corners(cells)).select("i", "j", F.round("area", 4).alias("area"))


QUERIES["g04_area"] = g04_area
_lat, _lon = V.from_polar_sql("x", "y")
_det = "p{0} * (q{1} * r{2} - r{1} * q{2}) - q{0} * (p{1} * r{2} - r{1} * p{2}) + r{0} * (p{1} * q{2} - q{1} * p{2})"
_dot = "(p{0} * p{1} + q{0} * q{1} + r{0} * r{1})"
_tri = lambda a, b, c: f"2 * atan2(abs({_det.format(a, b, c)}), 1 + {_dot.format(a, b)} + {_dot.format(b, c)} + {_dot.format(a, c)})"
SQLS["g04_area"] = sql(
    f"SELECT i, j, round(({_tri(0, 1, 2)} + {_tri(0, 2, 3)}) * {J.EARTH_KM}::DOUBLE ** 2, 4) AS area FROM flat",
    V.FIELD_LI, *V.CORNERS, f"sphere AS (SELECT i, j, k, cos(radians(lat)) * cos(radians(lon)) AS p, cos(radians(lat)) * sin(radians(lon)) AS q, sin(radians(lat)) AS r FROM (SELECT i, j, k, {_lat} AS lat, {_lon} AS lon FROM corner))",
    "flat AS (SELECT i, j, " + ", ".join(f"max({c}) FILTER (k = {k}) AS {c}{k}" for c in "pqr" for k in range(4)) + " FROM sphere GROUP BY i, j HAVING count(*) = 4)",
)
_LATTICE = "lattice AS (SELECT (s_suppkey - m)::INT AS i, n_nationkey::INT AS j, (70 + (s_suppkey - m) * 0.01::DOUBLE) AS lat, n_nationkey * 0.4::DOUBLE + 10 AS lon FROM supplier CROSS JOIN nation CROSS JOIN (SELECT min(s_suppkey) AS m FROM supplier)), size AS (SELECT max(i) AS h, max(j) AS w FROM lattice)"
_lattice = lambda s, d: G.mesh(V.table(s, d, "supplier").crossJoin(F.broadcast(V.table(s, d, "supplier").agg(F.min("s_suppkey").alias("m")))).select((F.col("s_suppkey") - F.col("m")).cast("int").alias("i"), (F.lit(70) + (F.col("s_suppkey") - F.col("m")) * 0.01).alias("lat")), V.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("j"), (F.col("n_nationkey") * 0.4 + 10).alias("lon")))
_query("g10d_outline", lambda s, d: G.outline(_lattice(s, d)), "SELECT o::INT AS ring_order, i, j, round(lat, 9) AS lat, round(lon, 9) AS lon FROM size CROSS JOIN LATERAL (SELECT unnest(range(2 * (h + w) + 1)) AS o) JOIN lattice ON i = CASE WHEN o <= w THEN 0 WHEN o <= w + h THEN o - w WHEN o <= 2 * w + h THEN h ELSE 2 * (w + h) - o END AND j = CASE WHEN o <= w THEN o WHEN o <= w + h THEN w WHEN o <= 2 * w + h THEN 2 * w + h - o ELSE 0 END", _LATTICE, cols=("lat", "lon"))
_query("g02_mesh", lambda s, d: G.mesh(V.grid_pt(s, d).select(F.col("k").alias("i"), "lat"), V.table(s, d, "nation").select(F.col("n_nationkey").alias("j"), (F.col("n_nationkey") * 2.0).alias("lon"))), "SELECT k AS i, n_nationkey AS j, round(lat, 9) AS lat, n_nationkey * 2.0::DOUBLE AS lon FROM grid_pt CROSS JOIN nation", V.GRID_PT, cols=("lat", "lon"))

# sources
_url = lambda s, d: V.table(s, d, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("n"))
_query("s04_date_parse", lambda s, d: _url(s, d).select("page_id", F.coalesce(F.try_to_date(F.concat(F.lit("2023"), F.lpad("n", 4, "0")), "yyyyMMdd"), F.try_to_date(F.concat(F.lit("2024-01-"), F.lpad(F.right("n", F.lit(2)), 2, "0")), "yyyy-MM-dd")).alias("date")), "SELECT page_id, coalesce(CAST(try_strptime('2023' || lpad(n, 4, '0'), '%Y%m%d') AS DATE), CAST(try_strptime('2024-01-' || lpad(right(n, 2), 2, '0'), '%Y-%m-%d') AS DATE)) AS date FROM (SELECT page_id, regexp_extract(url, '/(\\d+)', 1) AS n FROM pages)", cols=())
_query("s02_periods", lambda s, d: V.table(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").getField("start").cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n")), "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS period, count(*) AS n FROM events GROUP BY ALL", cols=())
_query("s12_unique_variable", lambda s, d: V.table(s, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id")).where("n = 1").select("k", "user_id", "event_id"), "SELECT json_extract_string(props, '$.k') AS k, user_id, min(event_id) AS event_id FROM events GROUP BY ALL HAVING count(*) = 1", cols=())
_query("s20_slice", lambda s, d: V.field_ev(s, d).where((F.col("date") >= "2024-01-05") & (F.col("date") <= "2024-01-07")), "SELECT dataset, date, channel, i, j, round(value, 9) AS value FROM field_ev WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'", V.FIELD_EV)

# validation runs
_RUN = "SELECT 'temporal' AS aggregator, metric, combo, date, channel, NULL::INT AS i, NULL::INT AS j, round(avg(value), 9) AS value FROM metric GROUP BY ALL UNION ALL SELECT 'spatial', metric, combo, NULL, channel, i, j, round(avg(value), 9) FROM metric GROUP BY ALL UNION ALL SELECT 'average', metric, combo, NULL, NULL, NULL, NULL, round(avg(value), 9) FROM metric GROUP BY ALL"
_ALL = [R.TEMPORAL, R.SPATIAL, R.AVERAGE]


def v02_run(spark, sf_dir):
    return R.run(V.field_ev(spark, sf_dir), [M.MAE], _ALL).withColumn("value", V.rounded("value", 9))


def v03_resume(spark, sf_dir):
    """The run in two parts, the second resuming the first's stored states."""
    store = R.Store(spark, R.shared_folder(spark))
    field = V.field_ev(spark, sf_dir)
    store.add(R.in_range(field, "2024-01-01", "2024-01-12"), [M.MAE], _ALL)
    store.add(field, [M.MAE], _ALL)
    return store.summary().withColumn("value", V.rounded("value", 9))


QUERIES |= {"v02_run": v02_run, "v03_resume": v03_resume}
SQLS |= {"v02_run": sql(_RUN, *_EV), "v03_resume": sql(_RUN, *_EV)}
_query("v01_range", lambda s, d: R.in_range(V.field_ev(s, d), "2024-01-03", "2024-01-09"), "SELECT dataset, date, channel, i, j, round(value, 9) AS value FROM field_ev WHERE date >= DATE '2024-01-03' AND date < DATE '2024-01-09'", V.FIELD_EV)
_query("v05_availability", lambda s, d: R.missing_dates(V.field_ev(s, d).where("value > 190"), V.field_ev(s, d).select("date").distinct()), "SELECT dataset, date FROM (SELECT DISTINCT dataset FROM field_ev WHERE value > 190) CROSS JOIN (SELECT DISTINCT date FROM field_ev) ANTI JOIN (SELECT DISTINCT dataset, date FROM field_ev WHERE value > 190) USING (dataset, date)", V.FIELD_EV, cols=())
