"""Queries: catalogs, sequences, clean-up rules and the remaining joins and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridproof.functions.missing import flag
from gridproof.functions.projection import geodesic
from gridproof.operators import aggregators as A
from gridproof.operators import align as X
from gridproof.operators import forecast as FC
from gridproof.operators import grid as G
from gridproof.operators import metrics as M
from gridproof.operators import points as P
from gridproof.sources import catalog, readers

from . import cycles as C
from . import validate as R
from . import views as V
from .q_metrics import _EV, _VEC, _mae, _vectors
from .q_runs import _query as _add
from .q_runs import QUERIES as _RUNS
from .q_runs import SQLS as _RUN_SQLS
from .views import sql

QUERIES, SQLS = {}, {}


def _query(key, *args, **more):
    _add(key, *args, **more)
    QUERIES[key] = _RUNS.pop(key)
    if key in _RUN_SQLS:
        SQLS[key] = _RUN_SQLS.pop(key)


# names built from the tables' keys stand for file names
_name = lambda s, d: V.table(s, d, "orders").select("o_orderkey", F.concat(F.lit("/data/x_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_v"), F.col("o_orderkey") % 3, F.when(F.col("o_orderkey") % 7 == 0, "!").otherwise(".nc")).alias("path"))
_NAME = "names AS (SELECT CAST(o_orderdate AS DATE) AS date, '/data/x_' || strftime(o_orderdate, '%Y%m%d') || '_v' || (o_orderkey % 3) || CASE WHEN o_orderkey % 7 = 0 THEN '!' ELSE '.nc' END AS path FROM orders)"
_query("s01_catalog", lambda s, d: catalog.by_date(_name(s, d).select("path").distinct()).withColumn("files", F.array_join("files", ",")), "SELECT date, string_agg(path, ',' ORDER BY path) AS files FROM (SELECT DISTINCT * FROM names) GROUP BY date", _NAME, cols=())
_query("s03_variables", lambda s, d: catalog.by_variable(_name(s, d).select("path"), F.regexp_extract("path", r"_(v\d)", 1)).select("date", F.array_join(F.transform(F.map_entries("files"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("files")), "SELECT date, string_agg(v || '=' || path, ',' ORDER BY v) AS files FROM (SELECT date, regexp_extract(path, '_(v\\d)', 1) AS v, max(path) AS path FROM names GROUP BY ALL) GROUP BY date", _NAME, cols=())
_query("s06_one_file", lambda s, d: catalog.one_file_a_date(V.field_ev(s, d).select("date", F.date_format("date", "yyyyMM").alias("path")).distinct()), "SELECT DISTINCT date, strftime(date, '%Y%m') AS path FROM field_ev", V.FIELD_EV, cols=())
_steps = lambda s, d: V.table(s, d, "events").groupBy(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"))
_STEPS = "steps AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS value FROM events GROUP BY ALL)"
_query("s07_sequence", lambda s, d: readers.sequence_steps(_steps(s, d), _steps(s, d).select(F.col("ts").alias("start_ts")), 4, 3), "SELECT start_ts, step, ts, round(value, 9) AS value FROM (SELECT a.ts AS start_ts, k AS step, b.ts, b.value, count(*) OVER (PARTITION BY a.ts) AS n FROM steps a CROSS JOIN (SELECT unnest(range(4))::INT AS k) JOIN steps b ON b.ts = a.ts + to_hours(k * 3)) WHERE n = 4", _STEPS)
_query("s08_masked", lambda s, d: V.field_ev(s, d).join(V.areas(s, d), ["i", "j"]).select("dataset", "date", "channel", "i", "j", (F.col("value") * flag(F.col("area") > 20)).alias("value")), "SELECT dataset, date, channel, i, j, round(value * (area > 20)::INT, 9) AS value FROM field_ev JOIN areas USING (i, j)", V.FIELD_EV, V.AREAS)
_query("s11_inventory", lambda s, d: V.table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("level")).distinct(), "SELECT DISTINCT event_type, json_extract_string(props, '$.k') AS level FROM events", cols=())
_query("s21_constant", lambda s, d: readers.constant(V.areas(s, d), "constant", [1.0, 2.5], "2024-01-01", "2024-01-04"), "SELECT 'constant' AS dataset, CAST(dd AS DATE) AS date, c AS channel, i, j, v AS value FROM areas CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-03', INTERVAL 1 DAY)) AS dd) CROSS JOIN (VALUES (0, 1.0::DOUBLE), (1, 2.5::DOUBLE)) x(c, v)", V.AREAS)
_query("s26_cleanup", lambda s, d: V.table(s, d, "events").select("event_id", readers.packed(F.col("value") * 1000 - 40000, 0.01).alias("value"), readers.model_ice(F.when(F.col("event_id") % 5 > 0, F.col("value")), F.col("user_id") % 4 == 0, 100.0).alias("ice")), "SELECT event_id, round(CASE WHEN value * 1000 - 40000 > -32767 THEN (value * 1000 - 40000) * 0.01::DOUBLE END, 6) AS value, round(CASE WHEN user_id % 4 <> 0 THEN coalesce(CASE WHEN event_id % 5 > 0 THEN value END, 0) * 100 END, 6) AS ice FROM events", digits=6, cols=("value", "ice"))
_query("x14_all_for_valid", lambda s, d: V.fc_ev(s, d).join(V.fc_ev(s, d).where("lead_h = 6").select("valid_time").distinct(), "valid_time").select("valid_time", "init_time", "lead_h", "value"), "SELECT valid_time, init_time, lead_h, round(value, 9) AS value FROM fc_ev WHERE valid_time IN (SELECT valid_time FROM fc_ev WHERE lead_h = 6)", V.FC_EV)
_query("x02_align", lambda s, d: X.combos(V.field_ev(s, d)).where("v1 IS NOT NULL AND v2 IS NOT NULL"), "SELECT combo, date, channel, i, j, round(v1, 9) AS v1, round(v2, 9) AS v2 FROM pairs WHERE v1 IS NOT NULL AND v2 IS NOT NULL", V.FIELD_EV, V.PAIRS, cols=("v1", "v2"))
_hour = "CAST(date_trunc('hour', {}) AS TIMESTAMP)"
_query("x12_nearest_time", lambda s, d: P.hourly(V.track_ev(s, d), 20, ["value"]), f"SELECT buoy_id, h AS ts, t.ts AS sample_ts, round(t.value, 9) AS value FROM (SELECT buoy_id, unnest(generate_series({_hour.format('min(ts)')}, {_hour.format('max(ts)')} + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM track_ev GROUP BY buoy_id) JOIN track_ev t USING (buoy_id) WHERE abs(epoch_us(t.ts) - epoch_us(h)) <= 1200000000 QUALIFY row_number() OVER (PARTITION BY buoy_id, h ORDER BY abs(epoch_us(t.ts) - epoch_us(h)), t.ts DESC) = 1", V.TRACK_EV)
_query("f04_point", lambda s, d: V.fc_ev(s, d).where("lead_h = 12 AND init_time = TIMESTAMP_NTZ'2024-01-03 00:00:00'").select("init_time", "lead_h", "value"), "SELECT init_time, lead_h, round(value, 9) AS value FROM fc_ev WHERE lead_h = 12 AND init_time = TIMESTAMP '2024-01-03'", V.FC_EV)
_query("f10_window_times", lambda s, d: V.fc_ev(s, d).select(F.col("valid_time").alias("anchor")).distinct().select("anchor", F.posexplode(F.expr("sequence(anchor, anchor + INTERVAL 18 HOURS, INTERVAL 6 HOURS)")).alias("step", "valid_time")), "SELECT DISTINCT f.valid_time AS anchor, k AS step, f.valid_time + to_hours(k * 6) AS valid_time FROM fc_ev f CROSS JOIN (SELECT unnest(range(4))::INT AS k)", V.FC_EV, cols=())
_query("f12_runs_of", lambda s, d: FC.with_valid_time(V.fc_ev(s, d).drop("valid_time")).groupBy("valid_time").agg(F.count("*").alias("n")), "SELECT valid_time, count(*) AS n FROM fc_ev GROUP BY valid_time", V.FC_EV, cols=())
_query("c08_map_mean", lambda s, d: A.average(_mae(s, d).where("channel = 0")), "SELECT metric, combo, round(avg(value), 9) AS value FROM metric GROUP BY ALL", *_EV)
_query("c15_several", lambda s, d: C.of_several(A.average(_mae(s, d)).unionByName(A.average(M.applied(X.combos(V.field_ev(s, d), 1), M.IDENTITY)))), "SELECT metric, combo, round(avg(value), 9) AS value FROM metric GROUP BY ALL", *_EV)
_query("v04_summary", lambda s, d: R.summary(R.partials(R.metric_rows(V.field_ev(s, d), [M.MAE, M.MSE]), [R.AVERAGE])).select("aggregator", "metric", "combo", "value"), "SELECT 'average' AS aggregator, m AS metric, combo, round(avg(CASE m WHEN 'mae' THEN value ELSE value * value END), 6) AS value FROM metric CROSS JOIN (VALUES ('mae'), ('mse')) x(m) GROUP BY ALL", *_EV, digits=6)
_query("p08_ingest", lambda s, d: P.keep_last(V.track_ev(s, d).withColumn("ts", F.date_trunc("HOUR", "ts").cast("timestamp_ntz")), "event_id").select("buoy_id", "ts", "event_id", "lat"), f"SELECT buoy_id, {_hour.format('ts')} AS ts, max(event_id) AS event_id, round(arg_max(lat, event_id), 9) AS lat FROM track_ev GROUP BY buoy_id, {_hour.format('ts')}", V.TRACK_EV, cols=("lat",))
_query("p09_batch", lambda s, d: P.keep_last(V.track_ev(s, d), "event_id").select("buoy_id", "ts", "value"), "SELECT buoy_id, ts, round(arg_max(value, event_id), 9) AS value FROM track_ev GROUP BY buoy_id, ts", V.TRACK_EV)
_query("p17_dates", lambda s, d: V.table(s, d, "events").select("event_id", F.date_trunc("MONTH", "ts").cast("timestamp_ntz").alias("period"), (F.date_trunc("HOUR", "ts").cast("timestamp_ntz") == F.col("ts")).alias("whole_hour")), "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS period, date_trunc('hour', ts) = ts AS whole_hour FROM events", cols=())
_query("g12_circular", lambda s, d: V.part_pt(s, d).groupBy((F.col("q") % 7).alias("k")).agg(F.degrees(F.atan2(F.avg(F.sin(F.radians("lon"))), F.avg(F.cos(F.radians("lon"))))).alias("value")), "SELECT q % 7 AS k, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) AS value FROM part_pt GROUP BY 1", V.PART_PT, digits=6)


def z07_geodesic(spark, sf_dir):
    """Distance of each part's point from that of a supplier, in km."""
    p = V.part_pt(spark, sf_dir).select("q", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), (F.col("q") % 100 + 1).alias("k"))
    g = p.join(V.grid_pt(spark, sf_dir), "k").withColumn("g", geodesic("lat", "lon", "lat2", "lon2"))
    return g.select("q", "k", F.round(F.col("g.metres") / 1000, 6).alias("km"), F.round("g.azimuth", 6).alias("azimuth"))


def g03_corners(spark, sf_dir):
    """Corners of the cells of a grid over the 20 x 20 lattice of the keys."""
    cells = V.field_li(spark, sf_dir).select("i", "j").distinct().withColumns({"lat": 70 + F.col("i") * 0.2, "lon": F.col("j") * 0.4 + 10})
    return G.corners(cells).select("i", "j", *[F.round(f"{c}{k}", 3).alias(f"{c}{k}") for c in "xy" for k in range(4)])


QUERIES |= {"g03_corners": g03_corners, "z07_geodesic": z07_geodesic}
SQLS["z07_geodesic"] = sql("SELECT q, k, round(metres / 1000, 6) AS km, round(azimuth, 6) AS azimuth FROM geo", V.GRID_PT, V.PART_PT, "pairs AS (SELECT q, k, g.lat AS lat1, g.lon AS lon1, p.lat AS lat2, p.lon AS lon2 FROM part_pt p JOIN grid_pt g ON g.k = q % 100 + 1)", *V.geodesic_sql("pairs"))
SQLS["g03_corners"] = sql("SELECT i, j, " + ", ".join(f"round(max({c}) FILTER (k = {k}), 3) AS {c}{k}" for c in "xy" for k in range(4)) + " FROM corner GROUP BY i, j HAVING count(*) = 4", V.FIELD_LI, *V.CORNERS)


def m17_drift_success(spark, sf_dir):
    """Success of drift of one event type against another, with the local spread of the change from the day before."""
    rows = _vectors(spark, sf_dir)
    v = V.vec_ev(spark, sf_dir)
    old = v.select("dataset", F.date_add("date", 1).alias("date"), "i", "j", F.col("u").alias("u0"), F.col("v").alias("v0"))
    change = v.join(old, ["dataset", "date", "i", "j"])
    du, dv = F.col("u") - F.col("u0"), F.col("v") - F.col("v0")
    m = G.local_moments(change.select("dataset", "date", "i", "j", (du + dv).alias("value"), du.alias("du"), dv.alias("dv")), 5, 2.0, ["dataset", "date"], u=F.col("du"), v=F.col("dv"), uu=F.col("du") * F.col("du"), vv=F.col("dv") * F.col("dv"))
    std = lambda a: F.sqrt(F.greatest(F.col(a * 2) - F.col(a) * F.col(a), F.lit(0.0)))
    local = m.select(F.col("dataset").alias("d2"), "date", "i", "j", M.vector_norm(std("u"), std("v")).alias("local"))
    joined = rows.join(local, ["d2", "date", "i", "j"], "left")
    return M.drift_success(joined, F.col("local"), 5.0).select("combo", "date", "i", "j", "value")


QUERIES["m17_drift_success"] = m17_drift_success
_W5 = "exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2) / 2.0)"
SQLS["m17_drift_success"] = sql(
    "SELECT combo, date, i, j, CASE WHEN loc IS NOT NULL THEN (sqrt((u1 - u2) ** 2 + (v1 - v2) ** 2) <= greatest(0.674 * loc, 5.0))::INT::DOUBLE END AS value FROM vecs LEFT JOIN loc ON d = split_part(combo, '|', 2) AND loc.date2 = vecs.date AND loc.i2 = vecs.i AND loc.j2 = vecs.j",
    V.VEC_EV, _VEC,
    "ch AS (SELECT a.dataset AS d, a.date, a.i, a.j, a.u - b.u AS cu, a.v - b.v AS cv FROM vec_ev a JOIN vec_ev b ON a.dataset = b.dataset AND a.date = b.date + 1 AND a.i = b.i AND a.j = b.j)",
    f"loc AS (SELECT d, date2, i2, j2, sqrt(greatest(uu - u * u, 0) + greatest(vv - v * v, 0)) AS loc FROM (SELECT a.d, a.date AS date2, a.i AS i2, a.j AS j2, sum(b.cu * {_W5}) / sum({_W5}) AS u, sum(b.cu * b.cu * {_W5}) / sum({_W5}) AS uu, sum(b.cv * {_W5}) / sum({_W5}) AS v, sum(b.cv * b.cv * {_W5}) / sum({_W5}) AS vv FROM ch a JOIN ch b ON a.d = b.d AND a.date = b.date AND abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 GROUP BY ALL))",
)
