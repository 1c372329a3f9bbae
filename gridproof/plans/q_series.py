"""Queries: derived fields, alignment, cycles and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridproof.functions import scalars as Z
from gridproof.operators import aggregators as A
from gridproof.operators import align as X
from gridproof.operators import derived as D
from gridproof.operators import metrics as M

from . import cycles as C
from . import views as V
from .q_metrics import _MAE, _EV, _mae, _vectors, _VEC
from .views import r9, sql

QUERIES, SQLS = {}, {}
CELL = "dataset, date, channel, i, j"


def _query(key, query, select, *views, digits=9, cols=("value",)):
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: V.rounded(c, digits) for c in cols})

    QUERIES[key] = run
    SQLS[key] = sql(select, *views)


ev, li = V.field_ev, V.field_li
_CLICK = "field_ev WHERE dataset = 'click'"

_query("s05_daily_mean", lambda s, d: D.daily_mean(V.table(s, d, "events").select(F.col("event_type").alias("dataset"), F.to_date("ts").alias("date"), F.lit(0).alias("channel"), F.floor(F.col("user_id") / 10).cast("int").alias("i"), (F.col("user_id") % 10).cast("int").alias("j"), F.hour("ts").alias("step"), "value"), [0, 6, 12, 18]), "SELECT event_type AS dataset, CAST(ts AS DATE) AS date, 0 AS channel, (user_id // 10)::INT AS i, (user_id % 10)::INT AS j, round(avg(value), 9) AS value FROM events WHERE hour(ts) IN (0, 6, 12, 18) GROUP BY ALL")
_query("d01_delay", lambda s, d: D.delayed(ev(s, d), 3), "SELECT dataset || '_t-3d' AS dataset, CAST(date + 3 AS DATE) AS date, channel, i, j, round(value, 9) AS value FROM field_ev", V.FIELD_EV)
_query("d02_dynamics", lambda s, d: D.dynamics(ev(s, d), 1), "SELECT a.dataset || '_t-1d_dynamics' AS dataset, a.date, a.channel, a.i, a.j, round(a.value - b.value, 9) AS value FROM field_ev a JOIN field_ev b ON a.dataset = b.dataset AND a.date = b.date + 1 AND a.i = b.i AND a.j = b.j", V.FIELD_EV)
_query("d03_extent", lambda s, d: D.extent(ev(s, d), 50), "SELECT dataset, date, channel, i, j, CASE WHEN value >= 50 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM field_ev", V.FIELD_EV)
_query("d04_extent01", lambda s, d: D.extent01(ev(s, d), 50), "SELECT dataset, date, channel, i, j, (value >= 50)::INT::DOUBLE AS value FROM field_ev", V.FIELD_EV)
_AREA = "SELECT dataset, date, channel, i, j, {v} AS value FROM (SELECT f.*, area, CASE WHEN max(value) OVER (PARTITION BY dataset, date) > 1 THEN 0.01 ELSE 1.0 END AS k FROM field_ev f JOIN areas USING (i, j))"
_query("d05_area", lambda s, d: D.scaled_by_area(ev(s, d), V.areas(s, d)), _AREA.format(v="round(value * k * area, 9)"), V.FIELD_EV, V.AREAS)
_query("d06_volume", lambda s, d: D.volume(ev(s, d).where("dataset = 'click'"), ev(s, d).where("dataset = 'view'"), V.areas(s, d)), f"SELECT a.dataset, a.date, a.channel, a.i, a.j, round(a.value * b.value, 9) AS value FROM ({_AREA.format(v='value * k * area')}) a JOIN field_ev b ON b.dataset = 'view' AND a.date = b.date AND a.i = b.i AND a.j = b.j WHERE a.dataset = 'click'", V.FIELD_EV, V.AREAS)
_query("d07_surface", lambda s, d: D.surface(ev(s, d).withColumn("channel", F.col("j") % 3)), "SELECT dataset, date, j % 3 AS channel, i, j, round(value, 9) AS value FROM field_ev WHERE j % 3 = 0", V.FIELD_EV)
_GRID = lambda s, d: V.areas(s, d).select("i", "j", (F.col("i") * 0.5 + 60).alias("lat"), (F.col("j") * 2.0 - 180).alias("lon"))
_query("d09_coords", lambda s, d: D.with_coordinates(ev(s, d), _GRID(s, d), 1), f"SELECT {CELL}, round(value, 9) AS value FROM field_ev UNION ALL SELECT dataset, date, c AS channel, i, j, round(CASE c WHEN 1 THEN i * 0.5::DOUBLE + 60 ELSE j * 2.0::DOUBLE - 180 END, 9) FROM (SELECT DISTINCT dataset, date FROM field_ev) CROSS JOIN areas CROSS JOIN (VALUES (1), (2)) v(c)", V.FIELD_EV, V.AREAS)


def d10_encoding(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select("event_id", (F.dayofyear("ts") - 1).alias("d"), F.hour("ts").alias("h"), F.floor(F.col("user_id") / 10).cast("int").alias("i"), (F.col("user_id") % 10).cast("int").alias("j"))
    day, hour = D.time_encoding(F.col("d"), F.col("h"), F.col("i"), F.col("j"))
    return rows.select("event_id", r9(day, "day"), r9(hour, "hour"))


QUERIES["d10_encoding"] = d10_encoding
_W = "(abs(abs({c}::DOUBLE - {p}) - 0.5) + 0.05) * {x} * (2 * pi() / 10)"
_P = {"d": "(dayofyear(ts) - 1) / 365.0::DOUBLE", "h": "hour(ts) / 24.0::DOUBLE"}
SQLS["d10_encoding"] = "SELECT event_id, " + ", ".join(f"round(({f}({_W.format(c=0.5, p=_P[p], x='(user_id % 10)')}) + {f}({_W.format(c=0.25, p=_P[p], x='(user_id // 10)')})) / 2, 9) AS {n}" for n, p, f in (("day", "d", "sin"), ("hour", "h", "cos"))) + " FROM events"
_query("d12_concat", lambda s, d: D.concat_channels(ev(s, d), D.extent01(ev(s, d), 50), 1), f"SELECT {CELL}, round(value, 9) AS value FROM field_ev UNION ALL SELECT dataset, date, channel + 1, i, j, (value >= 50)::INT::DOUBLE FROM field_ev", V.FIELD_EV)
_query("d13_block", lambda s, d: D.block_mean(li(s, d), 3, 20, 20), "SELECT dataset, date, channel, (i // 3)::INT AS i, (j // 3)::INT AS j, CASE WHEN count(value) >= 4 THEN round(avg(value), 9) END AS value FROM field_li WHERE i < 18 AND j < 18 GROUP BY dataset, date, channel, i // 3, j // 3", V.FIELD_LI)
_query("d14_stride", lambda s, d: D.every_nth(li(s, d), 2), f"SELECT {CELL}, round(value, 9) AS value FROM field_li WHERE i % 2 = 0 AND j % 2 = 0", V.FIELD_LI)
_query("d15_crop", lambda s, d: D.cropped(ev(s, d).withColumn("value", F.when((F.col("i") > 1) & (F.col("j") > 2), F.col("value")))), "SELECT dataset, date, channel, (i - i0)::INT AS i, (j - j0)::INT AS j, round(CASE WHEN i > 1 AND j > 2 THEN value END, 9) AS value FROM field_ev JOIN (SELECT dataset, date, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM field_ev WHERE i > 1 AND j > 2 GROUP BY ALL) USING (dataset, date) WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1", V.FIELD_EV)
_query("d16_profile", lambda s, d: D.profile(ev(s, d).where("dataset = 'click'").withColumn("channel", F.col("j") % 3), ev(s, d).select("date").distinct(), Z.KELVIN), f"SELECT date, channel, round(v - 273.15, 9) AS value FROM (SELECT DISTINCT date FROM field_ev) CROSS JOIN (SELECT DISTINCT j % 3 AS channel FROM {_CLICK}) LEFT JOIN (SELECT date, j % 3 AS channel, avg(value) AS v FROM {_CLICK} GROUP BY ALL) USING (date, channel)", V.FIELD_EV)
_query("d16_range", lambda s, d: D.value_range(ev(s, d).withColumn("value", F.col("value") - 100)), "SELECT round(CASE WHEN lo < 0 AND hi > 0 THEN -greatest(abs(lo), abs(hi)) ELSE lo END, 9) AS lo, round(CASE WHEN lo < 0 AND hi > 0 THEN greatest(abs(lo), abs(hi)) ELSE hi END, 9) AS hi FROM (SELECT min(value - 100) AS lo, max(value - 100) AS hi FROM field_ev)", V.FIELD_EV, cols=("lo", "hi"))
_query("s22_fusion", lambda s, d: ev(s, d).groupBy("date", "channel", "i", "j").agg(F.avg("value").alias("value")), "SELECT date, channel, i, j, round(avg(value), 9) AS value FROM field_ev GROUP BY ALL", V.FIELD_EV)

_two = lambda s, d: [ev(s, d).where(f"dataset = '{n}'") for n in ("click", "view")]
_KEYS = ["date", "channel", "i", "j"]
_ZIP = "SELECT date, channel, i, j, {cols} FROM (SELECT *, TRUE AS in1 FROM field_ev WHERE dataset = 'click') a {how} JOIN (SELECT *, TRUE AS in2 FROM field_ev WHERE dataset = 'view') b USING (date, channel, i, j)"
_query("x03_strict", lambda s, d: X.paired(_two(s, d)[0], D.extent01(_two(s, d)[0], 50), _KEYS, "strict"), "SELECT date, channel, i, j, round(value, 9) AS v1, (value >= 50)::INT::DOUBLE AS v2 FROM field_ev WHERE dataset = 'click'", V.FIELD_EV, cols=("v1", "v2"))
_query("x04_inner", lambda s, d: X.paired(*_two(s, d), _KEYS), _ZIP.format(cols="round(a.value, 9) AS v1, round(b.value, 9) AS v2", how="INNER"), V.FIELD_EV, cols=("v1", "v2"))
_query("x05_union", lambda s, d: X.paired(*_two(s, d), _KEYS, "union", -1.0), _ZIP.format(cols="CASE WHEN in1 THEN round(a.value, 9) ELSE -1.0::DOUBLE END AS v1, CASE WHEN in2 THEN round(b.value, 9) ELSE -1.0::DOUBLE END AS v2", how="FULL"), V.FIELD_EV, cols=("v1", "v2"))
_query("x06_odd_keys", lambda s, d: X.odd_keys(*_two(s, d), _KEYS), "SELECT date, channel, i, j, side FROM (SELECT *, 'left' AS side FROM field_ev WHERE dataset = 'click') a ANTI JOIN (SELECT * FROM field_ev WHERE dataset = 'view') b USING (date, channel, i, j) UNION ALL SELECT date, channel, i, j, 'right' FROM (SELECT * FROM field_ev WHERE dataset = 'view') a ANTI JOIN (SELECT * FROM field_ev WHERE dataset = 'click') b USING (date, channel, i, j)", V.FIELD_EV, cols=())
_query("x07_lifted", lambda s, d: ev(s, d).select("dataset", *_KEYS, Z.clip_high(Z.times(F.col("value"), 2.0), 150.0).alias("value")), f"SELECT {CELL}, round(CASE WHEN value * 2 < 150 THEN value * 2 END, 9) AS value FROM field_ev", V.FIELD_EV)
_query("x08_stack", lambda s, d: ev(s, d).groupBy(*_KEYS).pivot("dataset", ["click", "view", "purchase"]).agg(F.first("value")).where("click IS NOT NULL AND view IS NOT NULL AND purchase IS NOT NULL"), "SELECT a.date, a.channel, a.i, a.j, round(a.value, 9) AS click, round(b.value, 9) AS view, round(c.value, 9) AS purchase FROM field_ev a JOIN field_ev b ON a.date = b.date AND a.i = b.i AND a.j = b.j JOIN field_ev c ON a.date = c.date AND a.i = c.i AND a.j = c.j WHERE a.dataset = 'click' AND b.dataset = 'view' AND c.dataset = 'purchase'", V.FIELD_EV, cols=("click", "view", "purchase"))
_query("x09_lookup", lambda s, d: V.table(s, d, "embeddings").select("vec_id", F.round(X.by_id(F.sequence(F.col("vec_id"), F.col("vec_id") + 63), F.col("embedding").cast("array<double>"), F.col("vec_id") + F.col("label") * 20), 6).alias("value")), "SELECT vec_id, round(CASE WHEN label * 20 < 64 THEN embedding[label * 20 + 1] END::DOUBLE, 6) AS value FROM embeddings", digits=6)
_query("x10_component", lambda s, d: V.table(s, d, "embeddings").select("vec_id", X.component(F.col("embedding").cast("array<double>"), 3).alias("value"), X.component(F.col("embedding").cast("array<double>"), 99, -1.0).alias("beyond")), "SELECT vec_id, round(embedding[4]::DOUBLE, 9) AS value, -1.0::DOUBLE AS beyond FROM embeddings")
_HOUR = "date_trunc('hour', ts)"
_query("x13_nearest", lambda s, d: X.nearest_time(V.track_ev(s, d), V.track_ev(s, d).select("buoy_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("at")), ["buoy_id"]), f"SELECT q.buoy_id, q.at, arg_min(t.ts, (abs(epoch_us(t.ts) - epoch_us(q.at)), t.ts)) AS nearest FROM (SELECT DISTINCT buoy_id, CAST({_HOUR} AS TIMESTAMP) AS at FROM track_ev) q JOIN track_ev t USING (buoy_id) GROUP BY ALL", V.TRACK_EV, cols=())
_query("x16_anti", lambda s, d: X.availability(ev(s, d)).join(X.availability(ev(s, d)).where("date < DATE'2024-01-12'").select("date").distinct(), "date", "left_anti"), "SELECT DISTINCT dataset, date FROM field_ev WHERE date >= DATE '2024-01-12'", V.FIELD_EV, cols=())

ser = V.series_li
_SPAN = "(SELECT combo, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM series_li GROUP BY combo)"
_query("c01_evolution", lambda s, d: C.evolution(ser(s, d), "combo"), f"SELECT combo, date, round(value, 9) AS value FROM {_SPAN} LEFT JOIN series_li USING (combo, date)", V.SERIES_LI)
_starts = ", ".join(f"({k + 1}, {x})" for k, x in enumerate(C.MONTH_STARTS))
_query("c02_cycle", lambda s, d: C.cycle(ser(s, d), "combo"), f"SELECT combo, bin, x, round(avg(value), 9) AS value FROM (SELECT DISTINCT combo FROM series_li) CROSS JOIN (VALUES {_starts}) b(bin, x) LEFT JOIN (SELECT combo, month(date)::INT AS bin, value FROM series_li) USING (combo, bin) GROUP BY ALL", V.SERIES_LI)
_query("c02_daily", lambda s, d: C.cycle(ser(s, d), "combo", by="day", how=F.median("value")), "SELECT combo, bin, bin AS x, round(median(value), 9) AS value FROM (SELECT DISTINCT combo FROM series_li) CROSS JOIN (SELECT unnest(range(1, 366))::INT AS bin) LEFT JOIN (SELECT combo, dayofyear(date)::INT AS bin, value FROM series_li) USING (combo, bin) GROUP BY ALL", V.SERIES_LI)
_query("c03_bands", lambda s, d: C.bands(ser(s, d), "combo"), "SELECT combo, month(date)::INT AS bin, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 9) AS p{p}" for p in (10, 25, 75, 90)) + " FROM series_li GROUP BY ALL", V.SERIES_LI, cols=("p10", "p25", "p75", "p90"))
_query("c04_sigma", lambda s, d: C.sigma_band(ser(s, d), "combo"), "SELECT combo, month(date)::INT AS bin, round(avg(value) - 2 * stddev_pop(value), 9) AS low, round(avg(value) + 2 * stddev_pop(value), 9) AS high FROM series_li GROUP BY ALL", V.SERIES_LI, cols=("low", "high"))


def _pair_means(spark, sf_dir):
    p = A.average(_mae(spark, sf_dir)).withColumn("n", F.split("combo", r"\|"))
    one = p.select(F.get("n", F.lit(0)).alias("row"), F.get("n", F.lit(1)).alias("col"), "value")
    return one.unionByName(one.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


_NAMES = ["click", "error", "purchase", "signup", "view"]
_PAIRS = "means AS (SELECT split_part(combo, '|', 1) AS r, split_part(combo, '|', 2) AS c, avg(value) AS v FROM metric GROUP BY combo), both_ways AS (SELECT r, c, v FROM means UNION ALL SELECT c, r, v FROM means)"
_query("c05_matrix", lambda s, d: C.matrix(_pair_means(s, d), _NAMES), "SELECT r AS row, " + ", ".join(f'round(avg(v) FILTER (c = \'{n}\'), 9) AS "{n}"' for n in _NAMES) + ", round(avg(v), 9) AS mean FROM both_ways GROUP BY r", *_EV, _PAIRS, cols=(*_NAMES, "mean"))
_query("c05_range", lambda s, d: C.matrix_range(_pair_means(s, d)), "SELECT round(greatest(min(v), 0), 9) AS lo, round(max(v), 9) AS hi FROM both_ways", *_EV, _PAIRS, cols=("lo", "hi"))
_MAPS = "maps AS (SELECT combo, i, j, avg(value) AS v FROM metric GROUP BY ALL)"
_query("c06_range", lambda s, d: C.robust_range(A.spatial(_mae(s, d)), "metric"), "SELECT 'mae' AS metric, round(min(lo), 9) AS lo, round(max(hi), 9) AS hi FROM (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM maps WHERE v IS NOT NULL GROUP BY combo)", *_EV, _MAPS, cols=("lo", "hi"))


def _seasonal(spark, sf_dir):
    return A.seasonal_spatial(M.applied(X.combos(V.field_li(spark, sf_dir), 1), M.IDENTITY))


_SEASON = ", ".join(f"('{s}', {m})" for s, ms in A.SEASONS.items() for m in ms)
_query("c07_seasonal_range", lambda s, d: C.robust_range(_seasonal(s, d), "season"), f"SELECT season, round(min(lo), 9) AS lo, round(max(hi), 9) AS hi FROM (SELECT season, dataset, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM (SELECT season, dataset, i, j, avg(value) AS v FROM field_li JOIN (VALUES {_SEASON}) s(season, m) ON month(date) = m GROUP BY ALL) GROUP BY ALL) GROUP BY season", V.FIELD_LI, cols=("lo", "hi"))
_query("c09_vector_stats", lambda s, d: C.vector_stats(V.vec_ev(s, d), "dataset"), "SELECT dataset, round(quantile_cont(n, 0.01), 9) AS p1, round(quantile_cont(n, 0.99), 9) AS p99, round(min(n), 9) AS least, round(max(n), 9) AS most FROM (SELECT dataset, sqrt(avg(u) * avg(u) + avg(v) * avg(v)) AS n FROM vec_ev GROUP BY dataset, i, j) GROUP BY dataset", V.VEC_EV, cols=("p1", "p99", "least", "most"))
_query("c10_weekly_vectors", lambda s, d: C.vector_stats(V.vec_ev(s, d).withColumn("week", F.floor((F.dayofmonth("date") - 1) / 7).cast("int")), "dataset", "week"), "SELECT dataset, week, round(quantile_cont(n, 0.01), 9) AS p1, round(quantile_cont(n, 0.99), 9) AS p99, round(min(n), 9) AS least, round(max(n), 9) AS most FROM (SELECT dataset, ((day(date) - 1) // 7)::INT AS week, sqrt(avg(u) * avg(u) + avg(v) * avg(v)) AS n FROM vec_ev GROUP BY dataset, week, i, j) GROUP BY dataset, week", V.VEC_EV, cols=("p1", "p99", "least", "most"))
_query("c11_balance", lambda s, d: C.cycle(A.global_temporal(M.applied(X.combos(li(s, d), 1), M.IDENTITY)), "combo", how=F.median("value")), f"SELECT combo, bin, x, round(median(v), 9) AS value FROM (SELECT DISTINCT dataset AS combo FROM field_li) CROSS JOIN (VALUES {_starts}) b(bin, x) LEFT JOIN (SELECT dataset AS combo, month(date)::INT AS bin, date, avg(value) AS v FROM field_li GROUP BY ALL) USING (combo, bin) GROUP BY ALL", V.FIELD_LI)
_query("c12_regional", lambda s, d: A.regional_temporal(M.applied(X.combos(ev(s, d), 1), M.IDENTITY), V.regions(s, d)).join(V.table(s, d, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region")), "region_id").select("combo", "region", "date", "value"), "SELECT combo, r_name AS region, date, round(v, 9) AS value FROM (SELECT DISTINCT dataset AS combo, date FROM field_ev) CROSS JOIN (SELECT DISTINCT region_id FROM regions WHERE region_id <> 0) JOIN region ON r_regionkey = region_id LEFT JOIN (SELECT dataset AS combo, date, region_id, avg(value) AS v FROM field_ev JOIN regions USING (i, j) GROUP BY ALL) USING (combo, date, region_id)", V.FIELD_EV, V.REGIONS)
_query("c13_over", lambda s, d: A.global_temporal(M.applied(X.combos(ev(s, d), 2), M.IDENTITY_OVER).where("combo LIKE '%|view'")), "SELECT 'identity_over' AS metric, combo, date, channel, round(avg(CASE WHEN v2 IS NOT NULL THEN v1 END), 9) AS value FROM pairs WHERE combo LIKE '%|view' GROUP BY ALL", V.FIELD_EV, V.PAIRS)
_query("c14_pairs", lambda s, d: C.pair_lookup(C.of_several(A.average(_mae(s, d))), ["view", "click"], ["click", "signup", "error"]), "SELECT 'mae' AS metric, combo, r AS row, c AS col, round(avg(value), 9) AS value FROM metric JOIN (VALUES ('view', 'click'), ('view', 'signup'), ('view', 'error'), ('click', 'signup'), ('click', 'error')) t(r, c) ON combo IN (r || '|' || c, c || '|' || r) GROUP BY ALL", *_EV)
_query("c16_scatter", lambda s, d: C.scatter_stats(_vectors(s, d).select("combo", (F.col("u1") - F.col("u2")).alias("u"), (F.col("v1") - F.col("v2")).alias("v")), "combo"), "SELECT combo, round(avg(u1 - u2), 9) AS mean_u, round(avg(v1 - v2), 9) AS mean_v, round(r, 9) AS radius, round(greatest(15.0, 1.1 * max(greatest(abs(u1 - u2), abs(v1 - v2))), 1.1 * r), 9) AS reach FROM vecs JOIN (SELECT combo, sqrt(stddev_pop(u1 - u2) ^ 2 + stddev_pop(v1 - v2) ^ 2) AS r FROM vecs GROUP BY combo) USING (combo) GROUP BY combo, r", V.VEC_EV, _VEC, cols=("mean_u", "mean_v", "radius", "reach"))
_query("c17_hist", lambda s, d: C.histogram(V.vec_ev(s, d).select(F.col("u").alias("value")), 100.0), "SELECT least(floor((u + 100) / 4.0), 49)::INT AS bin, round(count(*) / ((SELECT count(*) FROM vec_ev WHERE u BETWEEN -100 AND 100) * 4.0), 9) AS density FROM vec_ev WHERE u BETWEEN -100 AND 100 GROUP BY 1", V.VEC_EV, cols=("density",))
_query("c18_on_times", lambda s, d: C.on_times(ev(s, d).select("date").distinct(), A.mean_of(A.partial(ev(s, d).where("value > 150"), "dataset", "date"))), "SELECT dataset, date, round(v, 9) AS value FROM (SELECT DISTINCT date FROM field_ev) CROSS JOIN (SELECT DISTINCT dataset FROM field_ev WHERE value > 150) LEFT JOIN (SELECT dataset, date, avg(value) AS v FROM field_ev WHERE value > 150 GROUP BY ALL) USING (dataset, date)", V.FIELD_EV)

_uv = lambda s, d: V.table(s, d, "events").select("event_id", (F.col("value") - 100).alias("u"), (F.col("user_id") % 37 - 18).cast("double").alias("v"), (F.col("event_id") % 900 - 450).cast("double").alias("lon"), (F.col("event_id") % 80).cast("double").alias("lat"))
_UV = "uv AS (SELECT event_id, value - 100 AS u, (user_id % 37 - 18)::DOUBLE AS v, (event_id % 900 - 450)::DOUBLE AS lon, (event_id % 80)::DOUBLE AS lat FROM events)"


def _scalars(key, select, expressions):
    QUERIES[key] = lambda spark, sf_dir: _uv(spark, sf_dir).select("event_id", *[r9(c, n) for n, c in select().items()])
    SQLS[key] = sql("SELECT event_id, " + ", ".join(f"round({e}, 9) AS {n}" for n, e in expressions.items()) + " FROM uv", _UV)


_c = F.col
_scalars("z01_cartesian", lambda: dict(zip(("x", "y"), Z.polar_to_cartesian(_c("u"), _c("lon"), True), strict=True)), {"x": "u * cos(radians(270 - lon))", "y": "u * sin(radians(270 - lon))"})
_A = "degrees(atan2(v, u))"
_B = f"({_A} - floor({_A} / 360) * 360)"
_scalars("z02_polar", lambda: dict(zip(("r", "a"), Z.cartesian_to_polar(_c("u"), _c("v"), True), strict=True)), {"r": "sqrt(u * u + v * v)", "a": f"(270 - {_B}) - floor((270 - {_B}) / 360) * 360"})
_U = "(u / cos(radians(lat)))"
_K = f"(sqrt(u * u + v * v) / greatest(sqrt({_U} * {_U} + v * v), 1e-6))"
_scalars("z03_stretch", lambda: dict(zip(("x", "y"), Z.stretch(_c("u"), _c("v"), _c("lat")), strict=True)), {"x": f"{_U} * {_K}", "y": f"v * {_K}"})
_scalars("z04_wrap", lambda: {"w": Z.wrap_longitude(_c("lon")), "c": Z.wrap_longitude(_c("lon"), 90.0)}, {"w": "(lon + 180) - floor((lon + 180) / 360) * 360 - 180", "c": "(lon - 90 + 180) - floor((lon - 90 + 180) / 360) * 360 - 180 + 90"})
_scalars("z08_sphere", lambda: dict(zip("xyz", Z.unit_sphere(_c("lat"), _c("lon")), strict=True)), {"x": "cos(radians(lat)) * cos(radians(lon))", "y": "cos(radians(lat)) * sin(radians(lon))", "z": "sin(radians(lat))"})
_scalars("z11_clip", lambda: {"t": Z.times(_c("u"), 3.0), "k": Z.clip_high(_c("u"), 0.0)}, {"t": "u * 3", "k": "CASE WHEN u < 0 THEN u END"})
_scalars("z13_units", lambda: {"percent": _c("u") * 100, "celsius": _c("u") - Z.KELVIN, "chart": _c("u") * Z.CHART_SPEED, "angle": F.lit(90.0) - _c("lon")}, {"percent": "u * 100", "celsius": "u - 273.15", "chart": "u * 51.444", "angle": "90.0 - lon"})
_query("z05_circular", lambda s, d: _uv(s, d).groupBy((F.col("v") % 5).alias("k")).agg(Z.circular_mean(F.col("lon")).alias("value")), "SELECT v % 5 AS k, round(m - floor((m + 180) / 360) * 360, 6) AS value FROM (SELECT v % 5 AS k0, any_value(v % 5) AS v, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS m FROM uv GROUP BY 1)", _UV, digits=6)
SQLS["z05_circular"] = sql("SELECT k, round(m - floor((m + 180) / 360) * 360, 6) AS value FROM (SELECT v % 5 AS k, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS m FROM uv GROUP BY 1)", _UV)
_query("z09_hours", lambda s, d: V.table(s, d, "orders").select("o_orderkey", Z.hours_in_period(F.to_date("o_orderdate")).alias("month_hours"), Z.hours_in_period(F.to_date("o_orderdate"), "year").alias("year_hours")), "SELECT o_orderkey, (date_diff('day', date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) * 24)::INT AS month_hours, (date_diff('day', date_trunc('year', o_orderdate), date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) * 24)::INT AS year_hours FROM orders", cols=())
_query("z10_norm", lambda s, d: V.table(s, d, "embeddings").select("vec_id", Z.norm(F.col("embedding").cast("array<double>")).alias("value")), "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS value FROM embeddings", digits=6)
_query("z12_times", lambda s, d: V.table(s, d, "events").select("event_id", Z.to_hour(F.col("ts")).cast("timestamp_ntz").alias("hour"), Z.epoch_seconds(F.col("ts")).alias("seconds")), "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, floor(epoch_us(ts) / 1000000)::BIGINT AS seconds FROM events", cols=())
_query("z14_units", lambda s, d: V.table(s, d, "events").select("event_id", Z.unit_factor(F.get(F.array(F.lit(" CM/s"), F.lit("m / s"), F.lit("furlong")), (F.col("event_id") % 3).cast("int"))).alias("value")), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS value FROM events")
