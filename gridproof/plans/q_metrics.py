"""Queries: combinations, metrics and aggregators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridproof.operators import aggregators as A
from gridproof.operators import align as X
from gridproof.operators import metrics as M

from . import views as V
from .views import r9, sql

QUERIES, SQLS = {}, {}
CELL = ["combo", "date", "channel", "i", "j"]


def _metric(key: str, metric: M.Metric, expression: str, of=None) -> None:
    view, source = {1: ("field_ev", None), 2: ("pairs", V.PAIRS), 3: ("triples", V.TRIPLES)}[metric.arity]

    def query(spark, sf_dir):
        rows = X.combos(V.field_ev(spark, sf_dir), metric.arity)
        return M.applied(rows, metric).select(*CELL, r9("value", "value"))

    QUERIES[key] = query
    if metric.arity == 1:
        cells = V.PAIRS.split("pairs AS")[0].rstrip(", \n")
        one = "singles AS (SELECT a.dataset AS combo, c.date, c.channel, c.i, c.j, x.value AS v1 FROM av a JOIN cells c ON c.date = a.date LEFT JOIN field_ev x ON x.dataset = a.dataset AND x.date = c.date AND x.i = c.i AND x.j = c.j)"
        view, source = "singles", f"{cells}, {one}"
    SQLS[key] = sql(f"SELECT combo, date, channel, i, j, round({expression}, 9) AS value FROM {view}", V.FIELD_EV, source)


_metric("m01_mse", M.MSE, "(v1 - v2) * (v1 - v2)")
_metric("m02_mae", M.MAE, "abs(v1 - v2)")
_metric("m03_relative_error", M.RELATIVE_ERROR, "CASE WHEN v2 = 0 THEN CASE WHEN v1 <> 0 THEN 'Infinity'::DOUBLE END ELSE abs((v1 - v2) / v2) * 100 END")
_metric("m04_difference", M.DIFFERENCE, "v1 - v2")
_metric("m05_identity", M.IDENTITY, "v1")
_metric("m06_times", M.TIMES, "v1 * v2")
_metric("m07_net", M.NET, "v1 * (1 - v2)")
_metric("m08_transformed", M.transformed("log1p", lambda a: F.log1p(a)), "ln(1 + v1)")
_metric("m09_squared", M.SQUARED, "v1 * v1")
_metric("m10_identity_over", M.IDENTITY_OVER, "CASE WHEN v2 IS NOT NULL THEN v1 END")
_metric("m14_chain", M.sequential(M.DIFFERENCE, M.SQUARED), "(v1 - v2) * (v1 - v2)")
_SIC = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN (abs(floor({a} / 10) - floor({b} / 10)) <= 1)::INT::DOUBLE END"
_metric("m16_sic_success", M.sic_success(), _SIC.format(a="v1", b="v2"))
_THICK = "CASE WHEN {p} IS NOT NULL AND v2 IS NOT NULL THEN coalesce((abs({p} - v2) <= CASE WHEN v3 IS NOT NULL THEN 0.3 * greatest(abs(v2 - v3), 0.1) END)::INT, 0)::DOUBLE END"
_metric("m18_thick_success", M.thick_success(), _THICK.format(p="v1"))
_metric("m19_efficiency", M.efficiency(M.sic_success()), f"{_SIC.format(a='v1', b='v2')} - {_SIC.format(a='v3', b='v2')}")
_metric("m19_thick_efficiency", M.efficiency(M.thick_success()), f"{_THICK.format(p='v1')} - {_THICK.format(p='v3')}")
_metric("x01_combos", M.Metric("third", 3, lambda a, b, c: c), "v3")


def _vectors(spark, sf_dir):
    a = V.vec_ev(spark, sf_dir)
    b = a.select(F.col("dataset").alias("d2"), "date", "i", "j", F.col("u").alias("u2"), F.col("v").alias("v2"))
    rows = a.withColumnsRenamed({"u": "u1", "v": "v1"}).join(b, ["date", "i", "j"]).where("dataset < d2")
    return rows.withColumn("combo", F.concat_ws("|", "dataset", "d2"))


_VEC = "vecs AS (SELECT a.dataset || '|' || b.dataset AS combo, a.date, a.i, a.j, a.u AS u1, a.v AS v1, b.u AS u2, b.v AS v2 FROM vec_ev a JOIN vec_ev b ON a.date = b.date AND a.i = b.i AND a.j = b.j AND a.dataset < b.dataset)"
_N = "greatest(sqrt(u{k} * u{k} + v{k} * v{k}), 0.1)"


def m11_angle_error(spark, sf_dir):
    cols = [F.col(c) for c in ("u1", "v1", "u2", "v2")]
    return _vectors(spark, sf_dir).select("combo", "date", "i", "j", V.rounded(M.angle_error(*cols), 6).alias("value"))


def m12_angle(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    return V.vec_ev(spark, sf_dir).select("dataset", "date", "i", "j", r9(M.vector_angle(u, v), "angle"), r9(M.vector_angle(u, v, normalize=True), "wrapped"))


def m13_norm(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    return V.vec_ev(spark, sf_dir).select("dataset", "date", "i", "j", r9(M.vector_norm(u, v), "norm"), r9(M.vector_norm(u, v, float("inf")), "largest"), r9(M.vector_norm(u, v, 1.0), "total"))


QUERIES |= {"m11_angle_error": m11_angle_error, "m12_angle": m12_angle, "m13_norm": m13_norm}
_COS = f"u1 / {_N.format(k=1)} * (u2 / {_N.format(k=2)}) + v1 / {_N.format(k=1)} * (v2 / {_N.format(k=2)})"
SQLS["m11_angle_error"] = sql(f"SELECT combo, date, i, j, round(CASE WHEN NOT (sqrt(u1 * u1 + v1 * v1) < 0.1 AND sqrt(u2 * u2 + v2 * v2) < 0.1) AND abs({_COS}) <= 1 THEN degrees(acos({_COS})) END, 6) AS value FROM vecs", V.VEC_EV, _VEC)
SQLS["m12_angle"] = sql("SELECT dataset, date, i, j, round(a, 9) AS angle, round(a - floor(a / 360.0) * 360.0, 9) AS wrapped FROM (SELECT *, CASE WHEN sqrt(u * u + v * v) >= 0.1 THEN degrees(atan2(v, u)) END AS a FROM vec_ev)", V.VEC_EV)
SQLS["m13_norm"] = sql("SELECT dataset, date, i, j, round(sqrt(u * u + v * v), 9) AS norm, round(greatest(abs(u), abs(v)), 9) AS largest, round(abs(u) + abs(v), 9) AS total FROM vec_ev", V.VEC_EV)


def _mae(spark, sf_dir):
    return M.applied(X.combos(V.field_ev(spark, sf_dir)), M.MAE)


_MAE = "metric AS (SELECT 'mae' AS metric, combo, date, channel, i, j, abs(v1 - v2) AS value FROM pairs)"
_EV = (V.FIELD_EV, V.PAIRS, _MAE)


def _aggregated(key: str, query, select: str, *more: str) -> None:
    QUERIES[key] = lambda spark, sf_dir: _rounded(query(spark, sf_dir))
    SQLS[key] = sql(select, *_EV, *more)


def _rounded(df):
    return df.withColumn("value", V.rounded("value", 9))


_aggregated("a01_global_mae", lambda s, d: A.global_temporal(_mae(s, d)), "SELECT metric, combo, date, channel, round(avg(value), 9) AS value FROM metric GROUP BY ALL")
_aggregated("a02_integrated", lambda s, d: A.global_integrated(_mae(s, d), V.areas(s, d)), "SELECT metric, combo, date, channel, round(coalesce(sum(value * area), 0), 9) AS value FROM metric JOIN areas USING (i, j) GROUP BY ALL", V.AREAS)
_REGIONAL = "SELECT s.metric, s.combo, s.region_id, s.date, s.channel, {value} AS value FROM (SELECT * FROM (SELECT DISTINCT metric, combo, date, channel FROM metric) CROSS JOIN (SELECT DISTINCT region_id FROM regions WHERE region_id <> 0)) s LEFT JOIN (SELECT metric, combo, region_id, date, channel, sum(value{times}) AS s, count(value) AS c FROM metric JOIN regions USING (i, j) {join} GROUP BY ALL) p USING (metric, combo, region_id, date, channel)"
_aggregated("a03_regional", lambda s, d: A.regional_temporal(_mae(s, d), V.regions(s, d)), _REGIONAL.format(value="CASE WHEN c > 0 THEN round(s / c, 9) END", times="", join="").replace("SELECT s.metric", "SELECT s.metric").replace("THEN round(s / c", "THEN round(p.s / p.c"), V.REGIONS)
_aggregated("a04_regional_integrated", lambda s, d: A.regional_temporal(_mae(s, d), V.regions(s, d), integrated=True, area=V.areas(s, d)), _REGIONAL.format(value="round(coalesce(p.s, 0), 9)", times=" * area", join="JOIN areas USING (i, j)"), V.REGIONS, V.AREAS)
_aggregated("a05_spatial", lambda s, d: A.spatial(_mae(s, d)), "SELECT metric, combo, channel, i, j, round(avg(value), 9) AS value FROM metric GROUP BY ALL")
_aggregated("a06_average", lambda s, d: A.average(_mae(s, d)), "SELECT metric, combo, round(avg(value), 9) AS value FROM metric GROUP BY ALL")
_aggregated("a09_raw", lambda s, d: A.raw(_mae(s, d)), "SELECT metric, combo, date, channel, i, j, round(value, 9) AS value FROM metric")


def a07_season(spark, sf_dir):
    rows = M.applied(X.combos(V.field_li(spark, sf_dir), 1), M.IDENTITY)
    seasons = A.SEASONS | {"first_half": range(1, 7)}
    return _rounded(A.seasonal_spatial(rows, seasons)).select("metric", "combo", "season", "channel", "i", "j", "value")


QUERIES["a07_season"] = a07_season
_SEASONS = ", ".join(f"('{s}', {m})" for s, ms in (A.SEASONS | {"first_half": range(1, 7)}).items() for m in ms)
SQLS["a07_season"] = sql(
    f"SELECT 'identity' AS metric, combo, season, channel, i, j, round(avg(value), 9) AS value FROM (SELECT a.dataset AS combo, c.date, c.channel, c.i, c.j, x.value FROM av a JOIN cells c USING (date) LEFT JOIN field_li x ON x.dataset = a.dataset AND x.date = c.date AND x.i = c.i AND x.j = c.j) JOIN (VALUES {_SEASONS}) s(season, m) ON month(date) = m GROUP BY ALL",
    V.FIELD_LI, "av AS (SELECT DISTINCT dataset, date FROM field_li), cells AS (SELECT DISTINCT date, channel, i, j FROM field_li)",
)
