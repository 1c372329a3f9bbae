"""Queries: runs of vector and window metrics, and of aggregators with states of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridproof.operators import aggregators as A
from gridproof.operators import align as X
from gridproof.operators import metrics as M

from . import validate as R
from . import views as V
from .q_metrics import _EV
from .views import sql

WINDOW, SIGMAS, LEAST = 5, 2.0, 5.0
METRICS = [M.MAE, M.of_angle_error(), M.sequential(M.componentwise(M.DIFFERENCE), M.of_norm()), M.of_local_std(WINDOW, SIGMAS, masked=True), (_HIT := M.of_drift_success(WINDOW, SIGMAS, least=LEAST)), M.efficiency(_HIT)]
ALL = [R.TEMPORAL, R.AVERAGE]


def vector_field(spark, sf_dir):
    """vec_ev as a field: u is channel 0 and v channel 1."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.col(c).alias("value")) for k, c in enumerate("uv")]))
    return V.vec_ev(spark, sf_dir).select("dataset", "date", "i", "j", one.alias("x")).select("dataset", "date", "x.channel", "i", "j", "x.value")


def _names(spark, sf_dir):
    return X.names(V.table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset")))


def _rounded(df):
    """Metrics of differences of squares to six digits, the plain one to ten."""
    return df.select("aggregator", "metric", "combo", "date", "channel", F.when(F.col("metric") == "mae", V.rounded("value", 10)).otherwise(V.rounded("value", 6)).alias("value"))


def v02_vectors(spark, sf_dir):
    return _rounded(R.run(vector_field(spark, sf_dir), METRICS, ALL, _names(spark, sf_dir)))


def _in_thirds(spark, field, metrics, aggregations, statistics=()):
    """The summary of a store that is filled in three steps, opened anew for each."""
    folder, day = R.shared_folder(spark), F.dayofmonth("date") % 3
    for k in range(3):
        R.Store(spark, folder, statistics).add(field.where(day == k), metrics, aggregations)
    return R.Store(spark, folder, statistics).summary()


def v03_vectors(spark, sf_dir):
    return _rounded(_in_thirds(spark, vector_field(spark, sf_dir), METRICS, ALL))


#: Beyond the built-in ones: the share of values of at least fifty.
OVER = A.Statistic("over_fifty", "cnt:bigint,hit:bigint", lambda v: {"cnt": F.count(v), "hit": F.count(F.when(v >= 50, v))}, lambda a, b: {c: a[c] + b[c] for c in ("cnt", "hit")}, lambda s: F.when(s["cnt"] > 0, s["hit"] / s["cnt"]))
STATISTICS = [R.Aggregation(f"{s.name}_{n}", keys, s) for s in (A.LEAST, A.MOST, A.DEVIATION, A.MEDIAN, A.TOTAL, OVER) for n, keys in (("by_cell", ("channel", "i", "j")), ("of_all", ()))]


def a10_statistics(spark, sf_dir):
    found = _in_thirds(spark, V.field_ev(spark, sf_dir), [M.MAE], STATISTICS, [OVER])
    return found.select("aggregator", "metric", "combo", "channel", "i", "j", V.rounded("value", 6).alias("value"))


QUERIES = {"v02_vectors": v02_vectors, "v03_vectors": v03_vectors, "a10_statistics": a10_statistics}

_HALF, _W = WINDOW // 2, f"exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2) / {2 * ((WINDOW - 1) / (2 * SIGMAS)) ** 2}::DOUBLE)"


def _moments(name: str, source: str, keys: str) -> str:
    """A view with the local variance of ``x`` about each row of ``source`` (keys, i, j, x)."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    m = lambda x: f"sum({x} * {_W}) FILTER (b.x IS NOT NULL) / sum({_W}) FILTER (b.x IS NOT NULL)"
    return f"{name} AS MATERIALIZED (SELECT {keys}, i, j, sqrt(greatest(m2 - m1 * m1, 0) + 1e-8) AS std FROM (SELECT {own}, a.i, a.j, {m('b.x')} AS m1, {m('b.x * b.x')} AS m2 FROM {source} a JOIN {source} b ON {same} AND abs(a.i - b.i) <= {_HALF} AND abs(a.j - b.j) <= {_HALF} GROUP BY {own}, a.i, a.j))"


def _combos(n: int) -> str:
    """All combinations of n datasets, with u and v of each at all cells of the date."""
    at = range(1, n + 1)
    values = ", ".join(f"x{k}.u AS u{k}, x{k}.v AS v{k}" for k in at)
    order = " ".join(f"JOIN av a{k} ON a{k}.date = a1.date AND a{k - 1}.dataset < a{k}.dataset" for k in range(2, n + 1))
    found = " ".join(f"LEFT JOIN vec x{k} ON x{k}.dataset = a{k}.dataset AND x{k}.date = c.date AND x{k}.i = c.i AND x{k}.j = c.j" for k in at)
    return f"SELECT {' || chr(124) || '.join(f'a{k}.dataset' for k in at)} AS combo, a{n}.dataset AS last, a{max(1, n - 1)}.dataset AS middle, c.date, c.i, c.j, {values} FROM av a1 {order} JOIN cells c ON c.date = a1.date {found}"


_ONE = lambda metric, source, value, channel="NULL": f"SELECT '{metric}' AS metric, combo, date, {channel}::INT AS channel, {value} AS value FROM {source}"
_N = "greatest(sqrt(u{k} * u{k} + v{k} * v{k}), 0.1)"
_COS = f"(u1 / {_N.format(k=1)} * (u2 / {_N.format(k=2)}) + v1 / {_N.format(k=1)} * (v2 / {_N.format(k=2)}))"
_ANGLE = f"CASE WHEN NOT (sqrt(u1 * u1 + v1 * v1) < 0.1 AND sqrt(u2 * u2 + v2 * v2) < 0.1) AND abs({_COS}) <= 1 THEN degrees(acos({_COS})) END"
_OK = "(u1 + v1 + u2 + v2 + u3 + v3) IS NOT NULL"
_NEAR = "sqrt((u{k} - u2) ** 2 + (v{k} - v2) ** 2) <= greatest(0.674::DOUBLE * sqrt(su * su + sv * sv), {least}::DOUBLE)"
_RATE = f"CASE WHEN {_OK} THEN ({_NEAR.format(k='{k}', least=LEAST)})::INT::DOUBLE END"
SQLS = {}
SQLS["v02_vectors"] = SQLS["v03_vectors"] = sql(
    "SELECT aggregator, metric, combo, date, channel, CASE metric WHEN 'mae' THEN round(value, 10) ELSE round(value, 6) END AS value FROM (SELECT 'temporal' AS aggregator, metric, combo, date, channel, avg(value) AS value FROM every GROUP BY ALL UNION ALL SELECT 'average', metric, combo, NULL, NULL, avg(value) FROM every GROUP BY metric, combo)",
    V.VEC_EV, "vec AS MATERIALIZED (SELECT * FROM vec_ev)", "av AS (SELECT DISTINCT dataset, date FROM vec)", "cells AS (SELECT DISTINCT date, i, j FROM vec)",
    f"one AS (SELECT *, last AS of FROM ({_combos(1)}))", f"two AS MATERIALIZED ({_combos(2)})", f"three AS MATERIALIZED ({_combos(3)})",
    "own AS (SELECT dataset AS of, date, 0 AS channel, i, j, u AS x FROM vec UNION ALL SELECT dataset, date, 1, i, j, v FROM vec)", _moments("own_std", "own", "of, date, channel"),
    "spread AS (SELECT combo, date, channel, CASE WHEN x IS NOT NULL THEN std END AS value FROM (SELECT of, combo, date, i, j, channel, CASE channel WHEN 0 THEN u1 ELSE v1 END AS x FROM one, (VALUES (0), (1)) c(channel)) LEFT JOIN own_std USING (of, date, channel, i, j))",
    "change AS (SELECT combo AS of, date, 0 AS channel, i, j, u1 - u2 AS x FROM two UNION ALL SELECT combo, date, 1, i, j, v1 - v2 FROM two)", _moments("change_std", "change", "of, date, channel"),
    "drift AS (SELECT t.*, a.std AS su, b.std AS sv FROM three t LEFT JOIN change_std a ON a.of = middle || '|' || last AND a.date = t.date AND a.i = t.i AND a.j = t.j AND a.channel = 0 LEFT JOIN change_std b ON b.of = middle || '|' || last AND b.date = t.date AND b.i = t.i AND b.j = t.j AND b.channel = 1)",
    "every AS (" + " UNION ALL ".join([
        _ONE("mae", "two", "abs(u1 - u2)", "0"), _ONE("mae", "two", "abs(v1 - v2)", "1"), _ONE("angle_error", "two", _ANGLE), _ONE("difference→norm", "two", "sqrt((u1 - u2) ** 2 + (v1 - v2) ** 2)"),
        _ONE("local_spatial_std", "spread", "value", "channel"),
        _ONE("drift_success", "drift", _RATE.format(k=1)), _ONE("drift_efficiency", "drift", f"{_RATE.format(k=1)} - {_RATE.format(k=3)}"),
    ]) + ")",
)

_STEP = "pow(2.0::DOUBLE, floor(log2(abs(value))) - 7)"
_CUT = f"CASE WHEN value = 0 THEN 0 ELSE sign(value) * floor(abs(value) / {_STEP}) * {_STEP} END"
_RESULTS = {"least": "min(value)", "most": "max(value)", "deviation": "stddev_pop(value)", A.MEDIAN.name: f"quantile_disc({_CUT}, 0.5)", "total": "coalesce(sum(value), 0)", "over_fifty": "count(*) FILTER (value >= 50) / nullif(count(value), 0)"}
SQLS["a10_statistics"] = sql(
    "SELECT aggregator, 'mae' AS metric, combo, channel, i, j, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT '{n}_{k}' AS aggregator, combo, {cols}, ({f})::DOUBLE AS value FROM metric GROUP BY combo{by}" for n, f in _RESULTS.items() for k, cols, by in (("by_cell", "channel, i, j", ", channel, i, j"), ("of_all", "NULL::INT AS channel, NULL::INT AS i, NULL::INT AS j", ""))) + ")",
    *_EV,
)
