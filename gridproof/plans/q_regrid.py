"""Queries: regridding between grids whose lines are curves on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridproof.functions.projection import EARTH_KM, from_polar
from gridproof.operators import covers
from gridproof.operators import curvilinear as U
from gridproof.operators import grid as G

from . import views as V
from .views import sql

STEP, TURN = 150_000.0, math.radians(30)
COARSE, COARSE_TURN = 560_000.0, math.radians(-12)
POINTS = 4


def _place(i: str, j: str, middle: float, step: float, turn: float):
    """x, y of the cell (i, j) of a turned square lattice about the pole."""
    px, py = (F.col(j) - middle) * step, (F.col(i) - middle) * step
    return px * math.cos(turn) - py * math.sin(turn), px * math.sin(turn) + py * math.cos(turn)


def fine_grid(spark, sf_dir):
    """The cells of field_li laid over the pole."""
    lat, lon = from_polar(*_place("i", "j", 9.5, STEP, TURN))
    return V.field_li(spark, sf_dir).select("i", "j").distinct().select("i", "j", lat.alias("lat"), lon.alias("lon"))


def coarse_grid(spark, sf_dir):
    """One cell for four by four of them, turned otherwise and larger than what they cover."""
    lat, lon = from_polar(*_place("i", "j", 2.0, COARSE, COARSE_TURN))
    return V.field_li(spark, sf_dir).select(F.floor(F.col("i") / 4).cast("int").alias("i"), F.floor(F.col("j") / 4).cast("int").alias("j")).distinct().select("i", "j", lat.alias("lat"), lon.alias("lon"))


def _rounded(df):
    return df.withColumn("value", F.round("value", 7))


def g05_curvilinear(spark, sf_dir):
    """Onto the suppliers' places, by bilinear weights on the sphere; those outside are missing."""
    field, dst = V.field_li(spark, sf_dir), V.grid_pt(spark, sf_dir).select(F.col("k").alias("i"), F.lit(0).alias("j"), "lat", "lon")
    w = U.bilinear_between(fine_grid(spark, sf_dir), dst)
    return _rounded(U.everywhere(G.regridded(field, w), field, dst))


def g06_turned(spark, sf_dir):
    """Onto a coarser grid that isn't parallel; the method follows from the cells' areas."""
    w = U.weights_between(fine_grid(spark, sf_dir), coarse_grid(spark, sf_dir), POINTS)
    return _rounded(G.regridded(V.field_li(spark, sf_dir), w))


def g06_integral(spark, sf_dir):
    """Per date and dataset the integral over the source cells, and over what of the coarse cells they cover; a missing value counts as 0."""
    fine, w = fine_grid(spark, sf_dir), U.conservative_between(fine_grid(spark, sf_dir), coarse_grid(spark, sf_dir), POINTS)
    w = w.select("src_i", "src_j", "dst_i", "dst_j", "w", "area").cache()
    field = U.everywhere(V.field_li(spark, sf_dir), V.field_li(spark, sf_dir), fine).fillna(0.0, ["value"])

    def total(f, i, j, name):
        area = w.groupBy(F.col(i).alias("i"), F.col(j).alias("j")).agg(F.sum("area").alias("area"))
        return f.join(area, ["i", "j"]).groupBy("dataset", "date").agg(F.round(F.sum(F.col("value") * F.col("area")), 2).alias(name))

    return total(G.regridded(field, w.drop("area")), "dst_i", "dst_j", "coarse").join(total(field, "src_i", "src_j", "fine"), ["dataset", "date"])


def coasts(spark, sf_dir):
    """A star-shaped ring for each nation, with a corner for each of its suppliers: poly_id, x1, y1, x2, y2."""
    of = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = V.table(spark, sf_dir, "supplier").withColumns({"k": F.row_number().over(of) - 1, "n": F.count("*").over(Window.partitionBy("s_nationkey"))})
    turn, radius = F.col("k") * (2 * math.pi) / F.col("n"), F.lit(2.0) + F.col("s_suppkey") * 37 % 100 / 25.0
    corners = s.select("s_nationkey", "k", "n", (F.col("s_nationkey") % 5 * 5.0 + 65 + radius * F.cos(turn)).alias("x1"), (F.floor(F.col("s_nationkey") / 5) * 60.0 - 120 + radius * 9 * F.sin(turn)).alias("y1"))
    again = corners.select("s_nationkey", F.pmod(F.col("k") - 1, F.col("n")).alias("k"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return corners.join(again, ["s_nationkey", "k"]).select(F.col("s_nationkey").alias("poly_id"), "x1", "y1", "x2", "y2")


def _points(spark, sf_dir):
    return V.part_pt(spark, sf_dir).select(F.col("q").alias("point"), F.col("lat").alias("x"), F.col("lon").alias("y"))


def g10_cover(spark, sf_dir):
    return covers.inside(_points(spark, sf_dir), coasts(spark, sf_dir))


def x15_cover(spark, sf_dir):
    """The parts by the last nation's ring that holds them; rings of under three corners are none and use no label."""
    edges = coasts(spark, sf_dir)
    sizes = edges.groupBy("poly_id").agg(F.count("*").alias("n_edges"))
    n = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly_id"), F.col("n_name").alias("poly_order"), F.lit(None).cast("int").alias("label")).join(sizes.where("n_edges > 2"), "poly_id")
    return G.labelled(_points(spark, sf_dir), edges, G.numbered(n))


QUERIES = {"g10_cover": g10_cover, "x15_cover": x15_cover, "g05_curvilinear": g05_curvilinear, "g06_turned": g06_turned, "g06_integral": g06_integral}

_vec = lambda n: [f"{n}{a}" for a in "xyz"]
_dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
_det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) + {a[1]} * ({b[2]} * {c[0]} - {b[0]} * {c[2]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


def _sphere(lat: str, lon: str, name: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lon})) AS {name}x, cos(radians({lat})) * sin(radians({lon})) AS {name}y, sin(radians({lat})) AS {name}z"


def _located(points: str, quads: str, name: str) -> list[str]:
    """Views up to ``name``: rows of ``points`` (pid, px, py, pz) with qi, qj, s, t of the first quadrilateral that holds them, all against all."""
    p, a, b, c, d = map(_vec, ("p", "k0", "vb", "vc", "vd"))
    sides = ", ".join([*(f"k1{x} - k0{x} AS vb{x}" for x in "xyz"), *(f"k3{x} - k0{x} AS vc{x}" for x in "xyz"), *(f"k0{x} - k1{x} - k3{x} + k2{x} AS vd{x}" for x in "xyz")])
    along = lambda x, y: f"({_dot(x, y)} - {_dot(x, p)} * {_dot(y, p)})"
    s = lambda t: f"-{along([f'({x} + {t} * {y})' for x, y in zip(a, c, strict=True)], v := [f'({x} + {t} * {y})' for x, y in zip(b, d, strict=True)])} / nullif({along(v, v)}, 0)"
    ok = lambda k: f"(s{k} BETWEEN -1e-9 AND 1 + 1e-9 AND t{k} BETWEEN -1e-9 AND 1 + 1e-9)"
    clip = lambda x: f"least(greatest(CASE WHEN {ok(0)} THEN {x}0 ELSE {x}1 END, 0), 1) AS {x}"
    return [
        f"{name}_m AS (SELECT p.*, q.*, {sides} FROM {points} p JOIN {quads} q ON {_dot(p, a)} > 0)",
        f"{name}_e AS (SELECT *, {_det(p, a, b)} AS e0, {_det(p, a, d)} + {_det(p, c, b)} AS e1, {_det(p, c, d)} AS e2 FROM {name}_m)",
        f"{name}_r AS (SELECT *, e1 + CASE WHEN e1 < 0 THEN -1 ELSE 1 END * sqrt(greatest(e1 * e1 - e2 * e0 * 4, 0)) AS root FROM {name}_e)",
        f"{name}_t AS (SELECT *, -2 * e0 / nullif(root, 0) AS t0, -root / nullif(2 * e2, 0) AS t1 FROM {name}_r)",
        f"{name}_s AS (SELECT *, {s('t0')} AS s0, {s('t1')} AS s1 FROM {name}_t)",
        f"{name} AS MATERIALIZED (SELECT pid, qi, qj, {clip('s')}, {clip('t')} FROM {name}_s WHERE {ok(0)} OR {ok(1)} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY qi, qj) = 1)",
    ]


def _xy(middle: float, step: float, turn: float) -> tuple[str, str]:
    px, py = f"((j - {middle}::DOUBLE) * {step}::DOUBLE)", f"((i - {middle}::DOUBLE) * {step}::DOUBLE)"
    c, s = math.cos(turn), math.sin(turn)
    return f"({px} * {c!r}::DOUBLE - {py} * {s!r}::DOUBLE)", f"({px} * {s!r}::DOUBLE + {py} * {c!r}::DOUBLE)"


_FX, _FY = _xy(9.5, STEP, TURN)
_CX, _CY = _xy(2.0, COARSE, COARSE_TURN)
_LAT, _LON = V.from_polar_sql("x", "y")
_FINE = ["fine_xy AS (SELECT i, j, " + f"{_FX} AS x, {_FY} AS y FROM (SELECT DISTINCT i, j FROM field_li))", f"fine AS (SELECT i, j, {_LAT} AS lat, {_LON} AS lon FROM fine_xy)"]
_WEIGHTS = "(VALUES (0, 0), (0, 1), (1, 1), (1, 0)) o(a, b)"
_SHARE = "(CASE a WHEN 1 THEN t ELSE 1 - t END) * (CASE b WHEN 1 THEN s ELSE 1 - s END)"
SQLS = {
    "g05_curvilinear": sql(
        "SELECT t.dataset, t.date, t.channel, k AS i, 0 AS j, CASE WHEN c = n THEN round(total, 7) END AS value FROM (SELECT DISTINCT dataset, date, channel FROM field_li) t CROSS JOIN grid_pt LEFT JOIN got ON got.dataset = t.dataset AND got.date = t.date AND got.channel = t.channel AND pid = k",
        V.FIELD_LI, V.GRID_PT, *_FINE, f"pt AS (SELECT k AS pid, {_sphere('lat', 'lon', 'p')} FROM grid_pt)", f"sph AS (SELECT i, j, {_sphere('lat', 'lon', 'k')} FROM fine)",
        "quad AS MATERIALIZED (SELECT a.i AS qi, a.j AS qj, " + ", ".join(f"{n}.k{x} AS k{k}{x}" for k, n in enumerate("abcd") for x in "xyz") + " FROM sph a JOIN sph b ON b.i = a.i AND b.j = a.j + 1 JOIN sph c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN sph d ON d.i = a.i + 1 AND d.j = a.j)",
        *_located("pt", "quad", "loc"), f"wt AS (SELECT pid, qi + a AS i, qj + b AS j, {_SHARE} AS w FROM loc, {_WEIGHTS} WHERE {_SHARE} > 0)", "need AS (SELECT pid, count(*) AS n FROM wt GROUP BY pid)",
        "got AS (SELECT dataset, date, channel, pid, sum(value * w) AS total, count(value) AS c, any_value(n) AS n FROM wt JOIN field_li USING (i, j) JOIN need USING (pid) GROUP BY dataset, date, channel, pid)",
    )
}


def _cells(prefix: str, centre: str) -> list[str]:
    """Views up to ``{prefix}cell``: qi, qj, corners and area of the cells about the centres."""
    corner = f"(SELECT i, j, k, {_sphere('lat', 'lon', 'k')} FROM (SELECT i, j, k, {_LAT} AS lat, {_LON} AS lon FROM {prefix}corner))"
    at = ", ".join(f"max(k{x}) FILTER (k = {k}) AS k{k}{x}" for k in range(4) for x in "xyz")
    v = [_vec(f"k{k}") for k in range(4)]
    part = lambda a, b, c: f"2 * atan2(abs({_det(v[a], v[b], v[c])}), 1 + {_dot(v[a], v[b])} + {_dot(v[b], v[c])} + {_dot(v[a], v[c])})"
    return [*V.corner_views(centre, prefix), f"{prefix}quad AS (SELECT i AS qi, j AS qj, {at} FROM {corner} GROUP BY i, j)", f"{prefix}cell AS MATERIALIZED (SELECT *, ({part(0, 1, 2)} + {part(0, 2, 3)}) * {EARTH_KM**2}::DOUBLE AS area FROM {prefix}quad)"]


# the corners are made of projected centres, as latitude and longitude turn back into the plane's places
_BACK = lambda x, y: V.to_polar_sql(*V.from_polar_sql(x, y))
_TO = lambda source: f"SELECT i, j, {V.to_polar_sql('lat', 'lon')[0]} AS x, {V.to_polar_sql('lat', 'lon')[1]} AS y FROM {source}"
_COARSE = [f"coarse_xy AS (SELECT i, j, {_CX} AS x, {_CY} AS y FROM (SELECT DISTINCT i // 4 AS i, j // 4 AS j FROM field_li))", f"coarse AS (SELECT i, j, {_LAT} AS lat, {_LON} AS lon FROM coarse_xy)"]
_S, _T = f"((b + 0.5::DOUBLE) / {POINTS})", f"((a + 0.5::DOUBLE) / {POINTS})"
_MID = ", ".join(f"(1 - {_S}) * (1 - {_T}) * k0{x} + {_S} * (1 - {_T}) * k1{x} + {_S} * {_T} * k2{x} + (1 - {_S}) * {_T} * k3{x} AS m{x}" for x in "xyz")
_SHARES = [
    V.FIELD_LI, *_FINE, *_COARSE, *_cells("f_", _TO("fine")), *_cells("c_", _TO("coarse")),
    f"mid AS (SELECT qi AS fi, qj AS fj, a, b, area / {POINTS**2} AS part, {_MID} FROM f_cell, (SELECT unnest(range({POINTS})) AS a), (SELECT unnest(range({POINTS})) AS b))",
    "pt AS MATERIALIZED (SELECT row_number() OVER () AS pid, fi, fj, part, " + ", ".join(f"m{x} / sqrt(mx * mx + my * my + mz * mz) AS p{x}" for x in "xyz") + " FROM mid)",
    *_located("(SELECT pid, px, py, pz FROM pt)", "(SELECT * EXCLUDE (area) FROM c_cell)", "loc"),
    "share AS MATERIALIZED (SELECT fi, fj, qi, qj, sum(part) AS area FROM loc JOIN pt USING (pid) GROUP BY ALL)", "wt AS (SELECT *, area / sum(area) OVER (PARTITION BY qi, qj) AS w, count(*) OVER (PARTITION BY qi, qj) AS n FROM share)",
]
SQLS["g06_turned"] = sql("SELECT dataset, date, channel, qi::INT AS i, qj::INT AS j, CASE WHEN count(value) = any_value(n) THEN round(sum(value * w), 7) END AS value FROM wt JOIN field_li ON i = fi AND j = fj GROUP BY dataset, date, channel, qi, qj", *_SHARES)
SQLS["g06_integral"] = sql(
    "SELECT dataset, date, round(total, 2) AS coarse, round(total, 2) AS fine FROM (SELECT dataset, date, sum(value * area) AS total FROM share JOIN field_li ON i = fi AND j = fj GROUP BY dataset, date)",
    *_SHARES,
)

_COASTS = [
    "sup AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_nationkey) AS n, 2.0::DOUBLE + (s_suppkey * 37 % 100) / 25.0::DOUBLE AS r FROM supplier)",
    "corner AS (SELECT s_nationkey, k, n, s_nationkey % 5 * 5.0::DOUBLE + 65 + r * cos(k * (2 * pi()) / n) AS x, floor(s_nationkey / 5) * 60.0::DOUBLE - 120 + r * 9 * sin(k * (2 * pi()) / n) AS y FROM sup)",
    "edge AS MATERIALIZED (SELECT a.s_nationkey AS poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON a.s_nationkey = b.s_nationkey AND b.k = (a.k + 1) % a.n)",
    "inside AS (SELECT q AS point, poly_id FROM part_pt JOIN edge ON lon >= least(y1, y2) AND lon < greatest(y1, y2) AND lat < x1 + (lon - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1)",
]
SQLS["g10_cover"] = sql("SELECT point, poly_id FROM inside", V.PART_PT, *_COASTS)
SQLS["x15_cover"] = sql(
    "SELECT q AS point, coalesce(max(label), 0)::INT AS label FROM part_pt LEFT JOIN (SELECT point, label FROM inside JOIN ranked USING (poly_id)) i ON i.point = q GROUP BY q",
    V.PART_PT, *_COASTS, "ranked AS (SELECT n_nationkey AS poly_id, row_number() OVER (ORDER BY n_name, n_nationkey) AS label FROM nation WHERE n_nationkey IN (SELECT poly_id FROM edge GROUP BY poly_id HAVING count(*) > 2))",
)
