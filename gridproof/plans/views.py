"""Views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.functions import projection as J


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int) -> Column:
    """A double rounded as SQL does it: the product with a power of ten to a whole number, halves away from zero.

    Spark's own round does so by the shortest decimal form, whose last digit is another one for some values from about a thousand on."""
    v, size = F.col(c) if isinstance(c, str) else c, 10.0**digits
    near = F.round(v * size) / size
    return F.when(F.abs(near) < float("inf"), near).otherwise(v)


def r9(c: Column | str, name: str) -> Column:
    """Rounded as both engines are compared."""
    return rounded(c, 9).alias(name)


def _cells(df: DataFrame, *keys: Column, **values: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in values.items()])


def _event_keys() -> list[Column]:
    return [F.col("event_type").alias("dataset"), F.to_date("ts").alias("date"), F.floor(F.col("user_id") / 10).cast("int").alias("i"), (F.col("user_id") % 10).cast("int").alias("j")]


def field_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cells(table(spark, sf_dir, "events"), *_event_keys(), value=F.avg("value"))
    return df.select("dataset", "date", F.lit(0).alias("channel"), "i", "j", "value")


FIELD_EV = "field_ev AS (SELECT event_type AS dataset, CAST(ts AS DATE) AS date, 0 AS channel, (user_id // 10)::INT AS i, (user_id % 10)::INT AS j, avg(value) AS value FROM events GROUP BY ALL)"


def vec_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, date, i, j, u, v"""
    k = F.get_json_object("props", "$.k").cast("double")
    return _cells(table(spark, sf_dir, "events"), *_event_keys(), u=F.avg("value") - 100, v=F.avg(k) - 50)


VEC_EV = "vec_ev AS (SELECT event_type AS dataset, CAST(ts AS DATE) AS date, (user_id // 10)::INT AS i, (user_id % 10)::INT AS j, avg(value) - 100 AS u, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) - 50 AS v FROM events GROUP BY ALL)"


def field_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("l_returnflag").alias("dataset"), F.trunc(F.to_date("l_shipdate"), "month").alias("date"), (F.col("l_suppkey") % 20).cast("int").alias("i"), (F.col("l_partkey") % 20).cast("int").alias("j")]
    df = _cells(table(spark, sf_dir, "lineitem"), *keys, value=F.avg("l_quantity"))
    return df.select("dataset", "date", F.lit(0).alias("channel"), "i", "j", "value")


FIELD_LI = "field_li AS (SELECT l_returnflag AS dataset, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, 0 AS channel, (l_suppkey % 20)::INT AS i, (l_partkey % 20)::INT AS j, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def series_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, combo, date, channel, value"""
    df = _cells(table(spark, sf_dir, "lineitem"), F.col("l_returnflag").alias("combo"), F.to_date("l_shipdate").alias("date"), value=F.avg("l_quantity"))
    return df.select(F.lit("identity").alias("metric"), "combo", "date", F.lit(0).alias("channel"), "value")


SERIES_LI = "series_li AS (SELECT l_returnflag AS combo, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def grid_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, lat, lon"""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), (F.lit(60.0) + (k * 37 % 3000) / 100.0).alias("lat"), ((k * 91 % 36000) / 100.0 - 180.0).alias("lon"))


GRID_PT = "grid_pt AS (SELECT s_suppkey AS k, 60.0::DOUBLE + (s_suppkey * 37 % 3000) / 100.0::DOUBLE AS lat, (s_suppkey * 91 % 36000) / 100.0::DOUBLE - 180.0::DOUBLE AS lon FROM supplier)"


def part_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("q"), (F.lit(60.0) + (k * 53 % 2900) / 100.0).alias("lat"), ((k * 77 % 36000) / 100.0 - 180.0).alias("lon"))


PART_PT = "part_pt AS (SELECT p_partkey AS q, 60.0::DOUBLE + (p_partkey * 53 % 2900) / 100.0::DOUBLE AS lat, (p_partkey * 77 % 36000) / 100.0::DOUBLE - 180.0::DOUBLE AS lon FROM part)"


def track_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """buoy_id, ts, lat, lon, value, event_id"""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("buoy_id"), "ts", (F.lit(70.0) + (e * 13 % 1000) / 100.0).alias("lat"), ((e * 29 % 3600) / 10.0 - 180.0).alias("lon"), "value", "event_id")


TRACK_EV = "track_ev AS (SELECT user_id AS buoy_id, ts, 70.0::DOUBLE + (event_id * 13 % 1000) / 100.0::DOUBLE AS lat, (event_id * 29 % 3600) / 10.0::DOUBLE - 180.0::DOUBLE AS lon, value, event_id FROM events)"


def fc_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """init_time, lead_h, valid_time, value"""
    init, lead = F.date_trunc("DAY", "ts").cast("timestamp_ntz"), (F.col("event_id") % 72).cast("int")
    df = _cells(table(spark, sf_dir, "events"), init.alias("init_time"), lead.alias("lead_h"), value=F.avg("value"))
    return df.withColumn("valid_time", F.expr("init_time + make_dt_interval(0, lead_h, 0, 0)"))


FC_EV = "fc_ev AS (SELECT init_time, lead_h, init_time + to_hours(lead_h) AS valid_time, value FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS init_time, (event_id % 72)::INT AS lead_h, avg(value) AS value FROM events GROUP BY ALL))"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, region_id: cells of a 10-column grid dealt over nations; region keys count from 1, 0 for one of five."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c"), F.col("n_regionkey").alias("region_id"))
    users = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).cast("int").alias("i"), (F.col("user_id") % 10).cast("int").alias("j")).distinct()
    return users.withColumn("c", ((F.col("i") * 10 + F.col("j")) % 25).cast("int")).join(n, "c").select("i", "j", "region_id")


REGIONS = "regions AS (SELECT i, j, n_regionkey AS region_id FROM (SELECT DISTINCT (user_id // 10)::INT AS i, (user_id % 10)::INT AS j FROM events) u JOIN nation ON (i * 10 + j) % 25 = n_nationkey)"


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).cast("int").alias("i"), (F.col("user_id") % 10).cast("int").alias("j")).distinct()
    return users.withColumn("area", (F.col("i") + 1).cast("double") * (F.col("j") + 2))


AREAS = "areas AS (SELECT i, j, (i + 1)::DOUBLE * (j + 2) AS area FROM (SELECT DISTINCT (user_id // 10)::INT AS i, (user_id % 10)::INT AS j FROM events))"

#: Rows of combinations of field_ev, as combos() makes them.
PAIRS = """av AS (SELECT DISTINCT dataset, date FROM field_ev), cells AS (SELECT DISTINCT date, channel, i, j FROM field_ev),
pairs AS (SELECT a.dataset || '|' || b.dataset AS combo, c.date, c.channel, c.i, c.j, x.value AS v1, y.value AS v2
  FROM av a JOIN av b ON a.date = b.date AND a.dataset < b.dataset JOIN cells c ON c.date = a.date
  LEFT JOIN field_ev x ON x.dataset = a.dataset AND x.date = c.date AND x.i = c.i AND x.j = c.j
  LEFT JOIN field_ev y ON y.dataset = b.dataset AND y.date = c.date AND y.i = c.i AND y.j = c.j)"""
TRIPLES = """av AS (SELECT DISTINCT dataset, date FROM field_ev), cells AS (SELECT DISTINCT date, channel, i, j FROM field_ev),
triples AS (SELECT a.dataset || '|' || b.dataset || '|' || d.dataset AS combo, c.date, c.channel, c.i, c.j, x.value AS v1, y.value AS v2, z.value AS v3
  FROM av a JOIN av b ON a.date = b.date AND a.dataset < b.dataset JOIN av d ON d.date = a.date AND b.dataset < d.dataset JOIN cells c ON c.date = a.date
  LEFT JOIN field_ev x ON x.dataset = a.dataset AND x.date = c.date AND x.i = c.i AND x.j = c.j
  LEFT JOIN field_ev y ON y.dataset = b.dataset AND y.date = c.date AND y.i = c.i AND y.j = c.j
  LEFT JOIN field_ev z ON z.dataset = d.dataset AND z.date = c.date AND z.i = c.i AND z.j = c.j)"""


#: Steps of the geodesic's iteration in SQL; points that are not nearly opposite need fewer than ten.
_STEPS = 14


def geodesic_sql(source: str) -> list[str]:
    """Views up to ``geo``: the rows of ``source`` (lat1, lon1, lat2, lon2) with metres and azimuth on the ellipsoid."""
    f, a = J.FLATTENING, J.A
    b = a * (1 - f)
    views = [f"geo_0 AS (SELECT *, atan({1 - f}::DOUBLE * tan(radians(lat1))) AS u1, atan({1 - f}::DOUBLE * tan(radians(lat2))) AS u2, radians(lon2) - radians(lon1) AS span, radians(lon2) - radians(lon1) AS lam FROM {source})"]
    for k in range(_STEPS):
        views += [
            f"geo_{k}a AS (SELECT * REPLACE (lam AS lam), cos(u2) * sin(lam) AS gx, cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam) AS gy, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM geo_{k})",
            f"geo_{k}b AS (SELECT *, sqrt(gx * gx + gy * gy) AS ss, atan2(sqrt(gx * gx + gy * gy), cs) AS sigma FROM geo_{k}a)",
            f"geo_{k}c AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM geo_{k}b)",
            f"geo_{k}d AS (SELECT *, 1 - sa * sa AS c2, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS mid FROM geo_{k}c)",
            f"geo_{k}e AS (SELECT *, {f / 16}::DOUBLE * c2 * (4 + {f}::DOUBLE * (4 - 3 * c2)) AS c FROM geo_{k}d)",
        ]
        if k < _STEPS - 1:
            views.append(f"geo_{k + 1} AS (SELECT * EXCLUDE (gx, gy, cs, ss, sigma, sa, c2, mid, c) REPLACE (span + (1 - c) * {f}::DOUBLE * sa * (sigma + c * ss * (mid + c * cs * (2 * mid * mid - 1))) AS lam) FROM geo_{k}e)")
    k2 = f"(c2 * {(a * a - b * b) / (b * b)}::DOUBLE)"
    views.append(f"geo_f AS (SELECT *, 1 + {k2} / 16384 * (4096 + {k2} * (-768 + {k2} * (320 - 175 * {k2}))) AS big, {k2} / 1024 * (256 + {k2} * (-128 + {k2} * (74 - 47 * {k2}))) AS small FROM geo_{_STEPS - 1}e)")
    views.append(f"geo AS (SELECT *, degrees(atan2(gx, gy)) AS azimuth, {b}::DOUBLE * big * (sigma - small * ss * (mid + small / 4 * (cs * (2 * mid * mid - 1) - small / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))) AS metres FROM geo_f)")
    return views


def to_polar_sql(lat: str, lon: str) -> tuple[str, str]:
    e = f"{J.ECC}::DOUBLE"
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {e} * sin(radians({lat}))) / (1 + {e} * sin(radians({lat}))), {J.ECC / 2}::DOUBLE))"
    turn = f"radians({lon} - {J.CENTRE_LON}::DOUBLE)"
    return f"{J.SCALE}::DOUBLE * {t} * sin({turn})", f"-{J.SCALE}::DOUBLE * {t} * cos({turn})"


def from_polar_sql(x: str, y: str) -> tuple[str, str]:
    e2 = J.E2
    chi = f"(pi() / 2 - 2 * atan(sqrt({x} * {x} + {y} * {y}) / {J.SCALE}::DOUBLE))"
    terms = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
    return f"degrees({chi} + " + " + ".join(f"{c}::DOUBLE * sin({2 * (k + 1)} * {chi})" for k, c in enumerate(terms)) + ")", f"(degrees(atan2({x}, -{y})) + {J.CENTRE_LON}::DOUBLE)"


def _padded(source: str, to: str, axis: str, other: str) -> list[str]:
    """Views that add a row before the first and after the last along an axis, by a linear step."""
    near = f"{to}_n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY {other}) AS n, lead(x) OVER w AS a_x, lead(y) OVER w AS a_y, lag(x) OVER w AS b_x, lag(y) OVER w AS b_y FROM {source} WINDOW w AS (PARTITION BY {other} ORDER BY {axis}))"
    edge = lambda k, step, d: f"SELECT {'i' if axis != 'i' else f'i + {step}'} AS i, {'j' if axis != 'j' else f'j + {step}'} AS j, 2 * x - {d}_x AS x, 2 * y - {d}_y AS y FROM {to}_n WHERE k = {k}"
    return [near, f"{to} AS (SELECT i, j, x, y FROM {source} UNION ALL {edge(1, -1, 'a')} UNION ALL {edge('n', 1, 'b')})"]


def corner_views(centre: str, prefix: str = "") -> list[str]:
    """Views up to ``corner``: the four corners (i, j, k, x, y) of each cell of a grid whose ``centre`` is a select of i, j, x, y."""
    p = prefix
    return [
        f"{p}centre AS ({centre})", *_padded(f"{p}centre", f"{p}pad_i", "i", "j"), *_padded(f"{p}pad_i", f"{p}pad_j", "j", "i"),
        f"{p}node AS (SELECT i + a AS i, j + b AS j, avg(x) AS x, avg(y) AS y FROM {p}pad_j, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b) GROUP BY ALL HAVING count(*) = 4)",
        f"{p}corner AS (SELECT c.i, c.j, o.k, n.x, n.y FROM {p}centre c, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) o(k, a, b) JOIN {p}node n ON n.i = c.i + o.a AND n.j = c.j + o.b)",
    ]


_X, _Y = to_polar_sql("(70 + i * 0.2::DOUBLE)", "(j * 0.4::DOUBLE + 10)")
#: corner: the four corners (k, x, y) of each cell of field_li's lattice.
CORNERS = corner_views(f"SELECT i, j, {_X} AS x, {_Y} AS y FROM (SELECT DISTINCT i, j FROM field_li)")


def sql(select: str, *views: str) -> str:
    return f"WITH {', '.join(views)} {select}" if views else select
