"""Queries: names and values of many products in one pass, by rules that are rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridproof.operators import tiles
from gridproof.sources import products as P

from . import views as V

#: What a name is made of, in Spark's and in SQL's date formats; d is the day, h an hour, x text of no meaning.
NAMES = (
    ("second_", "yyyyMMdd", "_x.nc", "%Y%m%d"), ("stem-", "yyyy-MM-dd", ".nc", "%Y-%m-%d"), ("period_a_b_c_d_e_f_", "yyyyMMdd", None, "%Y%m%d"), ("", "yyyy-MM-dd", "_x.nc", "%Y-%m-%d"),
    ("grid_", "'y'yyyy'm'MM'd'dd", ".nc", "y%Ym%md%d"), ("", "yyyyMMdd", "/x.npy", "%Y%m%d"), ("f.", "yyyyMMdd'06'", ".nc", "%Y%m%d06"), ("valid_", "yyyyMMdd'_12'", ".nc", "%Y%m%d_12"), ("valid_", "yyyy-MM-dd'_18'", ".nc", "%Y-%m-%d_18"),
    ("valid_", "yyyyMMdd'00_f030'", ".nc", "%Y%m%d00_f030"), ("before_x_", "yyyy-MM-dd", "_x.nc", "%Y-%m-%d"), ("third_x_", "yyyy-MM-dd", "_x_x.nc", "%Y-%m-%d"), ("last_x_", "yyyy-MM-dd", ".nc", "%Y-%m-%d"), ("monthly_x_", "yyyy-MM", ".nc", "%Y-%m"),
    ("day.", "yyyyMMdd", ".nc", "%Y%m%d"), ("run_x_", "yyyyMMdd'_06'", ".nc", "%Y%m%d_06"), ("track_", "'y'yyyy'm'MM'd'dd", "_x.csv", "y%Ym%md%d"), ("track_lost_", "'q'yyyy", ".csv", "q%Y"), ("valid_lost_", "'q'yyyy", ".nc", "q%Y"), ("nothing-", "'q'yyyy", ".nc", "q%Y"),
    ("stem-", "yyyy-'13-41'", ".nc", "%Y-13-41"),
)
#: Hours that the names add to the day, by their place above; of a month and of a period see the SQL.
_HOURS = {6: 6, 7: 12, 8: 18, 9: 30, 15: 6}


def paths(spark, sf_dir):
    """k, d, path: a name of each page, of one way of naming after the other."""
    e = V.table(spark, sf_dir, "pages").select(F.col("page_id"), (F.col("page_id") % len(NAMES)).cast("int").alias("k"), F.date_add(F.lit("2019-01-01").cast("date"), (F.col("page_id") * 7 % 1500).cast("int")).alias("d"))
    name = F.lit(None).cast("string")
    for k, (start, form, end, _) in enumerate(NAMES):
        rest = F.concat(F.lit("_"), F.date_format(F.date_add("d", 7), form), F.lit("_x.nc")) if end is None else F.lit(end)
        name = F.when(F.col("k") == k, F.concat(F.lit(start), F.date_format("d", form), rest)).otherwise(name)
    return e.withColumn("path", F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit("-/"), name))


def s04_rules(spark, sf_dir):
    p = paths(spark, sf_dir)
    said = p.where("page_id % 2 = 0").select("path", F.col("d").cast("timestamp_ntz").alias("ts"))
    return p.select("page_id", "path").join(P.dated(p, P.namings(spark), said), "path", "left").select("page_id", "product", "ts", "date")


_KNOWN = ["second_token", "stem_token", "period", "first_token", "lettered", "dated_folder", "dotted_hour", "valid_time", "valid_time", "valid_time", "before_last", "third_token", "last_token", "last_month", "dotted_day", "run", "track", "track", "valid_time", None, "stem_token"]
_TS = "CASE k " + " ".join(f"WHEN {k} THEN d + to_hours({h})" for k, h in _HOURS.items()) + " WHEN 2 THEN d + to_days(3) WHEN 13 THEN date_trunc('month', d) WHEN 17 THEN CASE WHEN page_id % 2 = 0 THEN d END WHEN 18 THEN CASE WHEN page_id % 2 = 0 THEN d END WHEN 19 THEN NULL WHEN 20 THEN NULL ELSE d END"
_PRODUCT = "CASE k " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_KNOWN) if p) + " END"

PRODUCTS = ("model_concentration", "model_thickness", "model_drift", "reanalysis_drift", "packed_concentration", "packed_drift", "daily_drift", "chart_concentration", "model_salinity")


def s26_products(spark, sf_dir):
    """Cells of all products at once: values of events, some missing, at fill values, on land or still."""
    e, n = V.table(spark, sf_dir, "events"), len(PRODUCTS)
    raw = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, -32768.0).when(F.col("event_id") % 17 == 0, -32767.0).when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("value").cast("double"))
    rows = e.select("event_id", F.get(F.array(*map(F.lit, PRODUCTS)), (F.col("user_id") % n).cast("int")).alias("product"), F.col("event_type").alias("dataset"), F.to_date("ts").alias("date"), F.lit(0).alias("channel"), (F.col("user_id") % 7).alias("i"), (F.col("user_id") % 3).alias("j"), F.when(F.col("event_id") % 19 != 0, F.col("user_id") % 4 == 0).alias("is_land"), raw.alias("value"))
    return P.cleaned(rows, P.steps(spark)).select("event_id", "product", F.round("value", 9).alias("value"))


def _correction(x, day):
    """A map drawn a tenth towards the mean about each cell, and a yearly wave: any function of a dense map will do."""
    some, total = (np.pad(v, 1) for v in (~np.isnan(x), np.where(np.isnan(x), 0, x)))
    n, near = (sum(v[a : a + x.shape[0], b : b + x.shape[1]].astype(float) for a in range(3) for b in range(3)) for v in (some, total))
    return x + (near / np.maximum(n, 1) - x) / 10 + np.cos(2 * np.pi * day / 365)


def d11_corrected(spark, sf_dir):
    return tiles.corrected(V.field_li(spark, sf_dir), _correction, halo=1).withColumn("value", F.round("value", 8))


QUERIES = {"d11_corrected": d11_corrected, "s04_rules": s04_rules, "s26_products": s26_products}
SQLS = {
    "d11_corrected": V.sql(
        "SELECT a.dataset, a.date, a.channel, a.i, a.j, round(any_value(a.value) + (avg(b.value) - any_value(a.value)) / 10 + cos(2 * pi() * (dayofyear(a.date) - 1) / 365), 8) AS value FROM field_li a JOIN field_li b ON a.dataset = b.dataset AND a.date = b.date AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.dataset, a.date, a.channel, a.i, a.j",
        V.FIELD_LI,
    ),
    "s04_rules": f"SELECT page_id, {_PRODUCT} AS product, ({_TS})::TIMESTAMP AS ts, ({_TS})::DATE AS date FROM (SELECT page_id, page_id % {len(NAMES)} AS k, (DATE '2019-01-01' + (page_id * 7 % 1500)::INT)::TIMESTAMP AS d FROM pages)",
    "s26_products": "SELECT event_id, product, round(CASE product WHEN 'model_concentration' THEN CASE WHEN NOT land THEN coalesce(v, 0) * 100 END WHEN 'model_thickness' THEN CASE WHEN NOT land THEN coalesce(v, 0) END WHEN 'model_drift' THEN v * 100"
    " WHEN 'reanalysis_drift' THEN CASE WHEN NOT coalesce(max(abs(v)) OVER (PARTITION BY product, dataset, date, i, j) = 0, FALSE) THEN v * 100 END WHEN 'packed_concentration' THEN CASE WHEN v > -32767 THEN v * 0.01::DOUBLE END WHEN 'packed_drift' THEN nullif(v, -32768) * 0.01::DOUBLE"
    " WHEN 'daily_drift' THEN nullif(v, -32768) WHEN 'chart_concentration' THEN v * 10 ELSE v END, 9) AS value FROM (SELECT event_id, " + "CASE user_id % " + str(len(PRODUCTS)) + " " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PRODUCTS)) + " END AS product, event_type AS dataset, CAST(ts AS DATE) AS date, user_id % 7 AS i, user_id % 3 AS j,"
    " coalesce(CASE WHEN event_id % 19 <> 0 THEN user_id % 4 = 0 END, FALSE) AS land, (CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -32768 WHEN event_id % 17 = 0 THEN -32767 WHEN user_id % 5 = 0 THEN 0 ELSE value END)::DOUBLE AS v FROM events)",
}
