"""Rounding of results as their SQL does it."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridproof.plans import catalog
from gridproof.plans import views as V

#: The relative error of the first pair ends in a half by its shortest decimal form, and below it by its product with 10 ** 9.
PAIRS = [(237.46, 2.73), (50.0, 0.0), (0.0, 0.0), (12.5, 12.5), (433.93, 0.31)]


def test_relative_errors_are_rounded_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(10 * k + n, datetime.datetime(2024, 1, 1, k), k, kind, v, "{}") for k, pair in enumerate(PAIRS) for n, (kind, v) in enumerate(zip("ab", pair, strict=True))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["i"], r["j"]): r["value"] for r in catalog.queries()["m03_relative_error"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[:2]: r[2] for r in con.execute(f"SELECT i, j, value FROM ({catalog.oracle_sql()['m03_relative_error']})").fetchall()}
    assert got == want and want[0, 0] == 8598.168498168 and want[0, 1] == float("inf")


def test_rounding_keeps_what_has_no_such_digits(spark):
    values = [None, float("inf"), -float("inf"), 1.7e308, -1.7e308, 0.0, 2.5e-10, 0.5e-9, -0.5e-9, 8598.1684981685, -8598.1684981685]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(V.rounded(F.col("v"), 9)).collect()]
    assert got == [None, float("inf"), -float("inf"), 1.7e308, -1.7e308, 0.0, 0.0, 1e-9, -1e-9, 8598.168498168, -8598.168498168]
