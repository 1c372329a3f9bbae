"""Naming and clean-up rules as rows."""

import datetime as dt

import pytest

from gridproof.sources import products as P

NAMES = {
    "/d/second_20200229_v1.nc": ("second_token", dt.datetime(2020, 2, 29)),
    "/d/stem-2020-12-31.nc": ("stem_token", dt.datetime(2020, 12, 31)),
    "/d/period_a_b_c_d_e_f_20191230_20200105_x.nc": ("period", dt.datetime(2020, 1, 2)),
    "/d/2021-05-06_x.nc": ("first_token", dt.datetime(2021, 5, 6)),
    "/d/grid_y2021m05d06.nc": ("lettered", dt.datetime(2021, 5, 6)),
    "/d/20210506/chart.npy": ("dated_folder", dt.datetime(2021, 5, 6)),
    "/d/a.2021050618.nc": ("dotted_hour", dt.datetime(2021, 5, 6, 18)),
    "/d/valid_20210506_18.nc": ("valid_time", dt.datetime(2021, 5, 6, 18)),
    "/d/valid_2021-05-06_06.nc": ("valid_time", dt.datetime(2021, 5, 6, 6)),
    "/d/valid_2021050612_f036.nc": ("valid_time", dt.datetime(2021, 5, 8)),
    "/d/valid_other.nc": ("valid_time", dt.datetime(2001, 1, 1, 3)),
    "/d/valid_none.nc": ("valid_time", None),
    "/d/before_x_2021-05-06_v2.nc": ("before_last", dt.datetime(2021, 5, 6)),
    "/d/third_x_2021-05-06_y_z.nc": ("third_token", dt.datetime(2021, 5, 6)),
    "/d/last_x_2021-05-06.nc": ("last_token", dt.datetime(2021, 5, 6)),
    "/d/monthly_x_2021-05.nc": ("last_month", dt.datetime(2021, 5, 1)),
    "/d/day.20210506.nc": ("dotted_day", dt.datetime(2021, 5, 6)),
    "/d/day.20211399.nc": ("dotted_day", None),
    "/d/run_x_20210506_12.nc": ("run", dt.datetime(2021, 5, 6, 12)),
    "/d/track_y2021m05d06_x.csv": ("track", dt.datetime(2021, 5, 6)),
    "/d/track_other.csv": ("track", dt.datetime(2002, 2, 2)),
}


def test_names(spark):
    paths = spark.createDataFrame([(p,) for p in [*NAMES, "/d/nothing.txt", "/d/day.20210506.nc"]], "path string")
    said = spark.createDataFrame([("/d/valid_other.nc", dt.datetime(2001, 1, 1, 3)), ("/d/track_other.csv", dt.datetime(2002, 2, 2)), ("/d/track_other.csv", dt.datetime(2002, 2, 3)), ("/d/last_x_2021-05-06.nc", dt.datetime(1999, 1, 1))], "path string, ts timestamp_ntz")
    got = P.dated(paths, P.namings(spark), said).collect()
    assert {r.path: (r.product, r.ts) for r in got} == NAMES and len(got) == len(NAMES)
    assert all(r.date == (r.ts and r.ts.date()) for r in got)
    without = {r.path: r.ts for r in P.dated(paths, P.namings(spark)).collect()}
    assert without["/d/valid_other.nc"] is None and without["/d/run_x_20210506_12.nc"] == dt.datetime(2021, 5, 6, 12)
    assert P.dated(paths.where("false"), P.namings(spark)).count() == 0
    with pytest.raises(ValueError):
        P.namings(spark, [P.Naming("x", 0, "", "", (), "week")])
    with pytest.raises(ValueError):
        P.steps(spark, [P.Step("x", 0, "double")])


def test_own_rules_come_in_order(spark):
    rules = P.namings(spark, [P.Naming("mine", 1, "x", r"(\d{4})", ("yyyy",)), P.Naming("mine", 0, "x", r"d(\d{2})_(\d{2})", ("MMdd", "yyMM"))])
    got = {r.path: r.ts for r in P.dated(spark.createDataFrame([("x2021",), ("xd21_07 2020",), ("x",)], "path string"), rules).collect()}
    assert got == {"x2021": dt.datetime(2021, 1, 1), "xd21_07 2020": dt.datetime(2021, 7, 1), "x": None}


def test_cleaning(spark):
    day = dt.date(2020, 1, 1)
    rows = [
        ("model_concentration", 0, False, None, 0.0), ("model_concentration", 1, True, 0.5, None), ("model_concentration", 2, None, 0.25, 25.0), ("model_thickness", 0, False, None, 0.0),
        ("packed_concentration", 0, False, -32767.0, None), ("packed_concentration", 1, False, 4000.0, 40.0), ("packed_drift", 0, True, -32768.0, None), ("packed_drift", 1, True, -150.0, -1.5), ("daily_drift", 0, False, None, None),
        ("reanalysis_drift", 0, False, 0.0, None), ("reanalysis_drift", 0, False, 0.0, None), ("reanalysis_drift", 1, False, 0.0, 0.0), ("reanalysis_drift", 1, False, 0.5, 50.0), ("reanalysis_drift", 2, False, None, None), ("unknown", 0, True, 3.0, 3.0), (None, 0, True, 3.0, 3.0),
    ]
    df = spark.createDataFrame([(k, p, "d", day, 0, i, 0, land, v) for k, (p, i, land, v, _) in enumerate(rows)], "k int, product string, dataset string, date date, channel int, i int, j int, is_land boolean, value double")
    out = P.cleaned(df, P.steps(spark))
    assert out.columns == df.columns
    assert {r.k: r.value for r in out.collect()} == {k: want for k, (*_, want) in enumerate(rows)}
    lon = spark.createDataFrame([("dotted_day", 0, 0, 1.0, 270.0), ("run", 0, 0, 1.0, 270.0)], "product string, i int, j int, lat double, lon double")
    assert {r.product: r.lon for r in P.turned(lon).collect()} == {"dotted_day": -90.0, "run": 270.0}
