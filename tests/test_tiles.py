"""Functions of whole fields over tiles."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridproof.operators import tiles

SCHEMA = "dataset string, date date, channel int, i int, j int, value double"


def rows(seed=1, side=30):
    r = random.Random(seed)
    out = [("a", dt.date(2020, 12, 31), 0, i, j, None if r.random() < 0.1 else r.gauss(0, 1)) for i in range(-5, side) for j in range(side) if r.random() < 0.8]
    out += [(f"d{k % 40}", dt.date(2021, 1, 1 + k // 40), None, k % 3, 7, float(k)) for k in range(400)]
    return out + [(None, dt.date(2021, 3, 1), 2, 0, 0, 1.5)]


def spread(x, day):
    """The largest of the nine cells about each, and the day."""
    pad = np.pad(np.where(np.isnan(x), -np.inf, x), 1, constant_values=-np.inf)
    best = np.max([pad[a : a + x.shape[0], b : b + x.shape[1]] for a in range(3) for b in range(3)], axis=0)
    return np.where(np.isfinite(best), best, np.nan) + day


@pytest.mark.parametrize("side", [4, 13, 256])
def test_results_do_not_depend_on_tiles(spark, side):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        got = {tuple(r[:5]): r.value for r in tiles.corrected(df, spread, 1, side).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {}
    for d, day, c, i, j, v in data:
        at.setdefault((d, day, c), {})[i, j] = v
    want = {}
    for key, cells in at.items():
        for i, j in cells:
            near = [v for a in (-1, 0, 1) for b in (-1, 0, 1) if (v := cells.get((i + a, j + b))) is not None]
            want[*key, i, j] = max(near) + key[1].timetuple().tm_yday - 1 if near else None
    assert set(got) == set(want) and all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v)) for k, v in want.items())


def test_origin_and_empty(spark):
    df = spark.createDataFrame(rows(2, 20), SCHEMA)
    place = lambda t: {"row": t.top + np.indices(t.values["v"].shape)[0], "column": t.left + np.indices(t.values["v"].shape)[1]}
    keys = ["dataset", "date", "channel"]
    out = tiles.over_tiles(df, keys, 2, {"v": F.col("value")}, place, ["row", "column"], 7)
    assert out.where("row <> i OR column <> j").count() == 0 and out.count() == df.count()
    assert tiles.over_tiles(df.where("false"), keys, 2, {"v": F.col("value")}, place, ["row", "column"]).count() == 0
