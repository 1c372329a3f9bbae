"""Runs of vector and window metrics, own statistics, and stores of many steps, against plain Python."""

import datetime as dt
import math
import random
import statistics
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridproof.operators import aggregators as A
from gridproof.operators import align as X
from gridproof.operators import metrics as M
from gridproof.plans import validate as R

SCHEMA = "dataset string, date date, channel int, i int, j int, value double"
DAY = lambda n: dt.date(2021, 3, n)


def winds(days=3, side=7, names="abc", seed=1):
    """Vector fields with missing components, absent cells, and a dataset that lacks a day."""
    r = random.Random(seed)
    for n in range(1, days + 1):
        for d in names:
            if (d, n) == ("b", 2):
                continue
            for i in range(side):
                for j in range(side):
                    if r.random() < 0.1:
                        continue
                    for c in (0, 1):
                        yield d, DAY(n), c, i, j, None if r.random() < 0.1 else round(r.gauss(0, 1), 3)


def std(cells, i, j, half, sigma, eps=1e-8):
    """Gaussian deviation of the present of ``cells`` about (i, j)."""
    near = [(v, math.exp(-((i - a) ** 2 + (j - b) ** 2) / (2 * sigma**2))) for (a, b), v in cells.items() if v is not None and abs(a - i) <= half and abs(b - j) <= half]
    if not near:
        return None
    total = sum(w for _, w in near)
    m1, m2 = (sum(v**k * w for v, w in near) / total for k in (1, 2))
    return math.sqrt(max(m2 - m1 * m1, 0) + eps)


def brute(rows, window=5, n_sigma=2.0, least=0.3):
    """metric, combo, date, channel, i, j, value of drift success, its efficiency, local deviation and the norm of differences."""
    half, sigma = window // 2, (window - 1) / (2 * n_sigma)
    at = defaultdict(dict)
    for d, day, c, i, j, v in rows:
        at[d, day].setdefault((i, j), {})[c] = v
    out = {}
    for day in sorted({k[1] for k in at}):
        has = sorted(d for d, n in at if n == day)
        cells = sorted(set().union(*(at[d, day] for d in has)))
        get = lambda d, cell: [at[d, day].get(cell, {}).get(c) for c in (0, 1)]  # noqa: B023, E731
        for d in has:
            for c in (0, 1):
                own = {x: at[d, day][x][c] for x in at[d, day] if c in at[d, day][x]}
                out |= {("local_spatial_std", d, day, c, *x): std(own, *x, half, sigma) if get(d, x)[c] is not None else None for x in cells}
        for a, b in combinations(has, 2):
            for x in cells:
                u, v = get(a, x), get(b, x)
                out["difference→norm", f"{a}|{b}", day, None, *x] = None if None in u + v else math.dist(u, v)
        for p, o, o0 in combinations(has, 3):
            change = [{x: None if None in (get(o, x)[c], get(o0, x)[c]) else get(o, x)[c] - get(o0, x)[c] for x in cells} for c in (0, 1)]
            for x in cells:
                values = get(p, x) + get(o, x) + get(o0, x)
                hit = lambda f: float(math.dist(f, get(o, x)) <= max(0.674 * math.hypot(*[std(change[c], *x, half, sigma) for c in (0, 1)]), least))  # noqa: B023, E731
                out["drift_success", f"{p}|{o}|{o0}", day, None, *x] = None if None in values else hit(get(p, x))
                out["drift_efficiency", f"{p}|{o}|{o0}", day, None, *x] = None if None in values else hit(get(p, x)) - hit(get(o0, x))
    return out


def test_vector_and_window_metrics(spark):
    rows = list(winds())
    hit = M.of_drift_success(5, 2.0, least=0.3)
    metrics = [M.of_local_std(5, 2.0, masked=True), hit, M.efficiency(hit), M.sequential(M.componentwise(M.DIFFERENCE), M.of_norm())]
    got = {tuple(r[:6]): r.value for r in R.metric_rows(spark.createDataFrame(rows, SCHEMA), metrics).collect()}
    want = brute(rows)
    assert set(got) == set(want) and {k[0] for k in want} == {m.name for m in metrics}
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-7)), (k, got[k], v)


def test_shared_windows_are_one_pass(spark):
    """Two metrics and four combinations ask for the spread of the same changes: each is looked at once."""
    f = spark.createDataFrame(list(winds(2, 4, "acde")), SCHEMA)
    hit = M.of_drift_success(5, 2.0)
    found = R.local_variances(f, [hit, M.efficiency(hit), M.of_local_std(5, 2.0)], list("acde"))
    assert list(found) == [(5, 2.0)]
    names = {r[0] for r in found[5, 2.0].select("of").distinct().collect()}
    assert names == {"a", "c", "d", "e"} | {"c|d", "c|e", "d|e"}
    n = found[5, 2.0].groupBy("of", "date", "channel", "i", "j").count().where("count > 1").count()
    assert n == 0


def test_chains(spark):
    row = spark.createDataFrame([((3.0, 4.0), (0.0, -2.0))], "v1 struct<u:double,v:double>, v2 struct<u:double,v:double>")
    value = lambda m: row.select(m.column().alias("x")).first().x
    assert value(M.sequential(M.of_norm(arity=2), M.DIFFERENCE)) == 3.0
    assert value(M.sequential(M.of_norm(math.inf, arity=2), M.TIMES, M.SQUARED)) == 64.0
    assert value(M.of_angle(normalize=True, arity=1)) == pytest.approx(math.degrees(math.atan2(4, 3)))
    assert value(M.of_angle_error()) == pytest.approx(math.degrees(math.acos(-4 / 5)))
    for bad in (lambda: M.of_norm(arity=2).column(), lambda: value(M.sequential(M.of_norm(arity=2), M.SQUARED)), lambda: M.Metric("x", 1, lambda a: a, "map"), lambda: M.Metric("x", 1, lambda a, s: s, spreads=(M.Spread((1,)),)), lambda: M.Spread((0, 1, 2))):
        with pytest.raises(ValueError):
            bad()


def test_fewer_datasets_than_a_metric_takes(spark):
    f = spark.createDataFrame(list(winds(2, 3, "ac")), SCHEMA)
    assert R.metric_rows(f, [M.of_drift_success(5)]).count() == 0
    only_scalars = f.withColumn("channel", F.lit(7))
    assert R.metric_rows(only_scalars, [M.of_norm()], ["a", "c"]).count() == 0
    assert R.run(f, [M.of_norm(), M.MAE], [R.AVERAGE]).count() == 3


OVER = A.Statistic("over_one", "cnt:bigint,hit:bigint", lambda v: {"cnt": F.count(v), "hit": F.count(F.when(v > 1, v))}, lambda a, b: {c: a[c] + b[c] for c in ("cnt", "hit")}, lambda s: F.when(s["cnt"] > 0, s["hit"] / s["cnt"]))
ALL = [R.Aggregation(f"{s.name}_{n}", k, s) for s in (*A.STATISTICS, A.quantile(0.9, 9), OVER) for n, k in (("dates", ("date", "channel")), ("cells", ("channel", "i", "j")), ("all", ()))]
OWN = (A.quantile(0.9, 9), OVER)


def cut(x, bits=7):
    step = 2.0 ** (math.floor(math.log2(abs(x))) - bits) if x else 1
    return math.copysign(abs(x) // step * step, x)


def told(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.aggregator, r.metric, r.combo, r.date, r.channel, r.i, r.j].append(r.value)
    assert all(len(v) == 1 for v in out.values())
    return {k: v[0] for k, v in out.items()}


def close(a, b):
    assert set(a) == set(b)
    for k in a:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or a[k] == pytest.approx(b[k], abs=1e-12)), (k, a[k], b[k])


def test_statistics(spark, tmp_path):
    f = spark.createDataFrame(list(winds(6, 4)), SCHEMA).cache()
    want = told(R.run(f, [M.DIFFERENCE], ALL).collect())
    values = defaultdict(list)
    for r in R.metric_rows(f, [M.DIFFERENCE]).collect():
        for n, key in (("dates", (r.date, r.channel, None, None)), ("cells", (None, r.channel, r.i, r.j)), ("all", (None,) * 4)):
            values[n, r.combo, *key] += [] if r.value is None else [r.value]
    rank = lambda v, p: sorted(v)[max(0, math.ceil(p * len(v) - 1e-9) - 1)]
    of = {"mean": statistics.fmean, "total": sum, "least": min, "most": max, "deviation": statistics.pstdev, A.MEDIAN.name: lambda v: rank(list(map(cut, v)), 0.5), OWN[0].name: lambda v: rank([cut(x, 9) for x in v], 0.9), "over_one": lambda v: sum(x > 1 for x in v) / len(v)}
    close(want, {(f"{s}_{n}", "difference", *key): (f(v) if v else 0.0 if s == "total" else None) for (n, *key), v in values.items() for s, f in of.items()})
    store = R.Store(spark, str(tmp_path / "store"), OWN, fan=2)
    for n in range(1, 7, 2):
        store.add(f.where(F.dayofmonth("date").isin(n, n + 1)), [M.DIFFERENCE], ALL)
    close(told(store.summary().collect()), want)
    with pytest.raises(ValueError, match="over_one"):
        R.Store(spark, str(tmp_path / "store")).summary()


def test_many_batches_stay_few_files(spark, tmp_path):
    """Rows of a few dates in many batches: snapshots, manifests and folders of rows are bounded, and the result is that of one run."""
    r = random.Random(3)
    rows = list(winds(3, 3, "ab"))
    batches = [rows[k::9] for k in range(9)]
    store, kept = R.Store(spark, str(tmp_path / "s"), OWN, fan=3), [a for a in ALL if not a.name.startswith("total")]
    for k, b in enumerate(batches):
        r.shuffle(b)
        store.merge(spark.createDataFrame(b, SCHEMA), f"in-{k:05d}", [M.DIFFERENCE], kept)
        if k == 4:  # batches that come again add nothing
            for again in (4, 2):
                store.merge(spark.createDataFrame(batches[again], SCHEMA), f"in-{again:05d}", [M.DIFFERENCE], kept)
    close(told(store.summary().collect()), told(R.run(spark.createDataFrame(rows, SCHEMA), [M.DIFFERENCE], kept).collect()))
    assert len(store.marked()) <= 2 * 3 and len(list((tmp_path / "s" / "manifests").glob("*.json"))) <= 2
    assert len(list((tmp_path / "s" / "snapshots").iterdir())) <= 2 * 3 + 3
    # rows of a date lie in one place, but for those of the step before
    assert len(list((tmp_path / "s" / "arrived").glob("*/date=*"))) <= 2 * 3
    store.merge(spark.createDataFrame([], SCHEMA), "in-00020", [M.DIFFERENCE], kept)
    store.merge(spark.createDataFrame([("a", None, 0, 0, 0, 1.0)], SCHEMA), "other", [M.DIFFERENCE], kept)
    assert store.read("dates").count() == 3


def test_a_broken_step_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    f = spark.createDataFrame(list(winds(4, 3, "ab")), SCHEMA)
    store = R.Store(spark, str(tmp_path / "s"))
    store.add(f.where("day(date) < 3"), [M.MAE], [R.AVERAGE])
    before = told(store.summary().collect())
    with monkeypatch.context() as m:
        m.setattr(R.Store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(f, [M.MAE], [R.AVERAGE])
    assert told(store.summary().collect()) == before
    store.add(f, [M.MAE], [R.AVERAGE])
    close(told(store.summary().collect()), told(R.run(f, [M.MAE], [R.AVERAGE]).collect()))


def test_field_is_read_once(spark):
    """Both sides of the plan of combinations read one exchange."""
    f = spark.createDataFrame(list(winds(2, 3)), SCHEMA).repartition(3, "i")
    rows = X.combos(f, 2, list("abc"))
    rows.collect()
    assert "ReusedExchange" in rows._jdf.queryExecution().executedPlan().toString()


def test_tiles_hold_a_row_for_each_cell(spark, monkeypatch):
    """The names that are asked for add no rows to the passes of tiles."""
    rows, made = [], R.over_tiles
    monkeypatch.setattr(R, "over_tiles", lambda field, *args: rows.append(field.count()) or made(field, *args))
    f = spark.createDataFrame(list(winds(2, 4, "acde")), SCHEMA)
    found = R.local_variances(f, [M.of_drift_success(5, 2.0), M.of_local_std(5, 2.0)], list("acde"))
    assert found[5, 2.0].select("of").distinct().count() == 7
    assert rows == [f.select("date", "channel", "i", "j").distinct().count()]
