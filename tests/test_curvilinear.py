"""Regridding between curved grids against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridproof.operators import curvilinear as U
from gridproof.operators import grid as G


def sphere(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def grid(spark, lat, lon):
    rows = [(i, j, float(lat[i, j]), float(lon[i, j])) for i in range(lat.shape[0]) for j in range(lat.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, lat double, lon double")


def curved(n=9, m=8, width=0.05):
    """A bent and turned lattice about the pole."""
    y, x = np.meshgrid(np.linspace(-n, n, n) * width / 2, np.linspace(-m, m, m) * width / 2, indexing="ij")
    x, y = x + 0.3 * y * y + 0.05 * x * y, y - 0.2 * x * x
    x, y = x * math.cos(0.6) - y * math.sin(0.6), x * math.sin(0.6) + y * math.cos(0.6)
    z = np.sqrt(1 - x * x - y * y)
    return np.degrees(np.arcsin(z)), np.degrees(np.arctan2(y, x))


def inverse(p, k):
    """s, t of the ray to p in the bilinear surface of the corners k, by Newton's method, or None."""
    u = np.array([p[1], -p[0], 0.0]) if abs(p[2]) < 0.9 else np.array([0.0, p[2], -p[1]])
    u /= np.linalg.norm(u)
    flat = np.stack([k @ u, k @ np.cross(p, u)], axis=1)
    a, b, c, d = flat[0], flat[1] - flat[0], flat[3] - flat[0], flat[0] - flat[1] - flat[3] + flat[2]
    s = t = 0.5
    for _ in range(30):
        jac = np.stack([b + t * d, c + s * d], axis=1)
        if abs(np.linalg.det(jac)) < 1e-15:
            return None
        s, t = np.array([s, t]) - np.linalg.solve(jac, a + s * b + t * c + s * t * d)
    return (s, t) if -1e-9 <= s <= 1 + 1e-9 and -1e-9 <= t <= 1 + 1e-9 and p @ k[0] > 0 else None


def brute(src, dst):
    """{destination: {source: weight}} of the first quadrilateral that holds each destination."""
    x, out = sphere(*src), {}
    for q, p in np.ndenumerate(np.empty(dst[0].shape)):
        p = sphere(dst[0][q], dst[1][q])
        for i in range(x.shape[0] - 1):
            for j in range(x.shape[1] - 1):
                at = [(i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j)]
                if q not in out and (st := inverse(p, np.stack([x[c] for c in at]))):
                    s, t = st
                    out[q] = dict(zip(at, ((1 - s) * (1 - t), s * (1 - t), s * t, (1 - s) * t), strict=True))
    return out


def test_bilinear(spark):
    src = curved()
    lat, lon = np.meshgrid(np.linspace(74, 89.9, 9), np.linspace(-180, 180, 13), indexing="ij")
    want = brute(src, (lat, lon))
    got = {}
    for r in U.bilinear_between(grid(spark, *src), grid(spark, lat, lon)).collect():
        got.setdefault((r.dst_i, r.dst_j), {})[r.src_i, r.src_j] = r.w
    assert set(got) == set(want) and 20 < len(want) < lat.size
    for q, ws in want.items():
        assert sum(got[q].values()) == pytest.approx(1)
        for c, w in ws.items():
            assert got[q].get(c, 0.0) == pytest.approx(w, abs=1e-7)


def test_own_centres(spark):
    g = grid(spark, *curved(5, 4)).unionByName(spark.createDataFrame([(9, 9, None, 1.0)], "i int, j int, lat double, lon double"))
    got = [tuple(r) for r in U.bilinear_between(g, g).where("w > 1e-6").collect()]
    assert {r[:2] for r in got} == {r[2:4] for r in got} == {(i, j) for i in range(5) for j in range(4)}
    assert all(r[:2] == r[2:4] and r[4] == pytest.approx(1, abs=1e-6) for r in got)
    assert U.bilinear_between(g.where("false"), g).count() == U.bilinear_between(g, g.where("false")).count() == 0


def test_closed_grid(spark):
    lat, lon = np.meshgrid(np.linspace(-60, 60, 7), np.arange(0, 360, 30), indexing="ij")
    dst = spark.createDataFrame([(0, 0, 10.0, 345.0), (1, 0, 10.0, 15.0)], "i int, j int, lat double, lon double")
    src = grid(spark, lat.astype(float), lon.astype(float))
    assert {r.dst_i for r in U.bilinear_between(src, dst).collect()} == {1}
    got = [tuple(r) for r in U.bilinear_between(src, dst, wrap=12).where("dst_i = 0").collect()]
    assert {r[1] for r in got} == {11, 0} and sum(r[4] for r in got) == pytest.approx(1)


def test_conservative(spark):
    src, dst = curved(12, 12, 0.02), curved(3, 3, 0.09)
    fine, coarse = grid(spark, *src), grid(spark, *dst)
    w = U.conservative_between(fine, coarse, 6).collect()
    of = {}
    for r in w:
        of[r.dst_i, r.dst_j] = of.get((r.dst_i, r.dst_j), 0) + r.w
    assert all(v == pytest.approx(1) for v in of.values())
    area = {(r.quad.i, r.quad.j): r.area for r in U.cell_quads(fine).collect()}
    covered = {}
    for r in w:
        covered[r.src_i, r.src_j] = covered.get((r.src_i, r.src_j), 0) + r.area
    # the coarse cells hold all of the fine ones but for the rim, so those give all their area
    assert all(covered[c] == pytest.approx(area[c]) for c in area if 2 <= c[0] < 10 and 2 <= c[1] < 10)
    shares = U.conservative_between(fine, coarse, 6, covered=False).collect()
    whole = {(r.quad.i, r.quad.j): r.area for r in U.cell_quads(coarse).collect()}
    for r in shares:
        assert r.w == pytest.approx(r.area / whole[r.dst_i, r.dst_j])
    assert {(r.src_i, r.src_j, r.dst_i, r.dst_j) for r in w} == {(r.src_i, r.src_j, r.dst_i, r.dst_j) for r in U.weights_between(fine, coarse, 6).collect()}
    assert U.weights_between(coarse, fine).groupBy("dst_i", "dst_j").count().where("count > 4").count() == 0


def test_field(spark):
    """A smooth field keeps its values; cells outside are missing."""
    src, dst = curved(), curved(5, 5, 0.12)
    g, d = grid(spark, *src), grid(spark, *dst)
    f = g.select(F.lit("a").alias("dataset"), F.lit("2020-01-01").cast("date").alias("date"), F.lit(0).alias("channel"), "i", "j", F.sin(F.radians("lat")).alias("value"))
    w = U.bilinear_between(g, d)
    got = {(r.i, r.j): r.value for r in U.everywhere(G.regridded(f, w), f, d).collect()}
    inside = {(r.dst_i, r.dst_j) for r in w.collect()}
    assert len(got) == 25 and {c for c, v in got.items() if v is not None} == inside and 3 < len(inside) < 25
    assert all(got[c] == pytest.approx(math.sin(math.radians(dst[0][c])), abs=2e-3) for c in inside)
