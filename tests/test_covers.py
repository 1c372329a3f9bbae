"""Points in polygons by covers, against strips and plain counting."""

import math
import random

import pytest

from gridproof.operators import covers as C
from gridproof.operators import grid as G


def ring(poly, corners):
    return [(poly, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]


def coast(r, n, cx, cy, size, rough=0.07):
    """A rugged ring about a centre."""
    radius, out = size, []
    for k in range(n):
        radius = min(max(radius * r.uniform(1 - rough, 1 + rough), size * 0.4), size * 1.6)
        out.append((cx + radius * math.cos(2 * math.pi * k / n), cy + radius * math.sin(2 * math.pi * k / n)))
    return out


def shapes(seed=1):
    r = random.Random(seed)
    edges = ring(1, coast(r, 400, 0, 0, 10)) + ring(1, coast(r, 60, 0.5, -0.5, 2))  # with a hole
    edges += ring(2, [(-20, -20), (25, -20), (25, 22), (-20, 22)])  # four long edges about all
    edges += ring(3, [(0, 0), (6, 0), (6, 6), (3, 6), (3, 3), (0, 3)]) + ring(3, [(10, 10), (12, 10), (11, 14)])  # two parts
    edges += ring(4, coast(r, 25, 15, 15, 0.01)) + [(5, 1.0, 1.0, 1.0, 1.0)]
    return edges


def plain(points, edges):
    out = set()
    for k, x, y in points:
        n = {}
        for p, x1, y1, x2, y2 in edges:
            if x is not None and min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                n[p] = n.get(p, 0) + 1
        out |= {(k, p) for p, c in n.items() if c % 2}
    return out


def frames(spark, points, edges):
    return spark.createDataFrame(points, "point long, x double, y double").repartition(3), spark.createDataFrame([(p, *map(float, e)) for p, *e in edges], "poly_id int, x1 double, y1 double, x2 double, y2 double").repartition(3)


@pytest.mark.parametrize("size", [None, 0.05, 1.0, 7.0, 500.0])
def test_as_counting(spark, size):
    r = random.Random(7)
    edges = shapes()
    if size == 0.05:
        edges = [e for e in edges if e[0] != 2]
    points = [(k, r.uniform(-30, 30), r.uniform(-30, 30)) for k in range(1500)] + [(2000 + k, r.gauss(0, 10), r.gauss(0, 10)) for k in range(1500)]
    points += [(5000 + 30 * a + b, a / 2, b / 2) for a in range(30) for b in range(30)] + [(9000, None, 1.0), (9001, 15.0, 15.0)]
    p, e = frames(spark, points, edges)
    got = [tuple(r) for r in C.inside(p, e, size).collect()]
    want = plain(points, edges)
    assert len(got) == len(set(got)) and set(got) == want and len({q for _, q in want}) == (4 if size != 0.05 else 3)
    if size is None:
        assert {tuple(r) for r in G.in_polygons(p.where("x IS NOT NULL"), e, 3.0).collect()} == want


def test_empty(spark):
    p, e = frames(spark, [(1, 0.0, 0.0)], ring(1, [(-1, -1), (1, -1), (0, 1)]))
    assert C.inside(p, e).count() == 1
    assert C.inside(p.where("false"), e).count() == C.inside(p, e.where("false")).count() == 0


def test_work_grows_with_edges_and_points(spark):
    """A coast of many edges: a point meets few edges, and few blocks."""
    r = random.Random(2)
    points = [(k, r.uniform(-15, 15), r.uniform(-15, 15)) for k in range(3000)]
    p, e = frames(spark, points, ring(1, coast(r, 20_000, 0, 0, 10, 0.001)))
    size = 0.01  # about three edges long
    cells = C.boundary(e, size)
    n = cells.selectExpr("sum(size(edges)) AS held", "max(size(edges)) AS most").first()
    assert n.held < 12 * 20_000 and n.most < 60
    assert C.inner(cells).count() < 40 * cells.count()
    assert C.inside(p, e, size).count() == len(plain(points, [tuple(x) for x in e.collect()]))
