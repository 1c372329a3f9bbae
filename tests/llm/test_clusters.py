"""Clusters against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridproof.llm import clusters


def brute(rows, k=16, rounds=3, seed=1, scale=64, width=64):
    """Of rows (id, vector): (id, cluster, distance, centroid) of those that count."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c))
    for _ in range(rounds):
        of = [near(x) for _, x in kept]
        for c in range(len(centroids)):
            if own := [x for (_, x), o in zip(kept, of, strict=True) if o == c]:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, c := near(x), far(x, centroids[c]), tuple(centroids[c])) for i, x in kept]


def vectors(n=400, seed=3, width=64):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(k, [m + r.gauss(0, 0.4) for m in r.choice(middle)]) for k in range(n)]


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "mine", 7) for i, v in rows], "vec_id long, embedding array<double>, cluster string, `n` int").repartition(3)
    got = clusters.cluster(df, **how).collect()
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, tuple(r.centroid)) for r in got), got


def test_cases(spark):
    rows = vectors()
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65)]
    rows += [(904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63), (907, [0.0] * 64), (908, [0.0] * 64), (909, [-0.001] * 64), (910, [1e5] * 64), (911, [-3e6] + [0.5] * 63)]
    want = sorted((-1 if i is None else i, c, d, m) for i, c, d, m in brute(rows))
    got, full = found(spark, rows)
    assert got == want
    total = sum(d for _, _, d, _ in want)
    for r in full:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d, _ in want if c == r.cluster)


def test_few_and_equal_vectors(spark):
    same = [(k, [0.25] * 64) for k in range(40)]
    assert found(spark, same)[0] == [(k, 0, 0, (16,) * 64) for k in range(40)]
    few = vectors(5)
    assert found(spark, few)[0] == sorted(brute(few))
    assert found(spark, [])[0] == found(spark, [(1, None), (2, [1.0])])[0] == []


def test_parameters(spark):
    rows = [(k, v[:8]) for k, v in vectors(60, seed=9)]
    assert found(spark, rows, k=3, rounds=1, seed=5, width=8, scale=10)[0] == sorted(brute(rows, 3, 1, 5, 10, 8))
    with pytest.raises(ValueError):
        found(spark, [(1, [1.0] * 3)], width=3)
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e300] * 64)])


def test_transform_keeps_distances():
    r = np.random.default_rng(2)
    x = r.integers(-1000, 1000, (50, 64))
    assert ((clusters.transform(x) ** 2).sum(axis=1) == 64 * (x * x).sum(axis=1)).all()
    signs = (np.diff(np.sign(clusters.transform(np.eye(64, dtype=np.int64)).T), axis=1) != 0).sum(axis=1)
    assert signs.tolist() == list(range(64))


@pytest.mark.parametrize("spread", [1, 30, 100_000, 1 << 22])
def test_search_is_exact(spread):
    r = np.random.default_rng(spread)
    x, c = r.integers(-spread, spread + 1, (700, 64)), r.integers(-spread, spread + 1, (16, 64))
    c[9], c[12] = c[3], c[3]
    x[:50] = c[12] + r.integers(-1, 2, (50, 64))
    x[50:60] = (c[1] + c[2]) // 2
    number, distance = clusters.nearest(x, c)
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert number.tolist() == [min(range(16), key=lambda k: (row[k], k)) for row in d.tolist()]
    assert distance.tolist() == d.min(axis=1).tolist()
