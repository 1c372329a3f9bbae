"""Near-duplicates, repeated passages and vectors, against brute force."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from gridproof.llm import components, minhash, substrings, vectors
from gridproof.llm.common import written as stored_as
from gridproof.llm.sidecar import chosen, put

from . import brute


def stored(df):
    return stored_as(df, "input")


def near(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, component_id int, key string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in minhash.groups(df).collect())
    want = sorted((i if i is not None else -1, n, c if c is not None else -1) for i, n, c in brute.near(rows))
    assert got == want


def edited(r, base, n):
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return w


def test_near_cases(spark):
    near(spark, brute.CASES)
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_groups(spark):
    r = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    texts = [edited(r, base, r.randrange(12)) for _ in range(120)]
    texts += [base] * 20 + [[f"u{k}-{j}" for j in range(60)] for k in range(40)]
    shared = [f"p{k}" for k in range(60)]
    texts += [shared + [f"v{k}-{j}" for j in range(r.randrange(25))] for k in range(60)]
    r.shuffle(texts)
    near(spark, [(1000 - k, " ".join(t)) for k, t in enumerate(texts)])


def test_near_tiles(spark, monkeypatch):
    """Bands and clusters of many tiles give the same groups, by cluster and by band."""
    r = random.Random(14)
    shared = [f"p{k}" for k in range(60)]
    texts = [shared + [f"v{k}-{j}" for j in range(r.randrange(25))] for k in range(90)]
    rows = [(1000 - k, " ".join(t)) for k, t in enumerate(texts)]
    monkeypatch.setattr(minhash, "TILE", 7)
    near(spark, rows)
    monkeypatch.setattr(minhash, "MANY_TILES", 1)
    near(spark, rows)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 200)
    near(spark, rows)


def test_representatives(spark):
    rows = [*brute.CASES, (1, None), (77, "only one text of this id"), (77, None), (77, "another text of this id")]
    names = ["doc_id", "text", "row", "id", "kept", "__one", "task"]
    df = stored(spark.createDataFrame([(*x, k, k, k, k, k) for k, x in enumerate(rows)], "doc_id long, text string, row int, id int, kept int, __one int, task int").repartition(3))
    out = minhash.representatives(df)
    assert out.columns == names
    got = [tuple(x) for x in out.collect()]
    assert all(x[2:] == (x[2],) * 5 and x[:2] == rows[x[2]] for x in got)
    want, seen = [], set()
    for (i, _, root), (_, text) in sorted(zip(brute.near(rows), rows, strict=True), key=lambda x: (x[1][1] is None, x[1][1] or "")):
        if i is None or i == root and i not in seen:
            seen.add(i)
            want.append((i, text))
    assert sorted((x[:2] for x in got), key=str) == sorted(want, key=str)
    assert minhash.representatives(df.where("false")).count() == 0


def test_estimate(spark):
    from pyspark.sql import functions as F

    rows = [(k, " ".join(f"w{j}" for j in range(k * 40, 400 + k * 40))) for k in range(4)]
    book = minhash.signed(spark.createDataFrame(rows, "doc_id long, text string"))
    s = book.select("id", F.struct(*minhash.SIGNATURE).alias("x"))
    pair = s.join(s.select(F.col("id").alias("b"), F.col("x").alias("y")), F.col("id") < F.col("b"))
    for p in pair.select("id", "b", minhash.similarity(minhash.equal_lanes("x", "y")).alias("e")).collect():
        common = 396 - 40 * (p.b - p.id)
        assert abs(p.e - common / (792 - common)) < 0.17


def test_passages(spark, monkeypatch):
    r = random.Random(9)
    shared = [f"s{k}" for k in range(80)]
    rows = list(brute.CASES)
    for k in range(60):
        w = [f"d{k}-{j}" for j in range(r.randrange(200))]
        at, n = r.randrange(len(w) + 1), r.choice((20, 34, 35, 36, 70, 80))
        start = r.randrange(80 - n + 1)
        rows.append((100 + k, "\n".join(w[:at] + shared[start : start + n] + w[at:])))
    df = stored(spark.createDataFrame([(*x, 3, "s") for x in rows], "doc_id long, text string, n_words int, __spans string").repartition(3))
    monkeypatch.setattr(substrings, "UNIT_CHARS", 2000)
    for start in (None, 9, 18, 5, 35):
        out = substrings.cut(df, start=start)
        assert out.columns == ["doc_id", "text", "__spans", "n_words", "n_removed"]
        got = sorted((x.doc_id or -1, x.n_words, x.n_removed, x.text or "") for x in out.collect())
        want = []
        for (i, t), (w, gone) in zip(rows, brute.cut([t for _, t in rows]), strict=True):
            want.append((i or -1, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t or ""))
        assert got == sorted(want)
    assert substrings.cut(df.where("false")).count() == 0
    assert substrings.levels() == [9, 18, 35] and substrings.levels(35, 18) == [18, 35] and substrings.levels(8) == [8]


def test_passages_ends_early(spark, monkeypatch):
    """Without a repeated anchor the first level is the last."""
    df = stored(spark.createDataFrame([(k, " ".join(f"a{k}-{j}" for j in range(90))) for k in range(4)], "doc_id long, text string"))
    monkeypatch.setattr(substrings, "_next", None)
    assert {(r.n_words, r.n_removed) for r in substrings.cut(df).collect()} == {(90, 0)}


def test_changed_input_is_an_error(spark):
    """A table that gives tasks other rows on the second reading is never answered wrongly."""
    df = stored(spark.createDataFrame([(k, "same words " * 40) for k in range(6)], "doc_id long, text string").coalesce(1))
    left = substrings.repeated(df)
    places = put(spark.range(1).select(F.lit(5).cast("long").alias("row")), "side")
    for path, rows in ((left, df.limit(4)), (places, df), (places, df.where("doc_id < 3"))):
        with pytest.raises(Exception, match="input changed"):
            chosen(rows.coalesce(1), path).collect()
    assert chosen(df, left).count() == 6 and chosen(df, left, keep=False).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    x = [base[k % 12] + rng.normal(scale=s, size=16) for k, s in enumerate(rng.choice([0.02, 0.15, 0.3, 1.0], 300))]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(400 + k, x[5].tolist()) for k in range(30)] + [(450, (3 * x[6]).tolist())]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [None, *x[0][1:].tolist()]), (504, [float("inf")] * 16), (505, [float("nan")] * 16), (None, x[0].tolist()), (506, [1.0, 2.0]), (507, [1.0, 2.1])]
    rows += [(3, x[3].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                p, q = np.array(rows[a][1]), np.array(rows[b][1])
                if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= 0.9:
                    links[a].append(b)
    want = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        want.append((i if i is not None else -1, len(links[k]), min(rows[j][0] for j in seen) if i is not None else -1))
    whole = vectors.TILE
    for tile in (whole, 40):
        vectors.TILE = tile
        got = [(r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in vectors.groups(df).collect()]
        assert sorted(got) == sorted(want)
    vectors.TILE = whole
    assert vectors.groups(df.where("false")).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2060)]
    up = {i: i for x in links for i in x}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}


def test_least_percent(spark):
    """The fixed bands and lanes would lose most pairs below their similarity, so that is refused."""
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError, match="percent=50"):
        minhash.groups(df, percent=50)
    with pytest.raises(ValueError, match="percent=74"):
        minhash.links(df, df, percent=74)


def test_rows_without_words(spark):
    """Ids of a band of several components that also have null, empty and blank rows."""
    r = random.Random(6)
    shared = [f"p{k}" for k in range(60)]
    texts = [shared + [f"v{k}-{j}" for j in range(r.randrange(25))] for k in range(60)]
    rows = [(1000 - k, " ".join(t)) for k, t in enumerate(texts)]
    near(spark, rows + [(1000 - k, x) for k in range(60) for x in (None, "", " \n")])
