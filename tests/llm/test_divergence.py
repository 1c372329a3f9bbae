"""The divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridproof.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=30, top=50):
    """Of rows (text, lang, source): all rows of the result."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = {c: c + 32 for c in range(65, 91)}
    docs, n, total, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(lower))
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
        total[lang].update(terms)
        groups.add((lang, source))
    out = set()
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= least]

        def p(count):
            size = sum(count[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (count[t] + 5) // (size + 5 * len(kept)) for t in kept}  # noqa: B023

        own, q = p(n[lang, source]), p(total[lang])
        found = {"pair": [], "term": [(own[t] - q[t], t) for t in kept if n[lang, source][t] and own[t] > q[t]]}
        for la, other in groups:
            if la == lang and other != source:
                its = p(n[lang, other])
                found["pair"].append((sum(abs(own[t] - its[t]) for t in kept), other))
        for part, items in found.items():
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top}
    return out


def texts(n=500, seed=4, sources=7):
    r = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    for k in range(n):
        yield " ".join(r.choices(words, [1 / (i + 1) for i in range(200)], k=r.randint(0, 60))), r.choice(["en", "de", "en"]), f"s{int(r.random() ** 2 * sources)}"


CASES = [(None, None, None), (None, "en", "s0"), ("", "en", "empty"), ("Über ÜBER über ß 日本語, naïve NAÏVE", "en", None), ("in2a2 a_b C-d e\x00f", None, "s1"), ("x" * 50000, "en", "s2"), ("lone words here", "xx", "one"), ("123 !!", "zz", "a"), ("...", "zz", "b")]
CASES += [("common Words [of] `one` {kind} @home", "fr", "s1")] * 40 + [("common words É", "fr", "s2"), ("", "fr", "s3"), ("é É 𝒳", "fr", "é"), ("common", "fr", "z"), ("common", "fr", "Z")]


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 3, "y") for r in rows], "text string, lang string, source string, `n` int, `term` string").repartition(4)
    got = [tuple(r) for r in divergence.audit(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_cases(spark):
    rows = [*texts(), *CASES]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:50], least=2, top=3) == brute(rows[:50], 2, 3)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a b", "en", "only")]) == set()
    assert found(spark, [(None, "en", "a"), ("x", "en", "b")]) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


@pytest.mark.parametrize(("tile", "block"), [(2, 3), (3, 1000), (1, 7)])
def test_tiles_and_blocks(spark, monkeypatch, tile, block):
    rows = [*texts(300, seed=tile, sources=9), *CASES]
    want = brute(rows, 5)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    assert found(spark, rows, least=5) == want


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    rows = [*texts(200), *CASES]
    monkeypatch.setattr(divergence, "HELD", 10)
    assert found(spark, rows, least=3) == brute(rows, 3)


def test_shares_are_exact(spark):
    r = random.Random(1)
    rows = [(r.randrange(10**e), r.randrange(10**e, 10 ** (e + 1)), r.randrange(1, 10**6)) for e in range(1, 14) for _ in range(40)] + [(0, 0, 1), (9 * 10**14, 9 * 10**14, 1)]
    want = [1 + 10**9 * (n + 5) // (size + 5 * v) for n, size, v in rows]
    assert divergence.shares(*np.array(rows).T).tolist() == want
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, n long, size long, v long")
    assert [x.p for x in df.select("k", divergence.share(df.n, df.size, df.v).alias("p")).orderBy("k").collect()] == want


def test_runs():
    a = divergence.run_lengths(np.array([5, 5, 2, 2, 9]), np.array([0, 3, 4, 10, 11]))
    assert (a[0].tolist(), a[1].tolist()) == ([0, 4, 11], [5, 2, 9])
    b = divergence.run_lengths(np.array([5, 1, 1, 1, 1]), np.array([0, 3, 4, 10, 11]))
    assert divergence.apart(a, b, 20) == 3 * 0 + 1 * 4 + 7 * 1 + 9 * 8
