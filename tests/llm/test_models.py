"""Toxicity and language: held-out accuracy, cases, and plain versions of the scores."""

import math
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from gridproof.llm import langid, toxicity

CASES = [(1, None), (2, ""), (None, "the"), (3, "12 34 !!"), (4, "x. " * 30000), (5, "\n.\n"), (5, "\n.\n")]


def joined(spark, sf_dir, df):
    return df.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


@pytest.fixture(scope="module")
def more(sf_dir):
    return sf_dir.replace("0.001", "0.1")


def test_language(spark, more):
    from gridproof.llm.q_langid import op8_langid

    rows = joined(spark, more, op8_langid(spark, more)).select("doc_id", "held_out", "lang", "lang_pred", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) > 0.97 * len(out)


def test_language_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out(), per_language=20)
    got = langid.predict(spark.createDataFrame([(*c, "x") for c in CASES], "doc_id long, text string, score string"), model).collect()
    assert sorted((r.doc_id or -1, r.lang_pred == "und", r.score == 0) for r in got) == sorted((i or -1, i in (1, 2, 3, 5), i in (1, 2, 3, 5)) for i, _ in CASES)
    empty = docs.where("false")
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty, ~langid.held_out())
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_toxicity(spark, more):
    from gridproof.llm.q_toxicity import op4_toxicity

    scored = op4_toxicity(spark, more).join(spark.read.parquet(f"{more}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in scored)
    out = [r for r in scored if r.held_out]
    toxic, clean = [r.predicted for r in out if r.toxic], [r.predicted for r in out if not r.toxic]
    assert sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.01 * len(clean)


def test_toxicity_cases(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    df = spark.createDataFrame([(*c, "x") for c in CASES], "doc_id long, text string, predicted string")
    got = toxicity.score(df, model).collect()
    assert len(got) == len(CASES) and all(0 <= r.score < 0.7 for r in got)
    assert toxicity.clean(df, model).columns == df.columns and toxicity.clean(df, model).count() == len(CASES)
    assert toxicity.score(df.where("false"), model).count() == 0
    nothing = toxicity.fit(docs, labels.where("false"), ~toxicity.held_out())
    assert all(r.score < 0.1 for r in toxicity.score(df, nothing).collect())


def test_sentences():
    model = toxicity.train(["good day. fine words here", "calm. sea", "bad vile day. fine", "calm. vile sea"] * 20, [0, 0, 1, 1] * 20)
    features = toxicity.Features()
    text = "calm words here. a vile thing\nfine"
    spans = model.locate(text, features)
    assert [text[s["start"] : s["end"]] for s in spans] == [" a vile thing"]
    assert model.scores(["", "vile", "calm sea. fine day"], features).round().tolist() == [0, 1, 0]


def plain_toxicity(model, text):
    """Noisy-or over sentences of distinct words and word beginnings, and of the leak."""
    miss = math.log1p(math.exp(model.bias))
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = re.findall(r"[^\W_]+", sentence)
        own = {zlib.crc32(x.encode()) % toxicity.BUCKETS for w in words for x in (w, "^" + w[:4], "^" + w[:5])}
        z = model.bias + sum(model.weights[k] for k in own)
        miss += max(np.logaddexp(0, z) - math.log1p(math.exp(model.bias)), 0)
    return -math.expm1(-miss)


def test_toxicity_is_the_plain_noisy_or(spark, sf_dir):
    from gridproof.llm.q_toxicity import fitted, op4_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in op4_toxicity(spark, sf_dir).collect()}
    assert set(got) == set(texts) and all(got[k] == pytest.approx(plain_toxicity(model, t), abs=1e-9) for k, t in texts.items())


def test_toxicity_learns_the_same_on_the_driver(spark, sf_dir):
    """The model of bags that the executors cut is that of the whole texts."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = sorted(toxicity.sample(docs, labels, ~toxicity.held_out(), "text", "doc_id", "toxic", 50).collect(), key=lambda r: r.id)
    assert len(rows) > 20
    a = toxicity.train([r.text for r in rows], [r.y for r in rows])
    b = toxicity.fit(docs, labels, ~toxicity.held_out(), per_class=50)
    assert np.array_equal(a.weights, b.weights) and a.weights.any()


def plain_bag(text):
    """Buckets of all n-grams of the words with their edges, by the published hash step."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = [0x20, *map(ord, word), 0x20]
        for n in langid.ORDERS:
            for at in range(len(padded) - n + 1):
                gram = padded[at : at + n]
                if n == 1 and gram == [0x20]:
                    continue
                h = n
                for c in gram:
                    h = (h * 0x100000001B3 & (1 << 64) - 1) ^ c
                out.append((h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48)
    return out


def test_language_is_the_plain_average(spark, sf_dir):
    from gridproof.llm.q_langid import op8_langid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    got = {r.doc_id: (r.lang_pred, r.score) for r in op8_langid(spark, sf_dir).collect()}
    for r in docs.collect():
        own = plain_bag(r.text)
        if not own:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        z = (model.logits[own].sum(axis=0, dtype=float) / len(own) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id][0] == model.languages[int(p.argmax())] and got[r.doc_id][1] == pytest.approx(p.max(), abs=1e-5)


def test_sample_of_languages_is_bounded(spark, monkeypatch):
    """Rows of one id and many languages: the same bounded sample each time."""
    docs = spark.createDataFrame([(7, f"text {k}", f"l{k % 9}") for k in range(900)] + [(None, f"more {k}", "l0") for k in range(50)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    monkeypatch.setattr(langid, "TEXTS", 40)
    a, b = (sorted(map(tuple, langid.sample(docs.repartition(n), ~langid.held_out() | F.lit(True), "text", "doc_id", "lang", 300).collect()), key=str) for n in (2, 5))
    assert a == b and {r[1] for r in a} <= {"l0", "l1", "l2", "l3", "l4"} and len(a) <= 2 * 40
