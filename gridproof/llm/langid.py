"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are letter n-grams of one to four characters within words, with the word's edges as
characters of their own, hashed into buckets. A text's vector is the average of its subwords'
embeddings; a linear layer and a softmax give the languages. Embeddings and layer are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts (``per_language`` texts
of each language, chosen by a hash of their ids); a part of the sample kept out of the training
calibrates the temperature of the score and the score below which a prediction is not ``accepted``.

Scale: training data are bounded, and their texts stay on the executors; scoring is one narrow pass. As the layer is linear, embedding and
layer are multiplied once into a table of logits per bucket, and a task sums table rows.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0; a null id
counts as an empty one when texts are chosen for training and stays null; rows with a null language
are not learned from; repeated rows each get their own row; with nothing to learn from, every text
is ``und``; other input columns are not carried along."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_hash
from .words import slices

BUCKETS = 1 << 16
DIMENSIONS = 16
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 300
#: Languages that are learned at most, and about the most texts in all.
LANGUAGES, TEXTS = 256, 12_000
EDGE = 0x20


@lru_cache(1)
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the bucket of each subword, and the number of its text."""
    lowered = [x.lower() for x in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), "<u4")
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)) + 1)
    text = np.append(text, len(texts) - 1) if len(texts) else text
    edge = ~letters()[codes]
    keep = ~(edge & np.append(False, edge[:-1]))
    codes, edge, text = np.where(edge, EDGE, codes)[keep].astype(np.uint64), edge[keep], text[keep]
    for n in ORDERS:
        m = len(codes) - n + 1
        if m < 1:
            continue
        bucket = np.full(m, n, np.uint64)
        bad = np.zeros(m, bool)
        for k in range(n):
            bucket = bucket * np.uint64(0x100000001B3) ^ codes[k : m + k]
            if 0 < k < n - 1 or n == 1:
                bad |= edge[k : m + k]
        if n == 2:
            bad |= edge[:m] & edge[1 : m + 1]
        bucket = (bucket * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)
        # an edge belongs to the word it opens or closes, so a subword's text is that of its middle
        yield bucket[~bad].astype(np.int64), text[n // 2 : m + n // 2][~bad] if n > 2 else np.where(edge[:m], text[n - 1 :][:m], text[:m])[~bad]


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each bucket
    bias: np.ndarray
    temperature: float
    accept: float

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, and whether the text has a letter."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for bucket, text in subwords(texts):
            if len(text):
                first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                total[text[first]] += np.add.reduceat(self.logits[bucket], first, axis=0)
                count += np.bincount(text, minlength=len(texts))
        z = total / np.maximum(count, 1)[:, None] + self.bias
        return softmax(z / self.temperature), count > 0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bags(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text, its distinct buckets and their share of its subwords."""
    parts = [text * BUCKETS + bucket for bucket, text in subwords(texts)]
    key, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
    cut = np.searchsorted(key, np.arange(1, len(texts)) * BUCKETS)
    shares = [c / max(c.sum(), 1) for c in np.split(count, cut)]
    return np.split(key % BUCKETS, cut), shares


def train(texts: list[str], labels: list[str], **how) -> Model:
    """A model of texts at hand."""
    idx, share = [], []
    for at in range(0, len(texts), 100):
        a, b = bags(texts[at : at + 100])
        idx, share = idx + a, share + b
    return learned(idx, share, labels, **how)


def learned(idx: list[np.ndarray], share: list[np.ndarray], labels: list[str], epochs: int = 8, rate: float = 20.0, batch: int = 16, seed: int = 11) -> Model:
    """Stochastic gradient descent on the bags of texts; one text in five only calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb, layer, bias = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.3, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(idx))
    apart = set(order[::5].tolist()) if len(idx) >= 20 else set()
    learn = np.array([k for k in order if k not in apart])
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(learn), batch):
            rows = learn[at : at + batch]
            flat, of = np.concatenate([idx[k] for k in rows]), np.repeat(np.arange(len(rows)), [len(idx[k]) for k in rows])
            part = np.concatenate([share[k] for k in rows])[:, None]
            mean = np.zeros((len(rows), DIMENSIONS))
            np.add.at(mean, of, emb[flat] * part)
            g = softmax(mean @ layer + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = g @ layer.T
            layer -= step * 0.1 * mean.T @ g
            bias -= step * 0.01 * g.sum(axis=0)
            np.add.at(emb, flat, -step * part * back[of])
    table = (emb @ layer).astype(np.float32)
    model = Model(languages, table, bias, 1.0, 0.0)
    check = sorted(apart) or learn.tolist()
    z = np.array([(table[idx[k]] * share[k][:, None]).sum(axis=0) + bias for k in check])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    # the lowest score from which on at least 99 in 100 of the calibration texts are right
    down = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[down]) >= 0.99 * np.arange(1, len(down) + 1))
    model.accept = float(top[down][good[-1]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, learn: Column, text: str, doc_id: str, lang: str, per_language: int) -> DataFrame | None:
    """id, lang, text: about ``per_language`` labelled texts of each language, and twice that at most, by a hash of the id.

    Of more languages than ``LANGUAGES`` the most frequent are learned, and of many languages fewer texts each,
    so that ``TEXTS`` is about the number of texts."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).cast("string").alias("id"), F.xxhash64(F.col(doc_id), F.lit("language")).alias("hash"))
    n = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not n:
        return None
    each = max(1, min(per_language, TEXTS // len(n)))
    share = F.create_map(*[F.lit(x) for k, c in n.items() for x in (k, min(1.0, each / c))])
    draw = F.pmod(F.col("hash"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.where(draw < F.get(F.array(share), 0)[F.col("lang")])
    # rows of one id are drawn together: of these as well only so many are learned from, the same ones on each run
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id", F.xxhash64("text"), "text"))
    return near.withColumn("place", place).where(F.col("place") <= 2 * each).select("id", "lang", "text")


def fit(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Texts stay on the executors: the driver gets the bag of each sampled text, a number for each bucket at most."""
    rows = sample(docs, learn, text, doc_id, lang, per_language)
    if rows is None:
        return learned([], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1_000_000):
            idx, share = bags(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([xxhash.xxh3_64_hexdigest(x) for x in texts]), pa.array(idx, pa.list_(pa.int64())), pa.array(share, pa.list_(pa.float64()))], ["id", "lang", "text", "bucket", "share"])

    got = rows.mapInArrow(run, "id string, lang string, text string, bucket array<long>, share array<double>").toArrow()
    got = got.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
    parts = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in got[c]]
    return learned(parts("bucket"), parts("share"), got["lang"].to_pylist())


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text, 1_000_000):
            ids = part.column(part.schema.get_field_index(doc_id))
            if model.languages:
                p, some = model.scores(texts)
                best, score = p.argmax(axis=1), np.where(some, p.max(axis=1), 0.0)
                named = [model.languages[k] if s else "und" for k, s in zip(best.tolist(), some.tolist(), strict=True)]
            else:
                named, score = ["und"] * len(texts), np.zeros(len(texts))
            ok = [x != "und" and s >= model.accept for x, s in zip(named, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(named), pa.array(score), pa.array(ok)], ["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return id_hash(doc_id) % 5 == 0
