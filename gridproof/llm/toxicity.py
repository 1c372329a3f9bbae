"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is a logistic function of the distinct hashed words and word beginnings in it; a document's score is
the noisy-or of its sentences and of a leak they share, so one sentence can make it toxic. Sentence weights are trained from
document labels alone, by the gradient of the noisy-or, on a bounded sample (``per_class`` labelled
documents of each class, chosen by a hash of their ids). The trained sentences then locate the
passages that made a document toxic.

Scale: training data are bounded, and the sampled ids, which are bounded too, are broadcast to the
texts; the texts stay on the executors, and the driver learns from the features that tell the classes
apart alone; scoring is one narrow pass with a table of word weights of fixed size.

Defined cases: a null or empty text has one empty sentence; null labels are not learned from, and a
document labelled twice counts as toxic if either label says so; a null id counts as an empty one in
the fold rule, matches no label and stays null; repeated rows each get their own row; with nothing
to learn from, scores are those of an untrained model, near 0; other input columns are not carried
along."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_hash, written
from .words import slices

BUCKETS = 1 << 18
PER_CLASS = 3000
THRESHOLD = 0.7
#: Bytes of text scored at one time.
CHARS = 1_000_000
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]+")
STOPS = frozenset(".!?\n")


class Features:
    """Buckets of a lower-cased word: the word itself and its first four and five letters."""

    def __init__(self, keep: int = 150_000):
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = dict.fromkeys(STOPS, 0)
        self.table, self.used = np.full((1024, 3), -1, np.int64), 1

    def row(self, word: str) -> int:
        found = self.rows[word] = self.used
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        self.table[found] = [zlib.crc32(x.encode()) % BUCKETS for x in (word, f"^{word[:4]}", f"^{word[:5]}")]
        self.used += 1
        return found

    def of(self, tokens: list[list[str]], n: int) -> np.ndarray:
        """Buckets of all words, a row each; a row of -1 for what ends a sentence."""
        if self.used > self.keep:
            self._clear()
        get, row = self.rows.get, self.row
        at = np.fromiter((k if (k := get(w)) is not None else row(w) for ws in tokens for w in ws), np.int64, n)
        return self.table[at]


def sentences(texts: list[str], features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features: bucket and sentence of each; and the text of each sentence, one at least."""
    tokens = [TOKEN.findall(x.lower()) for x in texts]
    counts = np.fromiter(map(len, tokens), np.int64, len(texts))
    at = features.of(tokens, int(counts.sum()))
    stop = at[:, 0] < 0
    text = np.repeat(np.arange(len(texts)), counts)
    # a sentence begins with a text and after a stop
    number = np.cumsum(stop) + text
    key = np.unique((number[:, None] * BUCKETS + at)[~stop])
    # sentences are renumbered; those without a word are left out, except that each text has one
    before = np.concatenate([[0], np.cumsum(stop)])[np.cumsum(counts) - counts] + np.arange(len(texts))
    used, place = np.unique(np.concatenate([before, key // BUCKETS]), return_inverse=True)
    return key % BUCKETS, place[len(texts) :], np.searchsorted(before, used, "right") - 1


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, self.weights[bucket], n)

    def scores(self, texts: list[str], features: Features) -> np.ndarray:
        """Noisy-or of the sentences: 1 - prod(1 - p)."""
        bucket, sentence, text = sentences(texts, features)
        return -np.expm1(-self.misses(self.sentence_logits(bucket, sentence, len(text)), text, len(texts)))

    def misses(self, z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """-log of the chance that no sentence is toxic: the bias once for each text, and what a
        sentence has beyond it. So a text isn't toxic for its many sentences without a telling word."""
        base = np.logaddexp(0, self.bias)
        return base + np.bincount(text, np.maximum(np.logaddexp(0, z) - base, 0), n)

    def locate(self, text: str, features: Features, least: float = 0.5) -> list[dict]:
        """Sentences whose own score reaches ``least``: start, end, score."""
        out = []
        for m in SENTENCE.finditer(text):
            words = TOKEN.findall(m[0].lower())
            own = np.unique(features.of([words], len(words)))
            p = 1 / (1 + np.exp(-(self.bias + self.weights[own].sum())))
            if p >= least:
                out.append({"start": m.start(), "end": m.end(), "score": float(p)})
        return out


def telling(seen: np.ndarray, n: np.ndarray, least_texts: int, least_z: float) -> np.ndarray:
    """Features seen in ``least_texts`` texts and more often in toxic ones, by ``least_z`` standard errors.

    seen: of each class and bucket, the texts that have it; n: the texts of each class. Other features
    would only mark the texts they were seen in."""
    n = np.maximum(n, 1)
    p = (seen[0] + seen[1]) / n.sum()
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[0] + 1 / n[1]))
    return (seen[0] + seen[1] >= least_texts) & (seen[1] / n[1] - seen[0] / n[0] >= least_z * error)


def bag(text: str, features: Features, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The telling features of a text: bucket and sentence of each; sentences without one are left out."""
    bucket, sentence, _ = sentences([text], features)
    keep = some[bucket]
    return bucket[keep].astype(np.int32), np.unique(sentence[keep], return_inverse=True)[1].astype(np.int32)


def learned(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 12, steps: int = 2000, rate: float = 0.5, batch: int = 32, bias: float = -5.0, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adagrad on the noisy-or likelihood of the document labels, for ``epochs`` or about ``steps`` batches at least.

    ``bias`` is the leak's logit and is not trained. A sentence without features is as good as none."""
    model, seen = Model(np.zeros(BUCKETS), bias), np.full(BUCKETS, 1e-2)
    rng, y = np.random.default_rng(seed), np.array(labels, np.int64)
    size = [int(b[1].max()) + 1 if len(b[1]) else 0 for b in bags]
    for _ in range(max(epochs, batch * steps // max(len(bags), 1))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            n = [size[k] for k in rows]
            first = np.cumsum(n) - n
            bucket = np.concatenate([bags[k][0] for k in rows])
            sentence = np.concatenate([bags[k][1] + f for k, f in zip(rows, first, strict=True)])
            text = np.repeat(np.arange(len(rows)), n)
            z = model.sentence_logits(bucket, sentence, len(text))
            miss = model.misses(z, text, len(rows))
            slope = np.where(y[rows] > 0, -1 / np.maximum(np.expm1(np.minimum(miss, 30)), 1e-3), 1.0)
            g = slope[text] * (z >= model.bias) / (1 + np.exp(-z))
            words, where = np.unique(bucket, return_inverse=True)
            gw = np.bincount(where, g[sentence], len(words)) + decay * model.weights[words]
            seen[words] += gw * gw
            model.weights[words] -= rate * gw / np.sqrt(seen[words])
    return model


def train(texts: list[str], labels: list[int], least_texts: int = 4, least_z: float = 4.0, **how) -> Model:
    """A model of texts at hand."""
    features, y = Features(), np.array(labels, np.int64)
    own = [np.unique(sentences([x], features)[0]) for x in texts]
    seen = np.stack([np.bincount(np.concatenate([x for x, t in zip(own, y, strict=True) if t == k] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for k in (0, 1)])
    some = telling(seen, np.bincount(y, minlength=2)[:2], least_texts, least_z)
    return learned([bag(x, features, some) for x in texts], labels, **how)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, text: str, doc_id: str, label: str, per_class: int) -> DataFrame:
    """id, y, text: of ``per_class`` labelled ids of each class at most, the lowest by a hash of the id."""
    told = labels.where(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    told = told.withColumn("__h", F.xxhash64("__id", F.lit("toxicity")))
    some = lambda y: told.where(F.col("__y") == y).orderBy("__h", "__id").limit(per_class)
    chosen = some(0).unionByName(some(1)).select("__id", "__y")
    # of rows that share an id one is learned from; ids are bounded, so rows are as well
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__id")
    return rows.groupBy("__id", "__y").agg(F.min("__t").alias("__t")).select(F.col("__id").cast("string").alias("id"), F.col("__y").alias("y"), F.col("__t").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, least_texts: int = 4, least_z: float = 4.0) -> Model:
    """``learn``: condition on the id that says which labels may be learned from.

    Texts stay on the executors: the driver gets how many texts of each class have a bucket, which is
    bounded, and then the telling features of each sampled text."""
    rows = written(sample(docs, labels, learn, text, doc_id, label, per_class), "toxicity-sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part, texts in slices(batches):
            y = part.column(1).to_numpy()
            for k in (0, 1):
                own = [np.unique(sentences([x], features)[0]) for x, t in zip(texts, y, strict=True) if t == k]
                bucket, n = np.unique(np.concatenate(own or [np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"y": np.full(len(bucket), k, np.int32), "bucket": bucket, "n": n})

    counts = rows.mapInArrow(seen, "y int, bucket long, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per class and bucket
    table, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    table[counts["y"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    for r in rows.groupBy("y").count().collect():
        n[r.y] = r["count"]
    some = telling(table, n, least_texts, least_z)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part, texts in slices(batches):
            found = [bag(x, features, some) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([b[k] for b in found], pa.list_(pa.int32())) for k in (0, 1))], ["id", "y", "bucket", "sentence"])

    got = sorted(rows.mapInArrow(cut, "id string, y int, bucket array<int>, sentence array<int>").collect(), key=lambda r: r.id)
    discard(rows)
    return learned([(np.array(r.bucket, np.int32), np.array(r.sentence, np.int32)) for r in got], [r.y for r in got])


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, and ``offending``: spans of the sentences of documents predicted toxic."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for part, texts in slices(batches, text, CHARS):
            p = np.clip(model.scores(texts, features), 0.0, 1.0)
            found = [model.locate(x, features) if s >= threshold else [] for x, s in zip(texts, p, strict=True)]
            ids = part.column(part.schema.get_field_index(doc_id))
            yield pa.RecordBatch.from_arrays([ids, pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(found, span)], ["doc_id", "score", "predicted", "offending"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part, texts in slices(batches, text, CHARS):
            yield part.filter(pa.array(model.scores(texts, features) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return id_hash(doc_id) % 3 == 1
