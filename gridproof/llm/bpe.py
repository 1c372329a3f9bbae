"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round finds the rank of each adjacent pair by
binary search over the sorted pair keys, takes the lowest rank of each word, merges all its
occurrences from left to right, and drops the words that are done. A rank can only create pairs of
higher rank, so a round per rank and word equals merging one pair at a time. Decoding gathers the
bytes of all ids from one flat array.

Scale: a narrow pass over the texts; a task holds a few MB of text and a bounded set of words.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null id stays null;
repeated rows each get their own row; ``ids`` and ``decoded`` replace columns of the input with
these names, all others are carried along."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import WordPool, gather, slices

#: Fixed value: the published split rule of byte-level BPE, white space spelled as the Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
NEVER = np.iinfo(np.int64).max
#: Symbols from which a word is merged by itself.
LONG = 1000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 is itself, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """A vocabulary: tables for merging and for decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, letters = file["model"]["vocab"], byte_letters()
        self.of_byte = np.array([vocab[x] for x in letters], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in file["model"]["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        byte = {x: b for b, x in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(byte[x] for x in token) if all(x in byte for x in token) else token.encode()
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.n_bytes = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.n_bytes) - self.n_bytes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(text)
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self.words.findall(part))]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and ids per word."""
        data = [w.encode() for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        flat = self.of_byte[np.frombuffer(b"".join(data), np.uint8)]
        done = self.merge(flat, np.repeat(np.arange(len(words)), lengths))
        counts = np.bincount(done[1], minlength=len(words))
        for k in [k for k, w in enumerate(words) if w in self.special]:
            stop = int(counts[: k + 1].sum())
            done = tuple(np.concatenate([x[: stop - counts[k]], [y], x[stop:]]) for x, y in zip(done, (self.special[words[k]], k), strict=True))
            counts[k] = 1
        return done[0].astype(np.int32), counts

    def rank(self, key: np.ndarray) -> np.ndarray:
        """Ranks of pairs by binary search (no pair: NEVER)."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over symbols and the word each belongs to; both ordered by word.

        Words over LONG symbols go one by one, as a round over all of a word for each rank in it
        would take the square of its length."""
        ended = []
        n = np.bincount(word) if len(word) else np.zeros(0, np.int64)
        stop, short = np.cumsum(n), np.ones(len(sym), bool)
        for k in np.flatnonzero(n > LONG).tolist():
            own = slice(stop[k] - n[k], stop[k])
            done = self.merge_long(sym[own])
            ended.append((done, np.full(len(done), k, word.dtype)))
            short[own] = False
        sym, word = sym[short], word[short]
        while len(sym) > 1:
            rank = np.append(np.where(word[:-1] == word[1:], self.rank((sym[:-1] << 32) | sym[1:]), NEVER), NEVER)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            if (over := least == NEVER).any():
                ended.append((sym[over], word[over]))
                go = ~over
                sym, word, rank, least = sym[go], word[go], rank[go], least[go]
                if not len(sym):
                    break
            hit = rank == least
            # of hits that follow one another, as in a run of one letter, each second one is left
            at = np.arange(len(hit))
            start = hit & ~np.append(False, hit[:-1])
            run = np.maximum.accumulate(np.where(start, at, 0))
            hit &= (at - run) % 2 == 0
            sym = np.where(hit, self.merged[np.where(hit, rank, 0)], sym)
            keep = ~np.append(False, hit[:-1])
            sym, word = sym[keep], word[keep]
        ended.append((sym, word))
        out, of = np.concatenate([x for x, _ in ended]), np.concatenate([x for _, x in ended])
        order = np.argsort(of, kind="stable")
        return out[order], of[order]

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The symbols of one word after all merges.

        Symbols stay where they are, linked to the next one and the one before. Ranks are taken in
        blocks from the lowest up, a round for each rank in a block; a round touches the block's
        candidates, and only pairs beside a merge are searched again."""
        sym, n = sym.copy(), len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.rank((sym[:-1] << 32) | sym[1:]), NEVER)
        while len(live := np.flatnonzero(rank < NEVER)):
            size = min(len(live), max(256, len(live) // 64)) - 1
            limit = np.partition(rank[live], size)[size]
            block = live[rank[live] <= limit]
            while len(block):
                r = rank[block]
                least = r.min()
                if least > limit:
                    break
                at = np.unique(block[r == least])
                # of pairs that follow one another, as in a run of one letter, each second one is left
                place = np.arange(len(at))
                start = np.append(True, after[at[:-1]] != at[1:])
                at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
                gone = after[at]
                sym[at] = self.merged[least]
                rank[gone] = NEVER
                after[at] = after[gone]
                inner = after[at] < n
                before[after[at[inner]]] = at[inner]
                left = before[at]
                near = np.unique(np.append(at, left[left >= 0]))
                ends = after[near] >= n
                rank[near] = np.where(ends, NEVER, self.rank((sym[near] << 32) | sym[np.where(ends, 0, after[near])]))
                block = np.append(block[r > least], near[rank[near] <= limit])
        return sym[self._chain(after)]

    @staticmethod
    def _chain(after: np.ndarray) -> np.ndarray:
        """The places from 0 on along the links."""
        out, at, links = [], 0, after.tolist()
        while at < len(links):
            out.append(at)
            at = links[at]
        return np.array(out, np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of rows of ``counts`` ids; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.n_bytes[ids]
        data = gather(self.bytes, self.at[ids], lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def _with(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [k for k, f in enumerate(part.schema) if f.name != name]
    return pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), column], [*(part.schema.names[k] for k in keep), name])


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array of ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        pool = WordPool(v.encode)
        for part, texts in slices(batches, text):
            yield _with(part, ids, _lists(*pool.texts([v.split(x) for x in texts])))

    return docs.mapInArrow(run, _schema(docs, ids, T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                col = part.column(part.schema.get_field_index(ids))
                counts = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield _with(part, decoded, pa.array(v.decode(flat, counts), pa.string()))

    return rows.mapInArrow(run, _schema(rows, decoded, T.StringType()))
