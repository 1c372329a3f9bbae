"""Token counts of whole texts without their ids: each distinct pre-token is counted once.

A byte-level vocabulary merges inside pre-tokens only, so a text has as many tokens as its
pre-tokens have pieces. A first pass gives the distinct pre-tokens of the corpus with their
frequencies, and the pieces of each are counted once, wherever it stands. A second pass takes the
frequencies of pre-tokens in each document, joins the pieces to them and sums.

The join has two ways, whatever the size of the input. Pre-tokens that make up a share of 1 in
``frequent`` of all or more, ``frequent`` of them at most, are broadcast: these are the hot keys,
and most of each text. The others leave the task as rows (document, pre-token, frequency) and meet
their pieces in a join by the pre-token; none of their keys can hold more than that share. Keys have
a bounded length, as pre-tokens over ``KEY`` characters go by their hash. No text is shuffled.

Plain texts are cut into pre-tokens by Arrow, many at once; others, with characters whose class
depends on the version of Unicode or with special tokens, by the published rule.

Defined cases: a null or empty text has no bytes and no tokens; a null id stays null; repeated rows
each get their own row; a special token is one token; only the columns of ``keep`` are carried
along, and a column of theirs called like a result is an error; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ByteBpe, vocabulary
from .common import quoted, written
from .sidecar import Places
from .wordbpe import ODD
from .words import parts

#: Pre-tokens of at least one in so many are broadcast, so there are so many at most.
FREQUENT = 500_000
#: Characters from which a pre-token goes by its hash.
KEY = 64
#: Bytes of text, and words to be merged, held at one time.
BYTES_AT_ONCE, WORDS_AT_ONCE = 4_000_000, 20_000
#: The published split rule over plain characters. Of a run of white space the last
#: one goes with what follows; a NUL, which no plain text holds, marks the end of a pre-token.
RUN = r"([\t\n\r \x{a0}]+)([\t\n\r \x{a0}][^\t\n\r \x{a0}])"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?(?:\p{L}+|\p{N}+|[^\t\n\r \x{a0}\x00\p{L}\p{N}]+)|[\t\n\r \x{a0}]+"
#: Begins keys that are no pre-tokens: of documents' own rows, and hashes of long pre-tokens.
OWN, HASHED = "\x00row ", "\x00sha "


def pretokens(v: ByteBpe, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts; for each occurrence its pre-token and its text."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, ODD) if all(s.startswith("<|") for s in v.special) else pa.array(np.ones(len(texts), bool))
    at = np.arange(len(texts))
    is_odd = odd.to_numpy(zero_copy_only=False).astype(bool)
    cut = pc.replace_substring_regex(texts.filter(pc.invert(odd)), RUN, "\\1\x00\\2")
    lists = pc.split_pattern(pc.replace_substring_regex(cut, WORD, "\\0\x00"), "\x00")
    words, of = lists.flatten(), np.repeat(at[~is_odd], pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    words, of = words.filter(full), of[full.to_numpy(zero_copy_only=False).astype(bool)]
    if is_odd.any():
        split = [v.split(x) for x in texts.filter(odd).to_pylist()]
        words = pa.concat_arrays([words, pa.array(chain.from_iterable(split), pa.string())])
        of = np.append(of, np.repeat(at[is_odd], np.fromiter(map(len, split), np.int64, len(split))))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), of


def keys(words: pa.Array) -> tuple[list[str], list[str | None]]:
    """A key of bounded length for each pre-token; the pre-token itself where the key is a hash."""
    out = words.to_pylist()
    whole: list[str | None] = [None] * len(out)
    for k in np.flatnonzero(pc.greater(pc.utf8_length(words), KEY).to_numpy(zero_copy_only=False)).tolist():
        whole[k], out[k] = out[k], HASHED + hashlib.sha256(out[k].encode()).hexdigest()
    return out, whole


def dictionary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """key, pieces, times: all distinct pre-tokens of the texts."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in parts(batches, text, BYTES_AT_ONCE):
            words, index, _ = pretokens(v, part.column(0))
            if len(words):
                key, whole = keys(words)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(whole, pa.string()), pa.array(np.bincount(index, minlength=len(words)))], ["key", "whole", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in parts(batches, "key"):
            for start in range(0, part.num_rows, WORDS_AT_ONCE):
                own = part.slice(start, WORDS_AT_ONCE)
                words = pc.coalesce(own.column(1), own.column(0)).to_pylist()
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(v.encode(words)[1], pa.int64()), own.column(2)], ["key", "pieces", "times"])

    found = docs.select(text).mapInArrow(collect, "key string, whole string, times long").groupBy("key", "whole").agg(F.sum("times").alias("times"))
    return found.mapInArrow(count, "key string, pieces long, times long")


def frequencies(docs: DataFrame, path: str, known: dict[str, int], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document a row with ``keep``, its bytes, and the pieces of its ``known`` pre-tokens as
    ``times``; for each other pre-token of it a row with its frequency as ``times``."""
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([T.StructField("row", T.LongType()), *(T.StructField(f"k{k}", f.dataType) for k, f in enumerate(kept)), T.StructField("bytes", T.LongType()), T.StructField("key", T.StringType()), T.StructField("times", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, places, pieces_of = vocabulary(path), Places(), shared.value.get
        names = [f.name for f in schema]
        for part in parts(batches, text, BYTES_AT_ONCE):
            row, texts = places.take(part.num_rows), part.column(len(keep))
            words, index, of = pretokens(v, texts)
            key, _ = keys(words)
            pieces = np.fromiter(map(pieces_of, key, repeat(0)), np.int64, len(key))
            pair, times = np.unique(of * max(len(key), 1) + index, return_counts=True)
            of, word = np.divmod(pair, max(len(key), 1))
            told = np.bincount(of, times * pieces[word], part.num_rows).astype(np.int64)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), *part.columns[: len(keep)], size, pa.array([f"{OWN}{x}" for x in row.tolist()], pa.string()), pa.array(told)], names)
            rest = pieces[word] == 0
            of, word, times = of[rest], word[rest], times[rest]
            if len(of):
                none = [pa.nulls(len(of), c.type) for c in (*part.columns[: len(keep)], size)]
                yield pa.RecordBatch.from_arrays([pa.array(row[of]), *none, pa.array(key, pa.string()).take(pa.array(word)), pa.array(times)], names)

    return docs.select(*map(quoted, keep), quoted(text)).toDF(*(f"k{k}" for k in range(len(keep))), text).mapInArrow(run, schema)


def counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), frequent: int = FREQUENT) -> DataFrame:
    """``keep``, n_bytes and n_tokens of each row of ``docs``."""
    if {"n_bytes", "n_tokens"} & {c.lower() for c in keep}:
        raise ValueError("keep holds a name of a result")
    pieces = written(dictionary(docs, path, text), "pretokens")
    total = pieces.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") * frequent >= total
    hot = pieces.where(often).select("key", "pieces").toArrow()  # ``frequent`` rows at most
    known = dict(zip(hot["key"].to_pylist(), hot["pieces"].to_pylist(), strict=True))
    rows = frequencies(docs, path, known, text, keep).join(pieces.where(~often).select("key", "pieces"), "key", "left")
    own = F.startswith("key", F.lit(OWN))
    lost = F.raise_error(F.lit("a pre-token has no pieces: the input changed between two passes")).cast("long")
    n = F.when(own, F.col("times")).otherwise(F.col("times") * F.coalesce("pieces", lost))
    done = rows.groupBy("row").agg(*(F.any_value(f"k{k}", F.lit(True)).alias(f"k{k}") for k in range(len(keep))), F.max("bytes").alias("n_bytes"), F.sum(n).alias("n_tokens"))
    return done.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "n_bytes", "n_tokens")
