"""Training-order materialisation of token ids as binary shards.

Texts are encoded and laid end to end into sequences of a fixed number of ids. A keyed Feistel
permutation, walked until it falls below the number of sequences, gives each sequence its slot in
the training order; no table of the order exists, and any slot can be computed from a sequence's
number and back. Partitions that hold ranges of slots write the shards: each sequence has the same
number of bytes, so a slot's shard and byte offset follow from its number, and a reader resumes at
any slot with one seek.

Scale: a first pass counts sequences per task (one number each; the table of these, 16 bytes per
input task, is what the second pass needs to number its sequences), the second makes and shuffles
the sequences once. A shard is written under a name of its own for each attempt and then moved, so
a task that runs again replaces it with the same bytes. The texts are encoded once more to be counted
rather than stored: ids, shuffle and shards at once would take over three times the input's disk. The
input must be a stored table or otherwise give the same rows when read again; a task that makes more
or fewer sequences than were counted is an error, so no slot is filled twice or left out.

Defined cases: a null or empty text is the end id alone; a null id stays null in ``doc_ids``;
repeated rows are materialised once each; the last sequence of each task is filled up with the pad
id; an empty table gives no shards; other input columns are not carried along."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir
from .shingles import mix
from .words import parts

SEQUENCE = 1024
SHARD = 4096
END_ID = PAD_ID = 50256
DTYPE = np.dtype("<u2")
ROUNDS = 4
#: The published split rule without its look ahead, and two characters in a row that it may matter for.
SHORT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SPACES = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]{2}"


class Order:
    """Permutation of range(n) by a key."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), self.keys, back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], self.keys, back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@lru_cache(2)
def encoding(path: str, pattern: str | None = None):
    """The ranks file as an encoding of ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(path: str, texts: pa.Array) -> Iterator[list[int]]:
    """Ids of each text (null: empty).

    The published split rule looks ahead from runs of white space, which keeps the library from its
    fast matcher. Texts without two white space characters in a row need no such look."""
    texts = pc.fill_null(texts, "")
    runs = pc.match_substring_regex(texts, SPACES)
    whole, short = encoding(path).encode_ordinary, encoding(path, SHORT).encode_ordinary
    for x, far in zip(texts, runs.to_pylist(), strict=True):
        yield (whole if far else short)(x.as_py())


def _counts(docs: DataFrame, path: str, text: str, length: int) -> DataFrame:
    """task, n: ids of each task's texts, in sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in parts(batches, text):
            total += sum(len(x) + 1 for x in encoded(path, part.column(0)))
        if total:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "n": [-(-total // length)]})

    return docs.select(text).mapInArrow(run, "task long, n long")


def _sequences(docs: DataFrame, path: str, text: str, doc_id: str, length: int, spans: dict[int, tuple[int, int]], order: Order, shard: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        start, stop = spans.get(task, (0, 0))
        number = start
        rest, owners = np.zeros(0, DTYPE), []  # ids not yet in a sequence; (document, ids left) behind them

        def cut(ids: np.ndarray, n: int, id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal number
            docs_of = []
            for _ in range(n):
                own, room = [], length
                while room and owners:
                    own.append(owners[0][0])
                    took = min(room, owners[0][1])
                    room -= took
                    owners[0][1] -= took
                    if not owners[0][1]:
                        owners.pop(0)
                docs_of.append((own, length - room))
            numbers = np.arange(number, number + n)
            number += n
            if number > stop:
                raise RuntimeError(f"task {task} makes more than the {stop - start} sequences counted: the input changed between the passes")
            data = [ids[k * length : (k + 1) * length].tobytes() for k in range(n)]
            slot = order.slot(numbers)
            return pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // shard), pa.array(numbers), pa.array([d[1] for d in docs_of], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array([d[0] for d in docs_of], pa.list_(id_type)), pa.array(data, pa.binary())],
                ["slot", "shard", "number", "n_tokens", "ids_crc32", "doc_ids", "ids"],
            )

        id_type = pa.int64()
        for part in parts(batches, text, 1_000_000):
            col = part.column(part.schema.get_field_index(doc_id))
            id_type = col.type
            own = [np.array([*x, END_ID], DTYPE) for x in encoded(path, part.column(part.schema.get_field_index(text)))]
            owners += [[i, len(x)] for i, x in zip(col.to_pylist(), own, strict=True)]
            rest = np.concatenate([rest, *own])
            if n := len(rest) // length:
                yield cut(rest, n, id_type)
                rest = rest[n * length :]
        if len(rest):
            yield cut(np.concatenate([rest, np.full(length - len(rest), PAD_ID, DTYPE)]), 1, id_type)
        if number < stop:
            raise RuntimeError(f"task {task} makes fewer than the {stop - start} sequences counted: the input changed between the passes")

    schema = f"slot long, shard long, number long, n_tokens long, ids_crc32 long, doc_ids array<{kind}>, ids binary"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def materialise(docs: DataFrame, path: str, folder: str | None = None, text: str = "text", doc_id: str = "doc_id", length: int = SEQUENCE, shard: int = SHARD, key: int = 2024, partitions: int = 4096) -> DataFrame:
    """Write the shards when the result is computed; a row per sequence says where it is.

    slot, shard, byte_offset, number (before the permutation), n_tokens (without padding),
    ids_crc32, doc_ids (documents with ids in it, in order), path."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    counts = sorted(tuple(r) for r in _counts(docs, path, text, length).collect())  # a row per input task
    spans, total = {}, 0
    for task, n in counts:
        spans[task] = total, total + n
        total += n
    order, shards = Order(total, key), -(-total // shard)
    rows = _sequences(docs, path, text, doc_id, length, spans, order, shard)
    ranges = max(1, min(partitions, shards))
    dealt = rows.repartitionById(ranges, F.floor(F.col("shard") * ranges / max(shards, 1)).cast("int")).sortWithinPartitions("slot")
    stride = length * DTYPE.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        attempt = TaskContext.get().taskAttemptId()
        out, now = None, None

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{base}/.{now}-{attempt}", shard_name(base, now))

        for batch in batches:
            number = batch.column(1).to_pylist()
            data = batch.column(6)
            for k, s in enumerate(number):
                if s != now:
                    close()
                    out, now = store.open_output_stream(f"{base}/.{s}-{attempt}"), s
                out.write(data[k].as_py())
            offset = pa.array([(x % shard) * stride for x in batch.column(0).to_pylist()], pa.int64())
            names = pa.array([shard_name(folder, s) for s in number])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), offset, *(batch.column(k) for k in (2, 3, 4, 5)), names], ["slot", "shard", "byte_offset", "number", "n_tokens", "ids_crc32", "doc_ids", "path"])
        close()

    kind = docs.schema[doc_id].dataType.simpleString()
    return dealt.mapInArrow(write, f"slot long, shard long, byte_offset long, number long, n_tokens long, ids_crc32 long, doc_ids array<{kind}>, path string")


def read(folder: str, start: int = 0, length: int = SEQUENCE, shard: int = SHARD) -> Iterator[np.ndarray]:
    """The sequences in training order from slot ``start`` on."""
    store, base = fs.FileSystem.from_uri(folder)
    stride = length * DTYPE.itemsize
    number, offset = start // shard, start % shard * stride
    while store.get_file_info(shard_name(base, number)).type == fs.FileType.File:
        with store.open_input_file(shard_name(base, number)) as f:
            f.seek(offset)
            while data := f.read(stride):
                yield np.frombuffer(data, DTYPE)
        number, offset = number + 1, 0
