"""Hierarchical multi-length packing.

Documents are routed to the shortest context tier that holds them; what exceeds the longest tier is
cut into full windows first. From the longest tier down, each document opens a window of its tier
and the gap is filled from shorter tiers, shortest first, then from its own; a filler that is too
long is cut, its rest going back to the tier of its new length. So every window is exactly as long
as its tier. What no longer fills a window at the end of a task is cut at powers of two.

Scale: packing is local to a task, which holds one unit of about a million tokens; nothing but the
pieces (a few numbers each) leaves it. The pieces are written once; then windows are numbered within
each tier over all tasks from counts per tier and task, and dealt into step groups that differ by at
most one window. A task that runs again makes the same pieces.

Defined cases: a null or empty text is the end id alone; a null id stays null; repeated rows are
packed once each; other input columns, whatever their names, are not carried along."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .wordbpe import vocabulary
from .words import parts

TIERS = (256, 512, 1024, 2048)
END_ID = 1
UNIT = 1_000_000
STEP_TOKENS = 1 << 18


def token_rows(batches: Iterator[pa.RecordBatch], path: str, text: str = "text", end_id: int = END_ID) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with each text's ids, the end id included."""
    encode = vocabulary(path).encode
    for part in parts(batches, text):
        ids = encode(part.column(part.schema.get_field_index(text)))
        yield part, [np.append(x, end_id).astype("<u4") for x in ids]


class Packer:
    """The windows of one task. A piece: document id, start, ids, tokens of the document."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.queues = tiers, {t: deque() for t in tiers}
        self.windows: dict[int, int] = {}
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        rest = n - n % top
        for start in range(0, rest, top):
            self._window(top, [(doc_id, start, ids[start : start + top], n)])
        if rest < n:
            self._route((doc_id, rest, ids[rest:].copy(), n))
            self.held += n - rest

    def _route(self, piece: tuple, first: bool = False) -> None:
        queue = self.queues[next(t for t in self.tiers if t >= len(piece[2]))]
        queue.appendleft(piece) if first else queue.append(piece)

    def _window(self, tier: int, pieces: list[tuple]) -> None:
        number = self.windows[tier] = self.windows.get(tier, -1) + 1
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), n, tier, number, offset))
            offset += len(ids)

    def _take(self, room: int, most: int) -> tuple | None:
        """The next filler of a tier up to ``most``, cut to the room."""
        queue = next((self.queues[t] for t in self.tiers if t <= most and self.queues[t]), None)
        if queue is None:
            return None
        doc_id, start, ids, n = queue.popleft()
        if len(ids) > room:
            self._route((doc_id, start + room, ids[room:], n), first=True)
        return doc_id, start, ids[:room], n

    def pack(self, last: bool = False) -> None:
        left: list[tuple] = []
        for tier in reversed(self.tiers):
            while self.queues[tier]:
                pieces, gap = [self.queues[tier].popleft()], tier
                gap -= len(pieces[0][2])
                while gap and (piece := self._take(gap, tier)):
                    pieces.append(piece)
                    gap -= len(piece[2])
                if gap:
                    left += pieces
                else:
                    self._window(tier, pieces)
        for piece in left:
            self._route(piece)
        self.held = sum(len(p[2]) for p in left)
        while last and self.held:
            room = 1 << (self.held.bit_length() - 1)
            self.held -= room
            pieces, size = [], room
            while room and (piece := self._take(room, self.tiers[-1])):
                pieces.append(piece)
                room -= len(piece[2])
            self._window(size, pieces)


def pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """A row per piece: document, place in it, tier, task, window in the task, and offset there."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = Packer(tiers), TaskContext.get().partitionId()
        id_type = None

        def rows() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True))
            packer.rows = []
            long = [pa.array(c, pa.int64()) for c in cols[1:]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *long, pa.array([task] * len(cols[0]), pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tier", "window", "offset", "task"])

        for part, texts in token_rows(batches, path, text, end_id):
            ids = part.column(part.schema.get_field_index(doc_id))
            id_type = ids.type
            for i, x in zip(ids.to_pylist(), texts, strict=True):
                packer.add(i, x)
            if packer.held >= UNIT:
                packer.pack()
            if packer.rows:
                yield rows()
        packer.pack(last=True)
        if packer.rows:
            yield rows()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, tier long, window long, offset long, task long"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces with ``sequence_id``, ``offset`` and ``step_group``.

    sequence_id: number of the window within its tier, times 64, plus the tier's binary logarithm.
    step_group: windows of one tier dealt into groups of about ``step_tokens`` tokens each."""
    done = written(pieces(docs, path, text, doc_id, tiers, end_id), "pieces")
    each = done.groupBy("tier", "task").agg((F.max("window") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("tier"))).drop("n")
    number = F.col("before") + F.col("window")
    groups = F.ceil(F.col("all") * F.col("tier") / step_tokens)
    return done.join(each, ["tier", "task"]).select(
        F.col("doc_id").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens",
        (number * 64 + F.log2("tier").cast("long")).alias("sequence_id"), "offset", F.col("tier").alias("sequence_tokens"),
        F.floor(number * groups / F.col("all")).cast("long").alias("step_group"),
    )
