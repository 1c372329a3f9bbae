"""Substring dedup by level-wise doubling of repeated word windows.

A window of ``target`` words can only repeat if the windows inside it repeat. Short windows come
first, and only at anchors: of the short windows at the beginning of each target window the one with
the lowest hash, which equal target windows share. Anchors whose window repeats are extended to twice
the length and compared again, level by level, until none is left or the target is reached; there
the target windows of each anchor that is left are compared, and those that repeat are removed with
all words they cover. By default the levels are 9, 18 and 35 words.

Scale: each task first looks for repeats among the texts it has met so far. What repeats there is
settled; one row of it, and one more if it was single in an earlier unit, tell the other tasks. So a
hot window crosses the shuffle at most three times per task, however many copies there are, and no
pair is ever made. A level is one shuffle of hashes; no text is shuffled, as the anchors that are
left go back to the tasks of their texts (``sidecar``). The last level compares 95 bits. A level
whose anchors all are single ends the work.

Defined cases: a null text has no words, an empty one neither; texts shorter than a window lose
nothing; a null id stays null; repeated rows are windows of their own, so both lose what they share;
runs of one word repeat with themselves; input columns of any name are carried along, and those
called like the two counts are replaced; the input must be a stored table or otherwise give each
task the same rows when read again, else an error is raised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard
from .shingles import WordHashes, mix, runs, words
from .sidecar import Beside, Places, put
from .words import slices

TARGET = 35
START = 9
UNIT_CHARS = 2_500_000
#: A span in one number: first word, words, and whether it is known to repeat.
SPAN = "part long, more int, row long, span long"
#: Row number of what only tells that a hash occurs.
NOWHERE = -1


def levels(target: int = TARGET, start: int | None = None) -> list[int]:
    """Window lengths, doubling up to the target."""
    out = [min(start or START, target)]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


def pack(first: np.ndarray, n: np.ndarray | int, known: np.ndarray | bool) -> np.ndarray:
    return (first.astype(np.int64) << 32) | (np.asarray(n, np.int64) << 1) | np.asarray(known, np.int64)


def unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return span >> 32, (span & 0xFFFFFFFF) >> 1


def _rows(part: np.ndarray, more: np.ndarray, row: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array((more >> np.uint64(33)).astype(np.int32)), pa.array(row), pa.array(span)], ["part", "more", "row", "span"])


class Settler:
    """Tells the windows of a task apart: single ones so far, and repeated ones.

    ``merge``: repeated windows that follow one another become one span."""

    def __init__(self, merge: bool):
        self.merge = merge
        self.seen, self.told = np.zeros(0, np.uint64), np.zeros(0, bool)

    def settle(self, h: np.ndarray, more: np.ndarray, row: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        """Rows for the windows of a unit: one for each hash that is new to the task, marked if it repeats
        in the unit; one that goes nowhere for a hash that was single and now repeats; and the settled
        ones, under keys of their places."""
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.append(True, s[1:] != s[:-1])[: len(s)]
        lead, again = order[new], np.append(~new[1:], False)[: len(s)][new]
        at = np.searchsorted(self.seen, h[lead])
        old = self.seen[np.minimum(at, len(self.seen) - 1)] == h[lead] if len(self.seen) else np.zeros(len(lead), bool)
        tell = lead[old][~self.told[at[old]]]
        self.told[at[old]] = True
        rest = np.sort(np.concatenate([order[~new], lead[old]]))
        lead, again, at = lead[~old], again[~old], at[~old]
        self.seen, self.told = np.insert(self.seen, at, h[lead]), np.insert(self.told, at, again)
        r, f, n = row[rest], first[rest], np.ones(len(rest), np.int64)
        if self.merge and len(rest):
            cut = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (f[1:] != f[:-1] + 1)))
            r, f, n = r[cut], f[cut], np.diff(np.append(cut, len(rest)))
        # settled rows need no key; a few hundred places share one, which packs well
        own = mix(r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (f >> 8).astype(np.uint64))
        nowhere = np.full(len(tell), NOWHERE)
        return _rows(
            np.concatenate([h[lead], h[tell], own]), np.concatenate([more[lead], more[tell], np.zeros(len(own), np.uint64)]), np.concatenate([row[lead], nowhere, r]),
            np.concatenate([pack(first[lead], 1, again), np.zeros(len(tell), np.int64), pack(f, n, True)]),
        )


def _end(places: Places) -> pa.RecordBatch:
    """The end mark of a task, known to repeat so that it stays."""
    own = mix(np.array([places.next], np.uint64))
    return _rows(own, own, np.array([places.next]), np.array([1]))


def anchors(hashes: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Places of the lowest of each k hashes in turn, the first among equals, where ``ok``.

    ``ok[p]``: the places p to p + k - 1 belong to one text."""
    n = len(ok)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, k):
        less = hashes[j : j + n] < best
        best[less] = hashes[j : j + n][less]
        at[less] = np.arange(j, j + n)[less]
    return np.where(ok, at, -1)


class Unit:
    """The words of some texts, end to end."""

    def __init__(self, texts: list[str], rows: np.ndarray, hashes: WordHashes):
        self.h, counts = hashes.of([words(x) for x in texts])
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.begin = np.cumsum(counts) - counts
        self.rows = rows

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each place on, and whether they are of one text."""
        h = runs(self.h, n)
        return h, self.text[: len(h)] == self.text[n - 1 :][: len(h)]

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row number and word number of each place."""
        text = self.text[place]
        return self.rows[text], place - self.begin[text]


def _first(docs: DataFrame, text: str, length: int, k: int, target: int) -> DataFrame:
    """Rows of the first level: windows of ``length`` words at the anchors of all target windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places, settler = WordHashes(), Places(), Settler(length == target)
        for part, texts in slices(batches, text, UNIT_CHARS):
            unit = Unit(texts, places.take(part.num_rows), hashes)
            _, ok = unit.windows(target)
            if ok.any():
                h, _ = unit.windows(length)
                place = np.unique(anchors(h, ok, k))
                place = place[place >= 0]
                yield settler.settle(h[place], _more(unit, place, length, target), *unit.of(place))
        yield _end(places)

    return docs.select(text).mapInArrow(run, SPAN)


def _more(unit: Unit, place: np.ndarray, length: int, target: int) -> np.ndarray:
    """More bits of windows of the last level; earlier ones go without, as the next level looks again."""
    return runs(mix(unit.h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), target)[place] if length == target else np.zeros(len(place), np.uint64)


def _next(docs: DataFrame, text: str, length: int, k: int, target: int, first: int, left: str) -> DataFrame:
    """Rows of a later level, at the anchors of the side table ``left`` that the last level made.

    The last level takes every target window whose anchor is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places, settler = WordHashes(), Places(), Settler(length == target)
        beside = Beside(left, places)
        spans = beside.table["span"].to_numpy() if beside.table is not None else None
        for part, texts in slices(batches, text, UNIT_CHARS):
            rows = places.take(part.num_rows)
            lo, hi = beside.of(rows)
            if lo == hi:
                continue
            # texts without an anchor have nothing to extend
            some = np.unique(beside.row[lo:hi])
            unit = Unit([texts[k] for k in (some - rows[0]).tolist()], some, hashes)
            held = unit.begin[np.searchsorted(some, beside.row[lo:hi])] + unpack(spans[lo:hi])[0]
            h, ok = unit.windows(length)
            if length < target:
                place = np.sort(held)
            else:
                left_over = np.zeros(len(unit.h) + 1, bool)
                left_over[held] = True
                place = np.flatnonzero(left_over[anchors(unit.windows(first)[0], ok, k)])
            yield settler.settle(h[place], _more(unit, place, length, target), *unit.of(place))
        beside.close()
        yield _end(places)

    return docs.select(text).mapInArrow(run, SPAN)


def _repeated(rows: DataFrame, name: str) -> str:
    """The side table of the spans whose hash occurs twice or more in all.

    A hash has three rows per task at most, so no key grows with the number of its copies."""
    n = F.sum(F.lit(1) + F.col("span").bitwiseAND(F.lit(1).cast("long"))).over(Window.partitionBy("part", "more"))
    left = rows.withColumn("n", n).where((F.col("n") >= 2) & (F.col("row") != NOWHERE))
    return put(left.select("row", "span"), name)


def repeated(docs: DataFrame, text: str = "text", target: int = TARGET, start: int | None = None) -> str:
    """Side table (row, span) of the starts of windows that also start elsewhere."""
    steps = levels(target, start)
    # the anchors of a target window are places whose windows of the last level before it lie inside
    k = target - (steps[-2] if len(steps) > 1 else target) + 1
    left = _repeated(_first(docs, text, steps[0], k, target), "anchors")
    for length in steps[1:]:
        # the end marks alone have an empty span: no candidate survives
        if docs.sparkSession.read.schema("row long, span long").parquet(left).where("span > 1").isEmpty():
            break
        before, left = left, _repeated(_next(docs, text, length, k, target, steps[0], left), "anchors")
        discard(before)
    return left


def cut(docs: DataFrame, text: str = "text", target: int = TARGET, start: int | None = None, n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """The documents without the words of repeated windows, with the numbers of words and of words removed.

    Where something is removed, the words left are joined by single blanks; other texts stay as they are."""
    left = repeated(docs, text, target, start)
    schema = T.StructType([*(f for f in docs.schema if f.name not in (n_words, n_removed)), T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        beside = Beside(left, places)
        spans = beside.table["span"].to_numpy() if beside.table is not None else None
        for part, texts in slices(batches, text):
            rows = places.take(part.num_rows)
            bounds = np.searchsorted(beside.row, np.append(rows, rows[-1] + 1)).tolist()
            null = part.column(part.schema.get_field_index(text)).is_null().to_pylist()
            out, total, gone = [], [], []
            for k, x in enumerate(texts):
                own = words(x)
                total.append(len(own))
                lo, hi = bounds[k], bounds[k + 1]
                if lo == hi:
                    gone.append(0)
                    out.append(None if null[k] else x)
                    continue
                first, n = unpack(spans[lo:hi])
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + n - 1 + target, -1)
                keep = np.cumsum(edge)[:-1] == 0
                gone.append(int(len(own) - keep.sum()))
                out.append(b" ".join([own[i] for i in np.flatnonzero(keep).tolist()]).decode())
            cols = {f.name: part.column(i) for i, f in enumerate(part.schema)} | {text: pa.array(out, pa.string()), n_words: pa.array(total, pa.int64()), n_removed: pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], schema.names)
        beside.close()

    return docs.mapInArrow(run, schema)
