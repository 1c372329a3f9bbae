"""Functions of whole fields, over square tiles that know the cells about them.

A field is dealt into tiles of a fixed side, each with the rows within ``halo`` cells of it, so there is
one shuffle of little more than the rows. A task holds one tile at a time as dense arrays, whatever the
size of the field, and many small fields share a batch. What a function gives must not depend on cells
further away than the halo; then neither do results on how the field was cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a tile's side.
SIDE = 256


@dataclass
class Tile:
    """Dense arrays by name, NaN where a value is missing or has no row; the keys; i and j of the first row and column."""

    values: dict[str, np.ndarray]
    keys: dict[str, object]
    top: int
    left: int


def over_tiles(field: DataFrame, keys: Sequence[str], halo: int, values: dict[str, Column], f: Callable[[Tile], dict[str, np.ndarray]], out: Sequence[str], side: int | None = None) -> DataFrame:
    """keys, i, j and the arrays ``out`` that ``f`` makes of each tile, at the cells that have a row; NaN is missing."""
    size, keys, names = side or SIDE, list(keys), list(values)
    rows = field.select(*keys, "i", "j", *[v.cast("double").alias(f"of_{n}") for n, v in values.items()])
    for axis in ("i", "j"):
        reach = [F.floor((F.col(axis) + o) / size) for o in (-halo, halo)]
        rows = rows.withColumn(f"tile_{axis}", F.explode(F.sequence(*reach)))
    schema = T.StructType([*(s for k in (*keys, "i", "j") for s in field.schema if s.name == k), *(T.StructField(n, T.DoubleType()) for n in out)])
    group = [*keys, "tile_i", "tile_j"]

    def answer(table: pa.Table) -> pa.RecordBatch | None:
        """The rows of one tile of one field."""
        i, j = (table[c].to_numpy().astype(np.int64) for c in "ij")
        own = np.flatnonzero((i // size == table["tile_i"][0].as_py()) & (j // size == table["tile_j"][0].as_py()))
        if not len(own):
            return None
        y, x = i - i.min(), j - j.min()
        dense = {}
        for n in names:
            dense[n] = np.full((y.max() + 1, x.max() + 1), np.nan)
            dense[n][y, x] = table[f"of_{n}"].to_numpy(zero_copy_only=False)
        found = f(Tile(dense, {k: table[k][0].as_py() for k in keys}, int(i.min()), int(j.min())))
        own = own[np.unique(y[own] * (x.max() + 1) + x[own], return_index=True)[1]]
        part = table.select([*keys, "i", "j"]).take(pa.array(own))
        arrays = [c.combine_chunks() for c in part.columns]
        for n in out:
            v = np.asarray(found[n], float)[y[own], x[own]]
            arrays.append(pa.array(v, pa.float64(), mask=np.isnan(v)))
        return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, group)
            if held and _same(held[-1], batch, group):
                starts = starts[1:]
            elif held:
                done.append(answer(pa.Table.from_batches(held)))
                held = []
            ends = [*starts, batch.num_rows]
            if held or not starts or starts[0] > 0:
                held.append(batch.slice(0, ends[0]))
            for a, b in zip(starts, ends[1:], strict=True):
                if held:
                    done.append(answer(pa.Table.from_batches(held)))
                held = [batch.slice(a, b - a)]
            if sum(d.num_rows for d in done if d is not None) > 50_000:
                yield from _whole(done)
                done = []
        if held:
            done.append(answer(pa.Table.from_batches(held)))
        yield from _whole(done)

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def _starts(batch: pa.RecordBatch, group: Sequence[str]) -> list[int]:
    """Where the groups of a sorted batch begin."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in group:
        codes = batch.column(batch.schema.get_field_index(c)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new).tolist()


def _same(a: pa.RecordBatch, b: pa.RecordBatch, group: Sequence[str]) -> bool:
    """Whether the last row of one batch and the first of the next are of one group."""
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in (a.schema.get_field_index(c) for c in group))


def _whole(parts: list[pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    full = [p for p in parts if p is not None]
    if full:
        yield from pa.Table.from_batches(full).combine_chunks().to_batches()


def corrected(field: DataFrame, f: Callable[[np.ndarray, int], np.ndarray], halo: int = 0, side: int | None = None) -> DataFrame:
    """The field with ``f(values, day)`` of each date's map in place of its values.

    f takes a dense part of the map, NaN where it is missing, with ``halo`` more cells on each side, and
    the day of the year from 0; it gives an array of the same shape."""
    keys = ["dataset", "date", "channel"]

    def of(t: Tile) -> dict[str, np.ndarray]:
        day = t.keys["date"].timetuple().tm_yday - 1
        return {"value": f(t.values["value"], day)}

    return over_tiles(field, keys, halo, {"value": F.col("value")}, of, ["value"], side).select(*field.columns)
