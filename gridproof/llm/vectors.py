"""Embedding near-duplicates: all pairs by cosine, in tiles over principal components.

Equal vectors are one class. Unit vectors are turned into the axes of their second moments, largest
first, so the leading components hold most of a product. Vectors are dealt into cells by the signs
of their leading components about the median, and cells into tiles of bounded size. Pairs of tiles
whose boxes of leading components are further apart than the threshold allows are never made; in
the others products are accumulated over growing numbers of components, and a pair stops as soon as
the product so far and that of the lengths of what remains cannot reach the threshold. Pairs that
reach it are measured again on the vectors as given, in double precision. The search is exact.

Scale: tiles meet through an equality join on strips of the first component as wide as the
threshold allows, so work grows with pairs of near tiles. How many are near depends on the vectors:
where a few components hold most of the moments, most pairs of tiles fall away; where all components
hold as much, none does, and an exact search compares all pairs in their first components. A vector
is sent once for each tile that its own meets, so tiles are large. Within a pair of tiles links are
counted in the task, and what leaves it is a row per linked vector: its number of links and one link
of a spanning forest. No pair of a group of copies is written.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those
with a null id, are linked with nothing; vectors of different lengths are not compared; rows that
share an id are told apart by their vectors, and repeated rows are links of each other; other input
columns are not carried along."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

THRESHOLD = 0.9
#: Vectors of a tile at most, and about their numbers at most.
TILE, TILE_NUMBERS = 4000, 1 << 20
STEPS = (8, 16, 32)
#: Leading components that cells are cut along, one bit each, and those that tiles have boxes in.
AXES, LEAD = 16, 8
SLACK = 1e-6


def keyed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, key (digest of the vector; null if it can't be compared), and the vector as doubles."""
    kind = vectors.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array([math.nan if c is None else c for c in v], float) if v and i is not None else np.zeros(1)
                good = np.isfinite(x).all() and x.any() and np.isfinite(norm := float(np.sqrt(x @ x))) and norm > 0
                keys.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()) if good else None)
                rows.append(x.tolist() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.float64()))], ["id", "key", "vector"])

    return vectors.select(vec_id, embedding).mapInArrow(run, f"id {kind}, key binary, vector array<double>")


def unit(rows: pa.Array) -> np.ndarray:
    x = rows.flatten().to_numpy().reshape(len(rows), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors: the axes of their second moments over all rows, largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            size = np.array([len(v) for v in batch.column(0)])
            for d in np.unique(size).tolist():
                x = unit(batch.column(0).filter(pa.array(size == d)))
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            at = np.arange(d * d)
            yield pa.RecordBatch.from_pydict({"d": np.full(d * d, d), "at": at, "m": m.ravel()})

    sums = classes.select("vector").mapInArrow(run, "d long, at long, m double").groupBy("d", "at").agg(F.sum("m").alias("m"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # length squared numbers for each length of vectors
        out.setdefault(r.d, np.zeros(r.d * r.d))[r["at"]] = r.m
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in out.items()}


def _leading(classes: DataFrame, turn: dict[int, np.ndarray]) -> DataFrame:
    """The classes with their length and leading components ``c0``, ``c1``, ..."""
    kind = classes.schema["id"].dataType.simpleString()
    names = [f"c{k}" for k in range(AXES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v) for v in batch.column(2)])
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                c = unit(part.column(2)) @ turn[d][:, : len(names)]
                c = np.pad(c, ((0, 0), (0, len(names) - c.shape[1])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(c), d)), *(pa.array(c[:, k].copy()) for k in range(len(names)))], ["id", "n", "vector", "d", *names])

    return classes.select("id", "n", "vector").mapInArrow(run, f"id {kind}, n long, vector array<double>, d long, " + ", ".join(f"{c} double" for c in names))


def tiled(classes: DataFrame, turn: dict[int, np.ndarray]) -> DataFrame:
    """The classes with ``tile``: length of vectors, cell, and part of the cell."""
    lead = written(_leading(classes, turn), "leading")
    bits = min(AXES, max(0, math.ceil(math.log2(max(lead.count(), 1) / TILE))))
    names = [f"c{k}" for k in range(bits)]
    medians = lead.approxQuantile(names, [0.5], 0.02) if bits else []
    cell = F.lit(0)
    for k, (c, m) in enumerate(zip(names, medians, strict=True)):
        cell = cell + F.when(F.col(c) > m[0], 1 << k).otherwise(0)
    lead = lead.withColumn("cell", cell)
    sizes = lead.groupBy("d", "cell").agg(F.ceil(F.greatest(F.count("*") / TILE, F.count("*") * F.col("d") / TILE_NUMBERS)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    return written(lead.join(sizes, ["d", "cell"]).withColumn("tile", F.concat_ws("-", "d", "cell", part)).drop("cell", "parts"), "tiles")


def tile_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """low, high: pairs of tiles that may hold a link, each once, a tile with itself included."""
    reach = math.sqrt(2 - 2 * threshold) + SLACK
    edges = [f(c).alias(f"{n}{c}") for c in (f"c{k}" for k in range(LEAD)) for f, n in ((F.min, "min_"), (F.max, "max_"))]
    boxes = written(rows.groupBy("d", "tile").agg(*edges), "boxes")
    strip = lambda c: F.floor(F.col(c) / reach)
    a = boxes.withColumn("strip", F.explode(F.sequence(strip("min_c0"), strip("max_c0"))))
    b = boxes.withColumn("strip", F.explode(F.sequence(strip("min_c0") - 1, strip("max_c0") + 1)))
    b = b.select("d", "strip", *[F.col(c).alias(f"{c}_") for c in b.columns if c not in ("d", "strip")])
    away = F.lit(0.0)
    for k in range(LEAD):
        gap = F.greatest(F.col(f"min_c{k}") - F.col(f"max_c{k}_"), F.col(f"min_c{k}_") - F.col(f"max_c{k}"), F.lit(0.0))
        away = away + gap * gap
    near = a.join(b, ["d", "strip"]).where((F.col("tile") <= F.col("tile_")) & (away <= reach * reach))
    return near.select(F.col("tile").alias("low"), F.col("tile_").alias("high")).distinct()


def link(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; a label is the least member of a set, in place."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def compare(x: np.ndarray, raw: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (row of left, row of right) whose cosine reaches the threshold.

    x: unit vectors in the turned axes; raw: the vectors as given."""
    d = x.shape[1]
    steps = [s for s in STEPS if s < d]
    cuts = [0, *steps, d]
    rest = {s: np.sqrt(np.maximum((x[:, s:] ** 2).sum(axis=1), 0)) for s in steps}
    norm = np.sqrt((raw * raw).sum(axis=1))
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        first = cuts[1]
        so_far = x[rows, :first] @ x[right, :first].T
        may = so_far + (np.outer(rest[first][rows], rest[first][right]) if first in rest else 0) >= threshold - SLACK
        i, j = np.nonzero(may)
        product = so_far[i, j]
        i, j = rows[i], right[j]
        for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
            product = product + np.einsum("ij,ij->i", x[i, a:b], x[j, a:b])
            keep = product + (rest[b][i] * rest[b][j] if b in rest else 0) >= threshold - SLACK
            i, j, product = i[keep], j[keep], product[keep]
        exact = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j])
        hit = (exact >= threshold) & (i != j)
        yield i[hit], j[hit]


def linked(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, links (vectors of other classes linked with it), head: a row per class and pair of tiles with links.

    ``classes``: id, n (vectors of the class), vector. The rows (id, head) span the components."""
    turn = axes(classes)
    rows = tiled(classes, turn)
    pairs = written(tile_pairs(rows, threshold), "tile-pairs")
    kind = classes.schema["id"].dataType.simpleString()
    rows = rows.select("tile", "id", "n", "vector")
    both = pairs.join(rows, F.col("low") == F.col("tile")).unionByName(pairs.where("low <> high").join(rows, F.col("high") == F.col("tile")))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile = np.array(table["tile"].to_pylist())
        left, right = np.flatnonzero(tile == table["low"][0].as_py()), np.flatnonzero(tile == table["high"][0].as_py())
        vectors = table["vector"].combine_chunks()
        raw = vectors.flatten().to_numpy().reshape(len(tile), -1)
        x = unit(vectors) @ turn[raw.shape[1]]
        n, ids = table["n"].to_numpy().astype(float), table["id"]
        links, label = np.zeros(len(tile)), np.arange(len(tile))
        same = table["low"][0].as_py() == table["high"][0].as_py()
        for i, j in compare(x, raw, left, right, threshold):
            links += np.bincount(i, n[j], len(tile))
            if not same:
                links += np.bincount(j, n[i], len(tile))
            link(label, i, j)
        some = np.flatnonzero(links)
        return pa.table({"id": ids.take(pa.array(some)), "links": pa.array(links[some].astype(np.int64)), "head": ids.take(pa.array(label[some]))})

    return both.groupBy("low", "high").applyInArrow(run, f"id {kind}, links long, head {kind}")


def groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_links, component_id (least id reachable; null ids: null), kept."""
    book = written(keyed(vectors, vec_id, embedding), "vectors")
    classes = book.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    # rows of one id with different vectors are different nodes, so a node has both; the id comes first
    named = classes.select("key", F.col("id").alias("vec"), F.struct("id", "key").alias("id"), "n", "vector")
    named = written(named, "vector-classes")
    found = written(linked(named.select("id", "n", "vector"), threshold), "vector-links")
    roots = components(found.select(F.col("id").alias("a"), F.col("head").alias("b")))
    per = found.groupBy("id").agg(F.sum("links").alias("links"))
    leads = named.select(F.col("id").alias("root"), F.col("vec").alias("lead"))
    known = named.select("id", "key", "n", "vec").join(per, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").join(leads, "root", "left")
    known = known.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lead", "vec").alias("lead"))
    known = written(known, "vector-roots")
    rows = book.select("id", "key").join(known, "key", "left")
    component = F.coalesce("lead", "id")
    return rows.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
