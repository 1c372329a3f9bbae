"""Near-duplicates by b-bit MinHash over word shingles.

1. One pass over the texts: the set of shingles, its minima under 128 hash functions, 32 band keys of
   four minima each, and a signature that keeps two low bits of each minimum.
2. Texts with equal shingle sequences are one class, named by its least id. Classes that share a band
   key are candidates. A candidate pair is estimated from its signatures: equal two-bit lanes are
   counted by bit counts and corrected for the lanes that are equal by chance (one in four).
3. Candidates that may reach the threshold are confirmed on their full sets, and the links so found
   give components, in two rounds: first each member of a band with the band's least class; then, in
   bands that still hold several components, all pairs across components are estimated, in tiles of
   bounded size. A tile returns a forest over the members that may be linked; the trees of all bands
   join to clusters, and within a cluster each pair is confirmed once, in tiles again. Links within a
   component can change nothing, so none is lost that matters: the components are those of all
   candidates.

A pair of similarity 0.75 shares no band with a chance of 5e-6, and fails the estimate with one of
3e-6.

Scale: hot classes collapse before anything is joined; band keys cross the shuffle as two numbers; a
tile holds a bounded number of members and of shingles and returns a row per member at most, so no
pair is written. Only the texts of candidates leave their task, once (``sidecar``); they are shuffled
once for each head they are confirmed with, and once for each pair of tiles of their cluster that has their own. Clusters of very many tiles
are confirmed by band instead, so that no text meets all others of a large cluster. The members of a
class with very many candidates are dealt into 256 groups, each with its own copy of that one text.

Defined cases: null or empty texts and those without words have no shingles and are linked with
nothing; null ids are linked with nothing and kept; rows that share an id are one node, whatever
their texts; repeated rows are each returned; other input columns are not carried along by
``groups``, and all of them, whatever their names, by ``representatives``; the input must be a stored
table or otherwise give each task the same rows when read again, else an error is raised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import components
from .shingles import WordHashes, mix, runs, words
from .sidecar import Places, chosen, ends, put
from .vectors import link
from .words import give_back, slices

WORDS = 5
HASHES, BANDS, LANE_BITS = 128, 32, 2
SIGNATURE = [f"s{k}" for k in range(HASHES * LANE_BITS // 64)]
#: Equal lanes below which a pair of similarity 0.75 falls with a chance of 3e-6: 104 - 4.5 * 4.4.
LEAST_LANES = 84
PERCENT = 75
#: Members of a tile at most, and about their shingles at most.
TILE, TILE_SHINGLES = 250, 2_000_000
#: Tiles from which a cluster is confirmed by band.
MANY_TILES = 32
GROUPS = 256


def shingle_sets(texts: list[str], hashes: WordHashes, n: int = WORDS) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """Of each text: its sorted distinct shingles, and a digest of its words (no words: None)."""
    split = [words(x, lower=True) for x in texts]
    h, counts = hashes.of(split)
    r = runs(h, n)
    for own, c, end in zip(split, counts.tolist(), np.cumsum(counts).tolist(), strict=True):
        if not c:
            yield np.zeros(0, np.uint64), None
            continue
        key = xxhash.xxh3_128_digest(b" ".join(own))
        # a text shorter than a shingle is one by itself, of a length that no shingle has
        yield np.unique(r[end - c : end - n + 1]) if c >= n else mix(runs(h[end - c : end], c) + np.uint64(c)), key


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1 << 63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1 << 63, size=HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parts = [((shingles[k : k + 1024, None] ^ b) * a).min(axis=0) for k in range(0, len(shingles), 1024)]
    return np.minimum.reduce(parts)


def signed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = WORDS) -> DataFrame:
    """row (number of the row), id, key (digest of the words), n_shingles, bands, and the signature's numbers."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places, (a, b) = WordHashes(), Places(), _multipliers()
        shift = np.arange(0, 64, LANE_BITS, dtype=np.uint64)
        number = np.arange(BANDS, dtype=np.uint64)
        for part, texts in slices(batches, text):
            keys, sizes, bands, lanes = [], [], [], []
            for s, key in shingle_sets(texts, hashes, n):
                keys.append(key)
                sizes.append(len(s))
                if not len(s):
                    bands.append([])
                    lanes.append(np.zeros(len(SIGNATURE), np.int64))
                    continue
                m = minima(s, a, b)
                band = number
                for col in m.reshape(BANDS, -1).T:
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + col)
                bands.append(band.view(np.int64))
                low = (m >> np.uint64(20)) & np.uint64((1 << LANE_BITS) - 1)
                lanes.append((low.reshape(len(SIGNATURE), -1) << shift).sum(axis=1, dtype=np.uint64).view(np.int64))
            sig = np.array(lanes)
            cols = [pa.array(places.take(part.num_rows)), part.column(part.schema.get_field_index(doc_id)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(sig[:, k]) for k in range(len(SIGNATURE)))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "id", "key", "n_shingles", "bands", *SIGNATURE])

    return docs.select(doc_id, text).mapInArrow(run, f"row long, id {kind}, key binary, n_shingles long, bands array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE))


def equal_lanes(left: str, right: str) -> Column:
    """Lanes that are equal in two structs of signatures."""
    ones = sum(1 << k for k in range(0, 64, LANE_BITS)) & ((1 << 63) - 1)
    out = F.lit(HASHES)
    for s in SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        out = out - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones).cast("long")))
    return out


def similarity(lanes: Column) -> Column:
    """Estimated similarity, corrected for lanes that are equal by chance."""
    chance = 0.5**LANE_BITS
    return (lanes / HASHES - chance) / (1 - chance)


def _check(percent: int) -> None:
    """Bands and least lanes are made for PERCENT: below it most pairs would be lost unseen."""
    if percent < PERCENT:
        raise ValueError(f"percent={percent}: the bands and the estimate are made for {PERCENT} or more")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """Of pairs (a, b) of ids, those whose full shingle sets reach the threshold. ``texts``: id, text."""
    group = F.pmod(F.xxhash64("b"), F.lit(GROUPS)).cast("int")
    members = pairs.select("a", group.alias("g"), "b").join(texts.withColumnRenamed("id", "b"), "b").select("a", "g", F.lit(1).alias("member"), "b", "text")
    heads = pairs.select("a", group.alias("g")).distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "g", F.lit(0).alias("member"), F.col("a").alias("b"), "text")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, heads = WordHashes(), None, {}
        for part, texts in slices(batches):
            a, b = [], []
            names = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("a", "g", "member", "b")]
            for (x, g, member, y), (s, key) in zip(zip(*names, strict=True), shingle_sets(texts, hashes, n), strict=True):
                if (x, g) != now:
                    now, heads = (x, g), {}
                if not member:
                    heads[key] = s
                    continue
                for head in heads.values():
                    common = len(np.intersect1d(head, s, assume_unique=True))
                    if common and 100 * common >= percent * (len(head) + len(s) - common):
                        a.append(x)
                        b.append(y)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, part.column(0).type), pa.array(b, part.column(0).type)], ["a", "b"])

    dealt = heads.unionByName(members).repartition("a", "g").sortWithinPartitions("a", "g", "member")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _estimates(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Rows of the two tiles of a group, and for blocks of the first which pairs may reach the threshold.

    Pairs within a component or of one id are left out."""
    ids, tile = table["id"].to_numpy(), table["tile"].to_numpy()
    sig = np.stack([table[s].to_numpy() for s in SIGNATURE], axis=1).view(np.uint64)
    root = table["root"].to_numpy()
    left, right = np.flatnonzero(tile == table["low"][0].as_py()), np.flatnonzero(tile == table["high"][0].as_py())
    ones = np.uint64(sum(1 << k for k in range(0, 64, LANE_BITS)))

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(left), 100):
            rows = left[at : at + 100]
            x = sig[rows][:, None, :] ^ sig[right][None, :, :]
            lanes = HASHES - np.bitwise_count((x | (x >> np.uint64(1))) & ones).sum(axis=2, dtype=np.int64)
            yield rows, (lanes >= LEAST_LANES) & (root[rows][:, None] != root[right][None, :]) & (ids[rows][:, None] != ids[right][None, :])

    return left, right, blocks()


def _forest(table: pa.Table) -> pa.Table:
    """For each member of a group in a pair that may reach the threshold: itself and the head of its tree."""
    _, right, blocks = _estimates(table)
    some, label = np.zeros(table.num_rows, bool), np.arange(table.num_rows)
    for rows, hit in blocks:
        i, j = np.nonzero(hit)
        some[rows[i]] = some[right[j]] = True
        link(label, rows[i], right[j])
    at = np.flatnonzero(some)
    ids = table["id"].combine_chunks()
    return pa.table({"a": ids.take(pa.array(at)), "b": ids.take(pa.array(label[at]))})


def _tiles(sizes: DataFrame) -> Column:
    """Tiles for ``n`` members of ``shingles`` shingles in all."""
    return F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")


def _dealt(members: DataFrame, group: str) -> DataFrame:
    """Members with ``tiles``, dealt to each pair of tiles (low, high) of their group that has their own."""
    out = members.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return out.select(F.col(group).alias("group"), F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "id", "root", *SIGNATURE)


def _exact(table: pa.Table, percent: int, n: int) -> pa.Table:
    """Confirmed links of a group that join different components, as many as join them."""
    table = table.combine_chunks()
    ids = table["id"].to_numpy()
    _, comp = np.unique(table["root"].to_numpy(), return_inverse=True)
    hashes = WordHashes()
    # a few texts at a time, as words take many times the room of their set
    sets = [s for _, texts in slices(iter(table.select(["text"]).to_batches())) for s, _ in shingle_sets(texts, hashes, n)]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, right, blocks = _estimates(table)
    a, b = [], []
    for rows, hit in blocks:
        for i, mask in zip(rows.tolist(), hit, strict=True):
            j = right[mask]
            # sets whose sizes differ too much can't be similar enough
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
            if not len(j):
                continue
            flat = np.concatenate([sets[k] for k in j.tolist()])
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            common = np.add.reduceat(sets[i][at] == flat, np.cumsum(size[j]) - size[j], dtype=np.int64)
            j = j[100 * common >= percent * (size[i] + size[j] - common)]
            _, first = np.unique(comp[j], return_index=True)
            a += [ids[i]] * len(first)
            b += ids[j[first]].tolist()
            comp[np.isin(comp, comp[j])] = comp[i]
    kind = table.schema.field("id").type
    out = pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})
    del sets, table
    give_back()
    return out


def _across(members: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Confirmed links (a, b) between different components of a band.

    ``members``: band, id, root, size (shingles) and signature; ``texts``: id, text."""
    kind = members.schema["id"].dataType.simpleString()
    mixed = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    mixed = written(mixed.select("band", _tiles(mixed).alias("tiles")), "mixed-bands")
    by_band = _dealt(members.join(mixed, "band"), "band")
    forest = written(by_band.groupBy("group", "low", "high").applyInArrow(_forest, f"a {kind}, b {kind}").distinct(), "may-link")
    clusters = written(components(forest).select(F.col("node").alias("id"), F.col("root").alias("cluster")), "clusters")
    own = members.select("id", "root", "size", *SIGNATURE).dropDuplicates(["id", *SIGNATURE]).join(clusters, "id")
    sized = own.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    sized = written(sized.select("cluster", _tiles(sized).alias("tiles")), "cluster-tiles")
    near = _dealt(own.join(sized.where(F.col("tiles") <= MANY_TILES), "cluster"), "cluster")
    large = clusters.join(sized.where(F.col("tiles") > MANY_TILES), "cluster").select("id")
    near = near.withColumn("by", F.lit("cluster")).unionByName(by_band.join(large, "id").withColumn("by", F.lit("band")))
    whole = near.join(texts, "id")
    exact = whole.groupBy("by", "group", "low", "high").applyInArrow(lambda t: _exact(t, percent, n), f"a {kind}, b {kind}")
    out = written(exact.distinct(), "confirmed")
    discard(mixed, forest, clusters, sized)
    return out


def _texts(docs: DataFrame, book: DataFrame, members: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, text: the different texts of the members' ids. A text of another class under the same id is the same
    node and counts as well; rows without words link nothing."""
    rows = book.where("id IS NOT NULL AND key IS NOT NULL").join(members.select("id").distinct(), "id").groupBy("id", "key").agg(F.min("row").alias("row"))
    side = put(rows.select("row").unionByName(ends(book)), "candidates")
    out = written(chosen(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), side), "candidate-texts")
    discard(side)
    return out


def links(docs: DataFrame, book: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """node, root of the components of the classes' ids. ``book``: the table of ``signed``, as stored."""
    _check(percent)
    classes = book.where("id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in SIGNATURE])
    classes = written(classes.drop("key"), "classes")
    banded = classes.select("id", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").select("band", "head"), "bands")
    members = banded.join(shared, "band").select("band", "head", "id")
    # an id may name classes of several texts; each of them is a member
    members = written(members.join(classes.drop("bands"), "id").select("band", "head", "id", "size", *SIGNATURE), "members")

    sign = classes.select("id", F.struct(*SIGNATURE).alias("sig"))
    stars = members.where("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b"), F.struct(*SIGNATURE).alias("y")).dropDuplicates(["a", "b"])
    stars = stars.join(sign.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").where(equal_lanes("x", "y") >= LEAST_LANES)
    tried = written(stars.select("a", "b"), "pairs")
    texts = _texts(docs, book, members, text, doc_id)
    found = written(confirm(tried, texts, percent, n), "confirmed")
    roots = written(components(found), "roots")
    now = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    more = _across(now, texts, percent, n)
    discard(classes, shared, members, tried, texts)
    if more.isEmpty():
        return roots
    return written(components(found.unionByName(more)), "roots")


def _grouped(docs: DataFrame, text: str, doc_id: str, percent: int, n: int) -> DataFrame:
    """Per row, as stored: row, id, n_shingles, component, kept."""
    _check(percent)
    book = written(signed(docs, text, doc_id, n), "signatures")
    # copies of a text are linked with the least id of their class, and ids with their own
    lead = book.where("id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("id").alias("lead"))
    roots = links(docs, book, text, doc_id, percent, n)
    # stored, so that the join with a hot class's rows stands alone and can be split
    known = written(lead.join(roots.withColumnRenamed("node", "lead"), "lead", "left").select("key", F.coalesce("root", "lead").alias("root")), "class-roots")
    rows = written(book.select("row", "id", "key", "n_shingles").join(known, "key", "left"), "rows")
    discard(book, roots, known)
    # rows without words belong to the node of their id as well
    blank = rows.where("key IS NULL AND id IS NOT NULL").select("id").distinct()
    own = written(rows.where("root IS NOT NULL").join(blank, "id").groupBy("id").agg(F.min("root").alias("own")), "blank-ids")
    if not own.isEmpty():
        rows = rows.join(own, "id", "left").withColumn("root", F.coalesce("root", "own")).drop("own")
    # rows of one id with different texts join the components of these texts
    twice = rows.where("root IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    twice = written(twice.select("a", "b"), "shared-ids")
    if not twice.isEmpty():
        merged = components(twice).select(F.col("node").alias("root"), F.col("root").alias("top"))
        rows = rows.join(merged, "root", "left").withColumn("root", F.coalesce("top", "root"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return rows.select("row", "id", "n_shingles", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable; null ids: null), kept.

    ``percent``: PERCENT or more, for which the bands and the estimate are made."""
    return _grouped(docs, text, doc_id, percent, n).select(F.col("id").alias(doc_id), "n_shingles", F.col("component").alias("component_id"), "kept")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """One row of each component, that of the least id, with all columns; rows with a null id all stay.

    Of rows that share this id the one with the least text stays (null: last), the first of equal ones.
    No text is shuffled but those of rows that share an id."""
    rows = written(_grouped(docs, text, doc_id, percent, n), "grouped")
    stay = rows.where("kept AND id IS NOT NULL")
    twice = stay.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    side = put(stay.join(twice, "id").select("row").unionByName(ends(rows)), "shared-ids")
    of = chosen(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), side, number="row")
    of = of.select("row", "id", F.struct(F.col("text").isNull().alias("null"), "text", "row").alias("rank"))
    # the rank of a row of null text is least among such rows alone
    best = of.groupBy("id").agg(F.min("rank").alias("best")).select("best.row")
    gone = rows.where("NOT kept").select("row").unionByName(stay.join(twice, "id").select("row").join(best, "row", "left_anti"))
    drop = put(gone.unionByName(ends(rows)), "copies")
    discard(rows, side)
    return chosen(docs, drop, keep=False)
