"""Source divergence audit: how far the term shares of sources lie apart, over run-length columns.

Every term that enough documents of a language hold gets a smoothed share in each source. Two
sources differ by the sum over all these terms of the differences of their shares, which is work of
terms times pairs. But most terms are rare, and terms with the same counts have the same shares.
So the vocabulary is put in an order that brings equal counts together: terms whose counts agree in
all sources become one entry with a length, entries of a block are sorted by their counts, and the
column of each source is run-length encoded in that order. For a pair of sources the boundaries of
both columns' runs are intersected, and each common run adds its difference times its length. Sums
over blocks are exact, as every number is an integer.

Scale: a task counts terms per source before anything is shuffled, so shuffles hold a row per task,
source and distinct term, and a source with a third of all rows is spread like any other. Of a term
the counts of its sources come together, one number per source. Sources are dealt into tiles of
``TILE``, and the pairs of two tiles are compared over blocks of about ``BLOCK`` entries, so a group
holds a bounded number of counts; what grows with the square of the sources of a language is the
result itself.

Defined cases: a null text, language or source counts as an empty one; repeated rows count each;
a source without terms has count 0 of every term; a language without frequent terms has pairs of
value 0 and no terms; a language of one source has no pairs; an empty table gives no rows; other
input columns, whatever their names, are not looked at."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .words import parts

#: Documents of a language that a kept term stands in, at least; the smoothing of counts; the scale of shares; terms reported per source.
LEAST, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Sources in a tile, entries in a block, distinct terms a task holds before it hands them on.
TILE, BLOCK, HELD = 128, 4096, 400_000
#: Each byte's part in terms: letters in lower case and all of a wider character, else a separator.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        has: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                known = pa.array([None, *terms], pa.binary()).cast(pa.string())
                of = lambda x: pa.array([x] * len(known), pa.string())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([of(lang), of(source), known, pa.array([0, *terms.values()]), pa.array([0, *map(has[lang, source].__getitem__, terms)])], ["lang", "source", "term", "n", "docs"])
            n.clear()
            has.clear()

        for part in parts(batches):
            for text, lang, source in zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                terms, group = text.as_buffer().to_pybytes().translate(FOLD).split(), (lang, source)
                held -= len(n[group])
                n[group].update(terms)
                has[group].update(set(terms))
                held += len(n[group])
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    rows = docs.select(text_or_empty(text).alias("text"), text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, total: terms in at least so many documents of their language."""
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return terms.where(F.col("docs") >= least).drop("docs")


def group_sizes(counts: DataFrame, entries: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size (occurrences of kept terms), lang_size, terms, sources: a row for each group."""
    groups = counts.where("term IS NULL").select("lang", "source")
    sizes = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size")), "lang", "left")
    return sizes.join(langs, "lang").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "lang_size", "terms")), "sources")


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + the scaled share of a smoothed count, rounded down; exact."""
    whole = (size + PRIOR * terms).cast("decimal(38,0)")
    return F.call_function("div", (n + PRIOR).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)"), whole) + 1


def shares(n: np.ndarray, size: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """``share`` for numpy: long division, three digits at a time, so nothing passes 64 bits."""
    whole = size + PRIOR * terms
    digits, rest = np.divmod(n + PRIOR, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        digits = digits * 1000 + more
    return digits + 1


def run_lengths(column: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values in a column, as places in the vocabulary, and their values.

    ``at``: the place of each entry of the column, which stands for all up to the next."""
    new = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if len(column) else np.zeros(0, np.int64)
    return at[new], column[new]


def apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of differences of two run-length columns over ``length`` places."""
    if not length:
        return 0
    starts = np.union1d(a[0], b[0])
    of = lambda x: x[1][np.searchsorted(x[0], starts, "right") - 1]
    return int((np.abs(of(a) - of(b)) * np.diff(np.append(starts, length))).sum())


def _compared(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """source, item, value: the pairs of a tile, or between two, over a block's entries.

    ``entries``: counts (source and count of those above 0) and length; ``groups``: the sources."""
    groups = groups.sort_by("source")
    names, tile = groups["source"].to_pylist(), groups["tile"].to_numpy()
    lists = entries["counts"].combine_chunks()
    inner = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    of = pc.index_in(inner.field("source"), groups["source"].combine_chunks()).to_numpy(zero_copy_only=False)
    n = np.zeros((len(names), len(lists)), np.int64)
    n[of, row] = inner.field("n").to_numpy(zero_copy_only=False)
    order = np.lexsort(n[np.argsort(np.count_nonzero(n, axis=1), kind="stable")]) if len(names) and len(lists) else np.arange(len(lists))
    length = entries["length"].to_numpy()[order]
    at = np.cumsum(length) - length
    p = shares(n[:, order], groups["size"].to_numpy()[:, None], groups["terms"].to_numpy()[:, None]) if len(lists) else n
    runs = [run_lengths(x, at) for x in p]
    low, high = groups["low"][0].as_py(), groups["high"][0].as_py()
    left, right = np.flatnonzero(tile == low).tolist(), np.flatnonzero(tile == high).tolist()
    pairs = [(i, j) for i in left for j in right if low != high or i < j]
    values = [apart(runs[i], runs[j], int(length.sum())) for i, j in pairs]
    return pa.table({"lang": pa.array([groups["lang"][0].as_py()] * len(pairs), pa.string()), "source": pa.array([names[i] for i, _ in pairs], pa.string()), "item": pa.array([names[j] for _, j in pairs], pa.string()), "value": pa.array(values, pa.int64())})


def pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the distance of each ordered pair of a language's sources."""
    tiles, blocks = F.ceil(F.col("sources") / TILE), F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK)).cast("int")
    tile = F.pmod(F.xxhash64("source"), tiles).cast("int")
    # what a tile holds goes to each pair of tiles that it is part of
    other = F.explode(F.sequence(F.lit(0), tiles.cast("int") - 1))
    dealt = groups.withColumn("tile", tile).withColumn("blocks", blocks).withColumn("other", other)
    dealt = dealt.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    rows = entries.join(dealt.select("lang", "source", "low", "high", "blocks"), ["lang", "source"])
    keys = ["lang", "low", "high"]
    equal = rows.groupBy(*keys, "blocks", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    equal = equal.groupBy(*keys, "blocks", "counts").agg(F.count("*").alias("length"))
    # terms that none of the two tiles' sources has are one entry without counts
    terms = dealt.groupBy(*keys).agg(F.max("terms").alias("terms"), F.max("blocks").alias("blocks"))
    none = terms.join(equal.groupBy(*keys).agg(F.sum("length").alias("some")), keys, "left")
    none = none.select(*keys, "blocks", F.array().cast(equal.schema["counts"].dataType).alias("counts"), (F.col("terms") - F.coalesce("some", F.lit(0))).alias("length"))
    block = F.pmod(F.xxhash64("counts"), F.col("blocks")).cast("int")
    equal = equal.unionByName(none.where("length > 0")).withColumn("block", block).select(*keys, "block", "counts", "length")
    held = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys += ["block"]
    held = held.select(*(F.col(c).alias(c) for c in (*keys, "source", "size", "terms", "tile")))  # columns of its own for the cogroup
    found = equal.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_compared, "lang string, source string, item string, value long")
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return found.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def risen(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: terms of a source whose share is over the language's."""
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("lang_size"), F.col("terms"))
    rows = entries.join(groups, ["lang", "source"]).where("n > 0")
    return rows.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = written(counted(docs, text, lang, source), "term-counts")
    kept = written(kept_terms(counts, least), "kept-terms")
    entries = written(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "term-entries")
    groups = written(group_sizes(counts, entries, kept), "term-groups")
    terms = ranked(risen(entries, groups), "term").where(F.col("rank") <= top)
    return ranked(pairs(entries, groups), "pair").unionByName(terms)
