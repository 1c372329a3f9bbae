"""A validation run: combinations, metrics and aggregations as one plan, resumable date by date."""

from __future__ import annotations

import datetime
import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.functions.storage import shared_folder
from gridproof.operators import aggregators as A
from gridproof.operators import align as X
from gridproof.operators.grid import local_sums
from gridproof.operators.metrics import Metric, Spread, applied
from gridproof.operators.tiles import Tile, over_tiles


@dataclass(frozen=True)
class Aggregation:
    """A name of the user's choice, the keys that are kept, and what is kept of their values."""

    name: str
    keys: tuple[str, ...]
    statistic: A.Statistic = A.MEAN


TEMPORAL = Aggregation("temporal", ("date", "channel"))
SPATIAL = Aggregation("spatial", ("channel", "i", "j"))
AVERAGE = Aggregation("average", ())
KEYS = ("date", "channel", "i", "j")
#: Beginning of the names of snapshots that come from a stream.
STREAMED = "stream-"
Combinator = Callable[[Sequence[str], int], Iterable[tuple]]


def in_range(field: DataFrame, start: str, end: str) -> DataFrame:
    """Dates from start, up to end without it."""
    return field.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))


def local_variances(field: DataFrame, metrics: Sequence[Metric], datasets: Sequence[str], combinator: Combinator = combinations) -> dict[tuple[int, float], DataFrame]:
    """By window and its width in sigmas: of (names joined by |), date, channel, i, j, variance of all that the metrics' spreads ask for.

    What several combinations or metrics share is looked at once, and all of one window in one pass of tiles."""
    wanted: dict[tuple[int, float], set[tuple[str, ...]]] = defaultdict(set)
    for m in metrics:
        for s in m.spreads:
            wanted[s.window, s.n_sigma].update(tuple(c[k] for k in s.of) for c in combinator(datasets, m.arity))
    out = {}
    for (window, n_sigma), names in wanted.items():
        names = sorted(n for n in names if len(n) in (1, 2))
        if names:
            out[window, n_sigma] = _variances(field, window, n_sigma, names, list(datasets))
    return out


def _variances(field: DataFrame, window: int, n_sigma: float, names: Sequence[tuple[str, ...]], datasets: Sequence[str]) -> DataFrame:
    """of, date, channel, i, j, variance of the named datasets and differences.

    A tile holds a row for each cell, with the values of all datasets, and the differences are made in it, so the number of
    names adds no rows to the passes. A dataset's variance is that at the cells it has a row of, a difference's at all cells
    of a date that both have."""
    value = F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))
    at = {d: f"d{k}" for k, d in enumerate(datasets)}
    wide = field.where(F.col("dataset").isin(list(datasets))).groupBy(*X.CELL).agg(*[F.max(F.when(F.col("dataset") == d, value)).alias(c) for d, c in at.items()])
    sums, used = local_sums(window, n_sigma), {d for n in names for d in n}
    columns = {f"s{k}": n for k, n in enumerate(names)}

    def of(tile: Tile) -> dict[str, np.ndarray]:
        found = {f"has_{at[d]}": tile.values[f"has_{at[d]}"] for d in used}
        for column, name in columns.items():
            x = tile.values[at[name[0]]]
            if len(name) == 2:
                x = x - tile.values[at[name[1]]]
            there = ~np.isnan(x)
            some = sums(there.astype(float))
            with np.errstate(invalid="ignore", divide="ignore"):
                m1, m2 = (np.where(some > 0, sums(np.where(there, v, 0)) / some, np.nan).astype(float) for v in (x, x * x))
            found[column] = np.fmax(m2 - m1 * m1, 0.0)
        return found

    # NaN, a missing value of a row, is missing in a tile as well as none at all, so flags tell rows apart
    values = {c: F.when(~F.isnan(c), F.col(c)) for d, c in at.items() if d in used} | {f"has_{at[d]}": F.col(at[d]).isNotNull().cast("double") for d in used}
    flags = {d: f"has_{at[d]}" for d in used}
    found = over_tiles(wide, ("date", "channel"), window // 2, values, of, [*flags.values(), *columns])
    single = [F.when(F.col(flags[n[0]]) == 1, _named(n, c)) for c, n in columns.items() if len(n) == 1]
    double = [_named(n, c) for c, n in columns.items() if len(n) == 2]
    rows = found.select(*X.CELL, F.explode(F.array_compact(F.array(*single, *double))).alias("x")).select("x.of", *X.CELL, "x.variance")
    if not double:
        return rows
    on = wide.groupBy("date").agg(*[F.max(F.col(at[d]).isNotNull()).alias(at[d]) for d in used])
    pairs = [F.when(F.col(at[n[0]]) & F.col(at[n[1]]), F.lit("|".join(n))) for n in names if len(n) == 2]
    met = on.select("date", F.explode(F.array_compact(F.array(*[F.lit(n[0]) for n in names if len(n) == 1], *pairs))).alias("of"))
    return rows.join(met, ["date", "of"], "left_semi").select("of", *X.CELL, "variance")


def _named(name: tuple[str, ...], column: str) -> Column:
    return F.struct(F.lit("|".join(name)).alias("of"), F.col(column).alias("variance"))


def _with_spreads(rows: DataFrame, spreads: Sequence[Spread], variances: dict[tuple[int, float], DataFrame], vector: bool, u: int, v: int) -> tuple[DataFrame, dict[Spread, str]]:
    """The rows with a column for each spread, and which one; of vectors structs of u and v."""
    places = {}
    for k, s in enumerate(spreads):
        places[s] = f"spread{k}"
        kind = "struct<u:double,v:double>" if vector else "double"
        if (s.window, s.n_sigma) not in variances:
            rows = rows.withColumn(places[s], F.lit(None).cast(kind))
            continue
        found = variances[s.window, s.n_sigma].withColumn("std", F.sqrt(F.col("variance") + s.eps))
        cell = ["date", "i", "j"] if vector else list(X.CELL)
        if vector:
            of = lambda c: F.max(F.when(F.col("channel") == c, F.col("std")))
            found = found.where(F.col("channel").isin(u, v)).groupBy("of", *cell).agg(F.struct(of(u).alias("u"), of(v).alias("v")).alias("std"))
        names = F.concat_ws("|", *[F.get(F.split("combo", r"\|"), p) for p in s.of])
        # both sides are merged: what a tile gives has no size that is known ahead, and was broadcast
        rows = rows.withColumn("of", names).join(found.select("of", *cell, F.col("std").alias(places[s])).hint("merge"), ["of", *cell], "left").drop("of")
    return rows, places


def metric_rows(field: DataFrame, metrics: Sequence[Metric], datasets: Sequence[str] | None = None, combinator: Combinator = combinations, u: int = 0, v: int = 1) -> DataFrame:
    """metric, combo, date, channel, i, j, value of all metrics over all combinations.

    Metrics of one kind and number of datasets share one pivot; those with local deviations share the
    passes that these take. The channel of a metric of vectors (channels ``u`` and ``v``) is missing."""
    datasets = datasets or X.names(field)
    variances = local_variances(field, metrics, datasets, combinator)
    out = None
    for kind, arity in sorted({(m.kind, m.arity) for m in metrics}):
        own, vector = [m for m in metrics if (m.kind, m.arity) == (kind, arity)], kind == "vector"
        rows = X.vector_combos(field, arity, datasets, combinator, u, v) if vector else X.combos(field, arity, datasets, combinator)
        rows, places = _with_spreads(rows, list(dict.fromkeys(s for m in own for s in m.spreads)), variances, vector, u, v)
        rows = applied(rows, *own, places=places)
        out = rows if out is None else out.unionByName(rows)
    return out


def partials(rows: DataFrame, aggregations: Sequence[Aggregation], by_day: bool = False) -> DataFrame:
    """aggregator, statistic, metric, combo, keys (null where not kept), day, part, and a column with the state of each
    statistic: states that can be merged. ``by_day``: states of single dates, whether or not the date is kept.

    The rows are exploded over the aggregations ahead of one shuffle, where map-side aggregation shrinks them."""
    kinds = dict(rows.dtypes)
    stats = {a.statistic.name: a.statistic for a in aggregations}
    part = lambda s: F.lit(None).cast("double") if s.part is None else s.part(F.col("value")).cast("double")
    day = F.col("date") if by_day else F.lit(None).cast(kinds["date"])
    of = [
        F.struct(F.lit(a.name).alias("aggregator"), F.lit(a.statistic.name).alias("statistic"), *[(F.col(k) if k in a.keys else F.lit(None).cast(kinds[k])).alias(k) for k in KEYS], day.alias("day"), part(a.statistic).alias("part"))
        for a in aggregations
    ]
    each = rows.select("metric", "combo", "value", F.explode(F.array(*of)).alias("a")).select("a.*", "metric", "combo", "value")
    fields = {(n, f): c.alias(f"{n}__{f}") for n, s in stats.items() for f, c in s.first(F.when(F.col("statistic") == n, F.col("value"))).items()}
    done = each.groupBy(*STATE_KEYS).agg(*fields.values())
    return done.select(*STATE_KEYS, *[F.when(F.col("statistic") == n, s.state({f: F.col(f"`{n}__{f}`") for m, f in fields if m == n})).alias(n) for n, s in stats.items()])


STATE_KEYS = ("aggregator", "statistic", *A.RUN, *KEYS, "day", "part")


def _known(parts: DataFrame, statistics: Sequence[A.Statistic]) -> dict[str, A.Statistic]:
    known = {s.name: s for s in (*A.STATISTICS, *statistics)}
    stored = [c for c in parts.columns if c not in (*STATE_KEYS, "seq")]
    if bad := [c for c in stored if c not in known]:
        raise ValueError(f"states of statistics that are not given: {bad}")
    return {c: known[c] for c in stored}


def merged(parts: DataFrame, statistics: Sequence[A.Statistic] = (), keys: Sequence[str] = STATE_KEYS) -> DataFrame:
    """States of equal keys as one, in the order of ``seq``; there are as many of a key as snapshots or days hold it."""
    order = F.col("seq") if "seq" in parts.columns else F.lit(0)
    states = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct(order.alias("seq"), F.col("day").alias("day"), F.col(n).alias("state"))))), lambda x: x["state"])
    known = _known(parts, statistics)
    done = parts.groupBy(*keys).agg(F.max(order).alias("seq"), *[states(f"`{n}`").alias(n) for n in known])
    return done.select(*keys, "seq", *[s.folded(F.col(f"`{n}`")).alias(n) for n, s in known.items()])


def summary(parts: DataFrame, statistics: Sequence[A.Statistic] = ()) -> DataFrame:
    """aggregator, metric, combo, keys, value of merged states."""
    known, keys = _known(parts, statistics), ("aggregator", *A.RUN, *KEYS)
    whole, value = [n for n, s in known.items() if s.part is None], F.lit(None).cast("double")
    for n in whole:
        value = F.when(F.col("statistic") == n, known[n].finish(F.col(f"`{n}`")).cast("double")).otherwise(value)
    out = parts.where(F.col("statistic").isin(whole)).select(*keys, value.alias("value"))
    for n in [n for n in known if n not in whole]:
        states = F.array_sort(F.collect_list(F.struct("part", F.col(f"`{n}`").alias("state"))))
        done = parts.where(F.col("statistic") == n).groupBy(*keys).agg(states.alias("states"))
        out = out.unionByName(done.select(*keys, known[n].finish(F.col("states")).cast("double").alias("value")))
    return out


def run(field: DataFrame, metrics: Sequence[Metric], aggregations: Sequence[Aggregation], datasets: Sequence[str] | None = None, combinator: Combinator = combinations) -> DataFrame:
    return summary(partials(metric_rows(field, metrics, datasets, combinator), aggregations), [a.statistic for a in aggregations])


def missing_dates(field: DataFrame, dates: DataFrame) -> DataFrame:
    """dataset, date of expected dates that a dataset lacks."""
    spine = X.availability(field).select("dataset").distinct().crossJoin(dates.select("date").distinct())  # datasets: a short list
    return spine.join(X.availability(field), ["dataset", "date"], "left_anti")


class Store:
    """Partial states and processed dates under a folder, in snapshots that a manifest lists.

    A step writes its snapshot and then a new manifest, which counts from the moment it is renamed into place; what no manifest
    lists is as if it were not there. ``fan`` snapshots of one level are merged into one of the next, so a store of n steps has
    ``fan`` times the logarithm of n snapshots at most; what was merged is deleted one step later, when no reader needs it.
    It is filled by ``add`` (whole dates) or by ``merge`` (batches of a stream), not by both, and by one writer at a time.
    ``statistics``: those of the caller's own, which are kept in the same way."""

    def __init__(self, spark: SparkSession, folder: str, statistics: Sequence[A.Statistic] = (), fan: int = 16):
        self.spark, self.folder, self.statistics, self.fan = spark, folder.rstrip("/"), tuple(statistics), fan

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        """The newest manifest: kind, seq of the last step, snapshots, last batch of each stream, and what is to be deleted."""
        fs, top = self._fs(), self._path("manifests")
        names = sorted(n for s in fs.listStatus(top) if (n := s.getPath().getName()).endswith(".json")) if fs.exists(top) else []
        if not names:
            return {"number": 0, "kind": None, "seq": 0, "snapshots": [], "batches": {}, "old": []}
        file = fs.open(self._path("manifests", names[-1]))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _commit(self, m: dict) -> None:
        """Put a manifest in place of the last, and delete what the last but one had no more use for."""
        fs, gone = self._fs(), m["old"]
        m = m | {"number": m["number"] + 1, "old": m.get("new_old", [])}
        m.pop("new_old", None)
        draft = self._path("manifests", f"draft-{uuid.uuid4().hex}")
        file = fs.create(draft)
        file.write(bytearray(json.dumps(m).encode()))
        file.close()
        if not fs.rename(draft, self._path("manifests", f"{m['number']:012d}.json")):
            raise RuntimeError("another writer has changed the store")
        for name in (*gone, f"manifests/{m['number'] - 2:012d}.json"):
            fs.delete(self._path(name), True)

    def marked(self) -> list[str]:
        """Names of the snapshots that count, in the order of their making."""
        return [s["name"] for s in self._manifest()["snapshots"]]

    def _read(self, snapshots: Sequence[dict], part: str) -> DataFrame | None:
        found = [f"{self.folder}/snapshots/{s['name']}/{part}" for s in snapshots if part in s["parts"]]
        return self.spark.read.option("mergeSchema", "true").parquet(*found) if found else None

    def read(self, part: str) -> DataFrame | None:
        """``dates`` (date, seq of the step that made its states last) or ``partials`` of all snapshots that count."""
        m = self._manifest()
        rows = self._read(m["snapshots"], part)
        if rows is None:
            return None
        return rows.groupBy("date").agg(F.max("seq").alias("seq")) if part == "dates" else self._newest(rows, m)

    def _newest(self, states: DataFrame, m: dict, snapshots: Sequence[dict] | None = None) -> DataFrame:
        """Of the states of a stream's dates those of the last step that made them."""
        if m["kind"] != "stream":
            return states
        dates = self._read(m["snapshots"], "dates").groupBy(F.col("date").alias("day")).agg(F.max("seq").alias("seq"))
        return states.join(dates, ["day", "seq"], "left_semi")

    def _publish(self, m: dict, name: str, new: DataFrame | None, dates: DataFrame, level: int = 0, replaced: Sequence[dict] = (), **changed) -> dict:
        """Write a snapshot and the manifest that lists it, in place of those it replaces."""
        to, parts = f"{self.folder}/snapshots/{name}", ["dates"]
        if new is not None:
            new.write.mode("overwrite").parquet(f"{to}/partials")
            parts.append("partials")
        dates.write.mode("overwrite").parquet(f"{to}/dates")
        kept = [s for s in m["snapshots"] if s not in replaced]
        m = m | changed | {"snapshots": [*kept, {"name": name, "level": level, "parts": parts}]}
        m["new_old"] = [f"snapshots/{s['name']}" for s in replaced] + m.pop("rows_old", [])
        self._commit(m)
        return self._compact(self._manifest())

    def _compact(self, m: dict) -> dict:
        """Merge snapshots of the lowest level that has enough of them."""
        levels = defaultdict(list)
        for s in m["snapshots"]:
            levels[s["level"]].append(s)
        full = [level for level, own in sorted(levels.items()) if len(own) >= self.fan]
        if not full:
            return m
        own = levels[full[0]]
        states = self._read(own, "partials")
        if states is not None:
            states = merged(self._newest(states, m), self.statistics)
        dates = self._read(own, "dates").groupBy("date").agg(F.max("seq").alias("seq"))
        return self._publish(m, f"merged-{uuid.uuid4().hex[:12]}", states, dates, full[0] + 1, own)

    def add(self, field: DataFrame, metrics: Sequence[Metric], aggregations: Sequence[Aggregation], dates: DataFrame | None = None) -> None:
        """Process the dates that are not yet done, each whole, and publish what they add. ``dates``: dates that
        are done with this field even where it has no row of them."""
        m = self._manifest()
        if m["kind"] == "stream":
            raise ValueError("this store is filled by a stream")
        done = self._read(m["snapshots"], "dates")
        new = field.select("date") if dates is None else field.select("date").unionByName(dates.select("date"))
        if done is not None:
            done = done.select("date")
            field, new = field.join(done, "date", "left_anti"), new.join(done, "date", "left_anti")
        names = X.names(field)
        if not names and new.isEmpty():
            return
        seq = m["seq"] + 1
        name = f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        states = partials(metric_rows(field, metrics, names), aggregations).withColumn("seq", F.lit(seq)) if names else None
        self._publish(m, name, states, new.distinct().withColumn("seq", F.lit(seq)), kind="dates", seq=seq)

    def merge(self, batch: DataFrame, name: str, metrics: Sequence[Metric], aggregations: Sequence[Aggregation]) -> None:
        """Add a batch of rows of any dates, also of dates that came before. The rows of each date it touches, with those that
        came before, are stored anew, and the date's states are made from them and take the place of older ones; so the
        states are those of one run over all rows, and a date has its rows in one place, however many batches brought them.
        ``name``: of a stream and the number of the batch, joined by a dash; a batch that came before adds nothing."""
        m = self._manifest()
        if m["kind"] == "dates":
            raise ValueError("this store is filled by whole dates")
        stream, dash, number = name.rpartition("-")
        stream, number = (stream, int(number)) if dash and number.isdigit() else (name, 0)
        if number <= m["batches"].get(stream, -1):
            return
        seq, batches = m["seq"] + 1, m["batches"] | {stream: number}
        touched = [r.date for r in batch.select("date").where("date IS NOT NULL").distinct().collect()]  # the dates of a batch
        if not touched:
            return self._commit(m | {"kind": "stream", "batches": batches})
        known = self._read(m["snapshots"], "dates")
        known = [] if known is None else known.where(F.col("date").isin(touched)).groupBy("date").agg(F.max("seq").alias("seq")).collect()  # as many at most
        old = [f"arrived/seq_={r.seq}/date={r.date}" for r in known]
        rows = batch.where("date IS NOT NULL")
        if old:
            rows = rows.unionByName(self._arrived(old, batch))
        rows.write.mode("overwrite").partitionBy("date").parquet(f"{self.folder}/arrived/seq_={seq}")
        rows = self._arrived([f"arrived/seq_={seq}"], batch)
        states = partials(metric_rows(rows, metrics), aggregations, by_day=True).withColumn("seq", F.lit(seq))
        dates = self.spark.createDataFrame([(d, seq) for d in touched], "date date, seq int")
        self._publish(m | {"rows_old": old}, STREAMED + name, states, dates, kind="stream", seq=seq, batches=batches)

    def _arrived(self, folders: Sequence[str], like: DataFrame) -> DataFrame:
        """Stored rows of a step's dates; date and step are found in the paths."""
        return self.spark.read.schema(like.schema).option("basePath", f"{self.folder}/arrived").parquet(*[f"{self.folder}/{f}" for f in folders]).select(*like.columns)

    def summary(self) -> DataFrame:
        keys = [k for k in STATE_KEYS if k != "day"]
        return summary(merged(self.read("partials"), self.statistics, keys), self.statistics)
