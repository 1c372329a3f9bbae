"""Points, tracks and stations: long tables keyed by buoy_id or station_id and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridproof.functions.missing import all_present
from gridproof.functions.projection import geodesic

from .grid import nearest

HOUR = "INTERVAL 1 HOUR"


def day_of_year_time(year: Column, day: Column) -> Column:
    """1 January plus day - 1 days, to the microsecond; missing parts give a missing time."""
    micros = F.round((day - 1) * 86_400_000_000).cast("long")
    return F.timestamp_add("MICROSECOND", micros, F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def numeric_time(seconds: Column, epoch: str = "1900-01-01 00:00:00") -> Column:
    return F.timestamp_add("SECOND", seconds.cast("long"), F.lit(epoch).cast("timestamp_ntz"))


def keep_last(track: DataFrame, order: str, key: str = "buoy_id") -> DataFrame:
    """One row of each time, that of the greatest ``order``."""
    rest = [c for c in track.columns if c not in (key, "ts", order)]
    return track.groupBy(key, "ts").agg(F.max_by(F.struct(order, *rest), order).alias("r")).select(key, "ts", "r.*")


def hourly(track: DataFrame, tolerance_min: int, values: Sequence[str], key: str = "buoy_id") -> DataFrame:
    """Each whole hour of a track with its nearest sample, if one is within the tolerance.

    Of two as near, the later. Hours run from the first sample's hour to that after the last. A track is
    cut into days, and a sample goes to each day that holds an hour within its tolerance, so that a long
    track is no single task's. Only samples are put in order: each then gives the hours that are nearer
    to it than to its neighbours, so the many hours are never sorted. An hour before the first or after the
    last is an hour or more from any sample, so only tolerances of an hour or more have to look at these two."""
    hours = _own_hours(track, tolerance_min, values, key).select(key, "day", "r", F.explode(F.sequence("first", "last")).alias("h"))
    return hours.select(key, F.timestamp_add("HOUR", F.col("h"), F.col("day")).alias("ts"), "r.sample_ts", *[f"r.{v}" for v in values])


def hour_runs(track: DataFrame, tolerance_min: int, values: Sequence[str], key: str = "buoy_id") -> DataFrame:
    """The hours of ``hourly`` as runs of one sample within a day: the first, ``since``, and the last, ``until``."""
    at = lambda c: F.timestamp_add("HOUR", F.col(c), F.col("day")).alias({"first": "since", "last": "until"}[c])
    return _own_hours(track, tolerance_min, values, key).select(key, at("first"), at("last"), "r.sample_ts", *[f"r.{v}" for v in values])


def _own_hours(track: DataFrame, tolerance_min: int, values: Sequence[str], key: str) -> DataFrame:
    """The first and the last hour of a day that each sample gives, with the sample as ``r``."""
    reach = lambda sign: F.to_date(F.timestamp_add("MINUTE", F.lit(sign * tolerance_min), F.col("ts")))
    day = F.explode(F.sequence(reach(-1), reach(1)))
    samples, ends = track.where(F.col(key).isNotNull()).select(key, "ts", F.struct(F.col("ts").alias("sample_ts"), *values).alias("r")), ()
    if tolerance_min >= 60:
        hour = F.date_trunc("HOUR", "ts").cast("timestamp_ntz")
        span = track.groupBy(key).agg(F.min(hour).alias("lo"), F.max(F.when(hour == F.col("ts"), hour).otherwise(F.timestamp_add("HOUR", F.lit(1), hour))).alias("hi"))
        samples, ends = samples.join(span, key), ("lo", "hi")
    samples = samples.withColumn("day", day).withColumn("day", F.col("day").cast("timestamp_ntz"))
    since = lambda c: F.timestamp_diff("MICROSECOND", F.col("day"), F.col(c))
    w, t, size, most = Window.partitionBy(key, "day").orderBy("t"), F.col("t"), 3_600_000_000, tolerance_min * 60_000_000
    line = samples.withColumn("t", since("ts")).withColumns({"before": F.lag("t").over(w), "after": F.lead("t").over(w)})
    # hours of the day: an hour half-way between two samples is the later one's
    first = F.greatest(F.lit(0), F.ceil((t - most) / size), F.ceil((F.col("before") + t) / (2 * size)), *[F.ceil(since(c) / size) for c in ends[:1]])
    last = F.least(F.lit(23), F.floor((t + most) / size), F.ceil((t + F.col("after")) / (2 * size)) - 1, *[F.floor(since(c) / size) for c in ends[1:]])
    return line.select(key, "day", "r", first.cast("int").alias("first"), last.cast("int").alias("last")).where(F.col("first") <= F.col("last"))


def drift(track: DataFrame, key: str = "buoy_id") -> DataFrame:
    """u, v, speed in cm/s from each position to the next of the same buoy; missing at the end."""
    w = Window.partitionBy(key).orderBy("ts")
    nxt = track.withColumns({"ts2": F.lead("ts").over(w), "lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)})
    g = nxt.withColumn("g", geodesic("lat", "lon", "lat2", "lon2"))
    dt = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("ts2")) / 1e6
    k = F.when(dt > 0, F.col("g.metres") / dt * 100)
    a = F.radians(F.col("g.azimuth"))
    return g.withColumns({"u_cm_s": k * F.sin(a), "v_cm_s": k * F.cos(a), "speed_cm_s": k}).drop("ts2", "lat2", "lon2", "g")


def window_starts(track: DataFrame, length: int, required: Sequence[str], key: str = "buoy_id") -> DataFrame:
    """Times from which a buoy has ``length`` hourly rows without a gap and with all required values."""
    order = Window.partitionBy(key).orderBy("ts")
    ok = F.lit(1)
    for c in required:
        ok = ok * F.when(F.col(c).isNotNull(), 1).otherwise(0)
    step = F.when(F.timestamp_diff("SECOND", F.lag("ts").over(order), F.col("ts")) == 3600, 1).otherwise(0)
    rows = track.withColumns({"ok": ok, "step": step})
    good = F.sum("ok").over(order.rowsBetween(0, length - 1)) == length
    if length > 1:
        good = good & (F.sum("step").over(order.rowsBetween(1, length - 1)) == length - 1)
    return rows.withColumn("good", good).where("good").select(key, F.col("ts").alias("start_ts"))


def windows(track: DataFrame, starts: DataFrame, length: int, key: str = "buoy_id") -> DataFrame:
    """Rows of each window with its start and step, by an equality join on the times it needs.

    It merges both sides: their sizes are estimated without the rows that hours and steps add, by which they would be broadcast."""
    need = starts.select(key, "start_ts", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step")).withColumn("ts", F.expr("start_ts + make_dt_interval(0, step, 0, 0)"))
    return need.join(track.hint("merge"), [key, "ts"])


def first_positions(wins: DataFrame, key: str = "buoy_id") -> DataFrame:
    return wins.groupBy(key, "start_ts").agg(F.min_by(F.struct("lat", "lon"), "step").alias("p")).select(key, "start_ts", "p.lat", "p.lon")


def start_positions(runs: DataFrame, length: int, required: Sequence[str], key: str = "buoy_id") -> DataFrame:
    """The first positions of all windows of ``length`` hours that a track's runs (key, since, until, lat, lon) give without a gap.

    They are those of the hours that windows start at, so no other hours of windows are made; and runs are
    put in order, not hours: each is told the last hour that follows on it without a gap. A run that lacks
    a required value is a gap."""
    hour = lambda n, c: F.timestamp_add("HOUR", n, F.col(c))
    w = Window.partitionBy(key).orderBy(F.desc("since"))
    there = runs.where(all_present(*map(F.col, required))) if required else runs
    ends = there.withColumn("end", F.when(F.lag("since").over(w) == hour(F.lit(1), "until"), None).otherwise(F.col("until")))
    ends = ends.withColumn("end", F.last("end", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    starts = ends.withColumn("last", F.least("until", hour(F.lit(1 - length), "end"))).where(F.col("since") <= F.col("last"))
    of = starts.select(key, "since", "lat", "lon", F.explode(F.sequence(F.lit(0), F.timestamp_diff("HOUR", F.col("since"), F.col("last")).cast("int"))).alias("h"))
    return of.select(key, hour(F.col("h"), "since").alias("start_ts"), "lat", "lon")


def padded(wins: DataFrame, length: int, key: str = "buoy_id") -> DataFrame:
    """Exactly ``length`` steps of each track, missing where absent; later steps are dropped."""
    spine = wins.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step"))
    return spine.join(wins.where(F.col("step") < length), [key, "step"], "left")


def lat_lon_order(points: DataFrame, a: str, b: str) -> DataFrame:
    """lat, lon from two columns of which one may exceed 90 in size and is then the longitude."""
    top = points.agg((F.max(F.abs(a)) > 90).alias("swap"))  # one row
    rows = points.crossJoin(F.broadcast(top))
    swap = F.coalesce("swap", F.lit(False))
    return rows.select(*[c for c in points.columns if c not in (a, b)], F.when(swap, F.col(b)).otherwise(F.col(a)).alias("lat"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias("lon"))


def station_hours(obs: DataFrame, order: str, key: str = "station_id") -> DataFrame:
    """Hour of each observation; of several the last by ``order`` stays."""
    hour = F.date_trunc("HOUR", "ts").cast("timestamp_ntz")
    return obs.groupBy(key, hour.alias("hour")).agg(F.max_by("value", F.struct("ts", order)).alias("value"))


def timeline(hours: DataFrame, full: bool = True, key: str = "station_id") -> DataFrame:
    """Every station at every hour: from first to last, or at the hours that any station has."""
    if full:
        span = hours.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
        times = span.select(F.explode(F.sequence("lo", "hi", F.expr(HOUR))).alias("hour"))
    else:
        times = hours.select("hour").distinct()
    return hours.select(key).distinct().crossJoin(times).join(hours, [key, "hour"], "left")  # stations x hours is the result


def station_window(hours: DataFrame, start: Column, length: int) -> DataFrame:
    return hours.where(F.col("hour").between(start, F.timestamp_add("HOUR", F.lit(length - 1), start)))


def wide(obs: DataFrame, variables: Sequence[str], key: str = "station_id") -> DataFrame:
    """One row per station and hour with a column per variable."""
    return obs.groupBy(key, "hour").pivot("variable", list(variables)).agg(F.first("value"))


def long(rows: DataFrame, variables: Sequence[str], key: str = "station_id") -> DataFrame:
    return rows.unpivot([key, "hour"], list(variables), "variable", "value")


def to_grid(records: DataFrame, nodes: DataFrame, variables: Sequence[str]) -> DataFrame:
    """date, point and the mean of each variable over the records nearest to a node; other nodes are missing.

    records: record, date, lat, lon, variables; nodes: point, lat, lon. A date without records has no rows."""
    own = nearest(nodes, records.select(F.col("record").alias("query"), "lat", "lon")).select(F.col("query").alias("record"), "point")
    means = records.drop("lat", "lon").join(own, "record").groupBy("date", "point").agg(*[F.avg(v).alias(v) for v in variables])
    field = records.select("date").distinct().crossJoin(nodes.select("point"))  # the field is the result
    return field.join(means, ["date", "point"], "left")


def whole_hours(track: DataFrame) -> DataFrame:
    """The track as it is; a time that is no whole hour is an error."""
    bad = F.raise_error(F.concat(F.lit("not a whole hour: "), F.col("ts").cast("string"))).cast("timestamp_ntz")
    return track.withColumn("ts", F.when(F.date_trunc("HOUR", "ts") == F.col("ts"), F.col("ts")).otherwise(bad))


def ingested(track: DataFrame, order: str, tolerance_min: int | None = None, with_drift: bool = False, required: Sequence[str] = ("lat", "lon"), key: str = "buoy_id") -> DataFrame:
    """A prepared track: one row of each time, the last by ``order``; hourly with a tolerance, else all times
    must be whole hours; with the drift to the next position if asked for."""
    if lacking := [c for c in (key, "ts", *required) if c not in track.columns]:
        raise ValueError(f"the track lacks the columns {lacking}")
    one = keep_last(track, order, key)
    rows = whole_hours(one) if tolerance_min is None else hourly(one, tolerance_min, [c for c in one.columns if c not in (key, "ts")], key)
    return drift(rows, key) if with_drift else rows


def batch(wins: DataFrame, variables: Sequence[str], buoys: Sequence | None = None, places: Sequence[int] | None = None, key: str = "buoy_id") -> DataFrame:
    """Windows of the wanted buoys, or of the buoys at the wanted places in order of their ids, with the
    wanted variables; an unknown variable is an error."""
    if lacking := [v for v in variables if v not in wins.columns]:
        raise KeyError(f"no such variables: {lacking}")
    rows = wins if buoys is None else wins.where(F.col(key).isin(list(buoys)))
    if places is not None:
        # ids are a short list beside their windows
        ids = rows.select(key).distinct().withColumn("place", F.row_number().over(Window.orderBy(key)) - 1)
        rows = rows.join(ids.where(F.col("place").isin(list(places))).select(key), key, "left_semi")
    return rows.select(key, "start_ts", "step", *variables)


def decoded_time(value: Column, units: Column) -> Column:
    """Time of a number in "units since epoch"; other units give a missing time."""
    parts = lambda k: F.regexp_extract(units, r"^(second|minute|hour|day)s? since (\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?)", k)
    size = F.when(parts(1) == "second", 1).when(parts(1) == "minute", 60).when(parts(1) == "hour", 3600).when(parts(1) == "day", 86400)
    epoch = F.nullif(parts(2), F.lit("")).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.round(value * size * 1_000_000).cast("long"), epoch)


def constant_step_time(axis: DataFrame, keys: Sequence[str], place: str = "place", value: str = "value", epoch: str = "1900-01-01 00:00:00") -> DataFrame:
    """axis with ``ts``: seconds since the epoch, from the first value on by the step between the first two."""
    first = axis.where(F.col(place) < 2).groupBy(*keys).agg(F.max(F.when(F.col(place) == 0, F.col(value))).alias("v0"), F.max(F.when(F.col(place) == 1, F.col(value))).alias("v1"))
    seconds = F.col("v0") + F.when(F.col(place) > 0, F.col(place) * (F.col("v1") - F.col("v0"))).otherwise(0)
    return axis.join(first, list(keys)).withColumn("ts", numeric_time(seconds, epoch)).drop("v0", "v1")
