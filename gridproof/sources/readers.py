"""Readers of point tables, charts and flat grids, and clean-up rules of gridded products."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.functions.scalars import CHART_SPEED, wrap_longitude
from gridproof.operators.align import nearest_time


def buoy_csv(spark: SparkSession, path: str, values: Sequence[str], time: str = "time_stamp (UTC)", time_format: str = "M/d/yy H:mm") -> DataFrame:
    """ts, date, lat, lon and values; times by format, else as epoch seconds; rows with a gap are dropped."""
    raw = spark.read.option("header", True).csv(path)
    text = F.col(f"`{time}`")
    ts = F.coalesce(F.try_to_timestamp(text, F.lit(time_format)), F.timestamp_seconds(text.try_cast("double"))).cast("timestamp_ntz")
    number = lambda c, n: F.col(f"`{c}`").try_cast("double").alias(n)
    rows = raw.select(ts.alias("ts"), number("latitude", "lat"), number("longitude", "lon"), *[number(v, v) for v in values])
    return rows.dropna().withColumn("date", F.to_date("ts"))


def drifting_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Whitespace-separated rows; lines that begin with # are comments, a header line is dropped."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(parts.alias("p")).where(F.get("p", F.lit(0)) != columns[0])
    return rows.select(*[F.get("p", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def station_files(spark: SparkSession, path: str, variables: Sequence[str], time: str = "time") -> DataFrame:
    """station_id, hour, variables: per file the last row of an hour, over files the last present value."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    known = [v for v in variables if v in raw.columns]
    hour = F.date_trunc("HOUR", F.col(time).try_cast("timestamp")).cast("timestamp_ntz")
    rows = raw.select(F.regexp_extract("file", r"([^/_]+)_[^/]*$", 1).alias("station_id"), "file", hour.alias("hour"), "row", *[F.col(v).try_cast("double").alias(v) for v in known]).where("hour IS NOT NULL")
    one = rows.groupBy("station_id", "file", "hour").agg(F.max_by(F.struct(*known), "row").alias("r")).select("station_id", "file", "hour", "r.*")
    last = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col("file"))).alias(v)
    out = one.groupBy("station_id", "hour").agg(*[last(v) for v in known])
    return out.select("station_id", "hour", *[(F.col(v) if v in known else F.lit(None).cast("double")).alias(v) for v in variables])


def stations(spark: SparkSession, path: str) -> DataFrame:
    """station_id, name, lon, lat of a JSON list; without coordinates a station is left out."""
    schema = "id string, name string, location struct<longitude:double,latitude:double>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    names = F.from_json("name", "map<string,string>")
    name = F.coalesce(F.try_element_at(names, F.lit("en")), F.get(F.map_values(names), F.lit(0)), F.when(~F.col("name").startswith("{"), F.col("name")), F.col("id"))
    rows = raw.select(F.col("id").alias("station_id"), name.alias("name"), F.col("location.longitude").alias("lon"), F.col("location.latitude").alias("lat"))
    return rows.where("lon IS NOT NULL AND lat IS NOT NULL")


def known_stations(obs: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations with their station's name and place, and the ids that no station has."""
    return obs.join(meta, "station_id"), obs.select("station_id").distinct().join(meta, "station_id", "left_anti")


def _arrays(spark: SparkSession, path: str, load) -> DataFrame:
    """path, i, j, value of 2-D arrays in binary files, missing for NaN; one file is read in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for layer, a in enumerate(load(data)):
                    for top in range(0, a.shape[0], max(1, 100_000 // max(a.shape[1], 1))):
                        part = a[top : top + max(1, 100_000 // max(a.shape[1], 1))]
                        i, j = np.indices(part.shape, dtype=np.int32)
                        v = part.astype(float).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array([name] * v.size), pa.array(np.full(v.size, layer, np.int32)), pa.array(i.ravel() + np.int32(top)), pa.array(j.ravel()), pa.array(v, mask=np.isnan(v))], ["path", "layer", "i", "j", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, layer int, i int, j int, value double")


def raster_chart(spark: SparkSession, path: str, factor: float = 10.0) -> DataFrame:
    """Rasterised charts stored as arrays; grades times ten are percent."""
    return _arrays(spark, path, lambda data: [np.load(io.BytesIO(data), allow_pickle=False)]).withColumn("value", F.col("value") * factor)


def flat_grid(spark: SparkSession, path: str, rows: int = 448, cols: int = 304, fill: float = -32768.0) -> DataFrame:
    """i, j, lat, lon of a file of two float arrays, one after the other."""

    def load(data: bytes) -> list[np.ndarray]:
        a = np.frombuffer(data, "<f4").reshape(2, rows, cols).astype(float)
        return list(np.where(a == fill, np.nan, a))

    both = _arrays(spark, path, load)
    return both.groupBy("i", "j").agg(*[F.max(F.when(F.col("layer") == k, F.col("value"))).alias(n) for k, n in enumerate(("lat", "lon"))])


def drift_chart(chart: DataFrame, cells: DataFrame, region: str) -> DataFrame:
    """date, i, j, u, v in cm/s of a chart (date, x0, y0, w_drift, d_drift) over a cell map (x0, y0, region, i, j)."""
    a = F.radians(F.lit(90.0) - F.col("d_drift"))
    speed = F.col("w_drift") * CHART_SPEED
    rows = chart.dropna().join(cells.where(F.col("region") == region), ["x0", "y0"])
    return rows.select("date", "i", "j", (speed * F.cos(a)).alias("u"), (speed * F.sin(a)).alias("v"))


# clean-up rules of decoded products


def packed(raw: Column, scale: float, least: float = -32767) -> Column:
    """Packed integers: fill values are missing, others are scaled."""
    return F.when(raw > least, raw * F.lit(scale))


def model_ice(value: Column, is_land: Column, scale: float = 1.0) -> Column:
    """Missing is no ice, then land is missing."""
    return F.when(~is_land, F.coalesce(value, F.lit(0.0)) * scale)


def still_is_missing(steps: DataFrame) -> DataFrame:
    """Cells whose component is 0 at all steps of a day are missing."""
    keys = ["dataset", "date", "channel", "i", "j"]
    still = steps.groupBy(*keys).agg(F.max(F.abs("value")).alias("top"))
    return steps.join(still, keys).withColumn("value", F.when(F.col("top") != 0, F.col("value"))).drop("top")


def wrapped_lon(grid: DataFrame) -> DataFrame:
    return grid.withColumn("lon", wrap_longitude(F.col("lon")))


def constant(grid: DataFrame, name: str, values: Sequence[float], start: str, end: str) -> DataFrame:
    """A field that has the same value of each channel everywhere, on dates from start up to end."""
    dates = F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("date")
    rows = grid.select("i", "j", dates).select("*", F.posexplode(F.array(*map(F.lit, values))).alias("channel", "value"))
    return rows.select(F.lit(name).alias("dataset"), "date", "channel", "i", "j", F.col("value").cast("double"))


def sequence_steps(steps: DataFrame, starts: DataFrame, length: int, every_h: int = 1) -> DataFrame:
    """start_ts, step and the rows at it, for starts that have every step. steps: ts, ...; starts: start_ts."""
    need = starts.select("start_ts", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step")).withColumn("ts", F.expr(f"start_ts + make_dt_interval(0, step * {every_h}, 0, 0)"))
    have = need.join(steps.select("ts").distinct(), "ts")
    whole = have.groupBy("start_ts").agg(F.count("*").alias("n")).where(F.col("n") == length).select("start_ts")
    return have.join(whole, "start_ts").join(steps, "ts")


def absent(spark: SparkSession, schema: str = "dataset string, date date, channel int, i int, j int, value double") -> DataFrame:
    """A source that has nothing; what is joined to it keeps its rows."""
    return spark.createDataFrame([], schema)


def earliest_file(rows: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Of rows that several files hold, those of the first file in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), path).alias("r")).select(*keys, "r.*")


def nearest_slice(rows: DataFrame, requests: DataFrame, hours: int) -> DataFrame:
    """request and the rows from the time nearest to its own (requests: request, at) to hours - 1 later, ends included; of two as near, the earlier.

    A slice meets the rows of the hours it touches, by an equality join."""
    one = F.lit(0).alias("all")
    first = nearest_time(rows.select("ts", one).distinct(), requests.select("at", one), ["all"]).where("nearest IS NOT NULL")
    asked = requests.join(first.select("at", "nearest"), "at")
    hour = F.date_trunc("HOUR", "nearest").cast("timestamp_ntz")
    asked = asked.select("request", "nearest", F.explode(F.sequence(F.lit(0), F.lit(hours))).alias("k"), hour.alias("h")).withColumn("hour", F.expr("h + make_dt_interval(0, k, 0, 0)"))
    found = rows.withColumn("hour", F.date_trunc("HOUR", "ts").cast("timestamp_ntz")).join(asked.select("request", "nearest", "hour"), "hour")
    return found.where((F.col("ts") >= F.col("nearest")) & (F.col("ts") <= F.timestamp_add("HOUR", F.lit(hours - 1), F.col("nearest")))).drop("hour")


def write_grid(grid: DataFrame, path: str, title: str) -> None:
    """Store i, j, lat, lon with the units and the title as comments of the columns."""
    notes = {"lat": "degrees_north", "lon": "degrees_east"}
    grid.select("i", "j", *[F.col(c).alias(c, metadata={"comment": u, "title": title}) for c, u in notes.items()]).write.mode("overwrite").parquet(path)


def periods(times: DataFrame, period: str, ts: str = "ts") -> DataFrame:
    """period, n, first, last: the times of each period (a day, month or number of hours such as 6h)."""
    if period.endswith("h"):
        start = F.window(F.col(ts).cast("timestamp"), f"{int(period[:-1])} hours").getField("start")
    else:
        start = F.date_trunc({"D": "DAY", "M": "MONTH"}[period], ts)
    return times.groupBy(start.cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def fused(field: DataFrame, name: str) -> DataFrame:
    """One dataset of the means over all datasets that have a date; missing values are left out."""
    return field.groupBy("date", "channel", "i", "j").agg(F.avg("value").alias("value")).select(F.lit(name).alias("dataset"), "date", "channel", "i", "j", "value")
