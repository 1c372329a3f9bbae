"""Products as rows: how a product's files are named, and how its decoded values are cleaned.

Both are tables, so a new product is a new row, and files or values of all products go through one
pass: a file meets the rules of its product in their order and takes the first that gives a time; a
value meets the steps of its product in theirs. The tables are short and are joined as such."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.functions.scalars import wrap_longitude


@dataclass(frozen=True)
class Naming:
    """One way in which the files of a product tell their time; ``place`` is its order among the product's ways.

    files: a pattern of the paths it is for. pattern: where the time stands in a path. kind says what its groups are:
    ``time`` (its text in one of the formats; several groups are joined), ``month`` (its first day), ``middle`` (the
    middle, rounded down, of the days of two groups), ``lead`` (the start of a run, and hours after it as the last
    group), or ``content`` (the time is what the file itself says)."""

    product: str
    place: int
    files: str
    pattern: str
    formats: tuple[str, ...]
    kind: str = "time"


@dataclass(frozen=True)
class Step:
    """One step of a product's clean-up; ``place`` is its order.

    what: ``scale`` (times ``number``), ``above`` (values up to it are missing), ``fill`` (it is missing), ``zero`` (missing
    is 0), ``no_land`` (land is missing), ``no_still`` (missing where it is 0 at all steps of a day)."""

    product: str
    place: int
    what: str
    number: float | None = None


KINDS = ("time", "month", "middle", "lead", "content")
STEPS = ("scale", "above", "fill", "zero", "no_land", "no_still")
_DAY, _ISO = "yyyyMMdd", "yyyy-MM-dd"
#: Naming conventions.
NAMINGS = (
    Naming("second_token", 0, r"/second_", r"/[^/_]+_(\d{8})_[^/]*$", (_DAY,)),
    Naming("stem_token", 0, r"/stem-[^/]*$", r"/stem-(\d{4}-\d{2}-\d{2})\.", (_ISO,)),
    Naming("period", 0, r"/period(_[^/_]+){6}_", r"/period(?:_[^/_]+){6}_(\d{8})_(\d{8})[_.]", (_DAY,), "middle"),
    Naming("first_token", 0, r"/\d{4}-\d{2}-\d{2}_[^/]*$", r"/(\d{4}-\d{2}-\d{2})_[^/]*$", (_ISO,)),
    Naming("lettered", 0, r"/grid_y\d", r"_(y\d{4}m\d{2}d\d{2})[_.]", ("'y'yyyy'm'MM'd'dd",)),
    Naming("dated_folder", 0, r"/\d{8}/[^/]*$", r"/(\d{8})/[^/]*$", (_DAY,)),
    Naming("dotted_hour", 0, r"\.\d{10}\.", r"\.(\d{10})\.", ("yyyyMMddHH",)),
    Naming("valid_time", 0, r"/valid_", r"/valid_(\d{8}|\d{4}-\d{2}-\d{2})_(\d{2})[^/]*$", ("yyyyMMddHH", "yyyy-MM-ddHH")),
    Naming("valid_time", 1, r"/valid_", r"/valid_(\d{10})_f(\d+)[^/]*$", ("yyyyMMddHH",), "lead"),
    Naming("valid_time", 2, r"/valid_", "", (), "content"),
    Naming("before_last", 0, r"/before_", r"_(\d{4}-\d{2}-\d{2})_[^/_]+$", (_ISO,)),
    Naming("third_token", 0, r"/third_", r"/[^/_]+_[^/_]+_(\d{4}-\d{2}-\d{2})_", (_ISO,)),
    Naming("last_token", 0, r"/last_", r"_(\d{4}-\d{2}-\d{2})\.[^/]*$", (_ISO,)),
    Naming("last_month", 0, r"/monthly_", r"_(\d{4}-\d{2})\.[^/]*$", ("yyyy-MM",), "month"),
    Naming("dotted_day", 0, r"/day\.", r"\.(\d{8})\.", (_DAY,)),
    Naming("run", 0, r"/run_", r"_(\d{8})_(\d{2})\.[^/]*$", ("yyyyMMddHH",)),
    Naming("track", 0, r"/track_", r"_(y\d{4}m\d{2}d\d{2})[_.]", ("'y'yyyy'm'MM'd'dd",)),
    Naming("track", 1, r"/track_", "", (), "content"),
)
#: Clean-up of products, in order.
CLEANING = (
    Step("model_concentration", 0, "zero"), Step("model_concentration", 1, "no_land"), Step("model_concentration", 2, "scale", 100.0),
    Step("model_thickness", 0, "zero"), Step("model_thickness", 1, "no_land"),
    Step("model_drift", 0, "scale", 100.0),
    Step("reanalysis_drift", 0, "no_still"), Step("reanalysis_drift", 1, "scale", 100.0),
    Step("packed_concentration", 0, "above", -32767.0), Step("packed_concentration", 1, "scale", 0.01),
    Step("packed_drift", 0, "fill", -32768.0), Step("packed_drift", 1, "scale", 0.01),
    Step("daily_drift", 0, "fill", -32768.0),
    Step("chart_concentration", 0, "scale", 10.0),
)
#: Products whose longitudes are turned into -180 to 180.
WRAPPED = ("valid_time", "dotted_day", "before_last", "third_token", "last_token", "last_month")


def namings(spark: SparkSession, rows: Sequence[Naming] = NAMINGS) -> DataFrame:
    if bad := [n for n in rows if n.kind not in KINDS]:
        raise ValueError(f"no such kind: {bad}")
    return spark.createDataFrame([(*astuple(n)[:4], list(n.formats), n.kind) for n in rows], "product string, place int, files string, pattern string, formats array<string>, kind string")


def dated(paths: DataFrame, rules: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """path, product, ts, date by the product's first rule that gives a time; of several products each; a name that fits none has no row, one whose rules all fail no time.

    paths: path; rules: of ``namings``; content: path, ts as files themselves say it."""
    files = paths.select("path").distinct()
    said = F.lit(None).cast("timestamp_ntz")
    if content is not None:
        files, said = files.join(content.groupBy("path").agg(F.min("ts").alias("said")), "path", "left"), F.col("said")
    # the rules are a short list, and a path meets those of its own product alone
    met = files.join(F.broadcast(rules), F.expr("path rlike files"))
    groups = F.expr("regexp_extract_all(path, pattern, 0)")
    part = lambda k: F.expr(f"regexp_extract(path, pattern, {k})")
    # groups that capture, of which a pattern has two at most
    both = F.expr("CASE WHEN pattern RLIKE '[(](?![?]).*[(](?![?])' THEN concat(regexp_extract(path, pattern, 1), regexp_extract(path, pattern, 2)) ELSE regexp_extract(path, pattern, 1) END")
    text = F.when(F.col("kind").isin("middle", "lead"), part(1)).otherwise(both)
    read = lambda t: F.get(F.filter(F.transform("formats", lambda f: F.try_to_timestamp(t, f).cast("timestamp_ntz")), lambda x: x.isNotNull()), 0)
    fits = (F.col("pattern") != "") & (F.size(groups) > 0)
    first, second = read(text), read(part(2))
    middle = F.date_add(F.to_date(first), F.floor(F.datediff(F.to_date(second), F.to_date(first)) / 2).cast("int")).cast("timestamp_ntz")
    later = F.timestamp_add("HOUR", part(2).try_cast("int"), first).cast("timestamp_ntz")
    of = F.when(F.col("kind") == "content", said).when(~fits, None).when(F.col("kind") == "middle", middle).when(F.col("kind") == "lead", later).when(F.col("kind") == "month", F.date_trunc("MONTH", first).cast("timestamp_ntz")).otherwise(first)
    best = met.withColumn("ts", of).groupBy("path", "product").agg(F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("place"))).alias("ts"))
    return best.select("path", "product", "ts", F.to_date("ts").alias("date"))


def steps(spark: SparkSession, rows: Sequence[Step] = CLEANING) -> DataFrame:
    """product, clean: the steps of each product in order."""
    if bad := [s for s in rows if s.what not in STEPS]:
        raise ValueError(f"no such step: {bad}")
    flat = spark.createDataFrame([astuple(s) for s in rows], "product string, place int, what string, number double")
    return flat.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("place", "what", "number"))).alias("clean"))


def cleaned(rows: DataFrame, rules: DataFrame, cell: Sequence[str] = ("dataset", "date", "channel", "i", "j")) -> DataFrame:
    """The rows (product, ``cell``, is_land, value) after the clean-up of their product; a product without steps keeps its values.

    Rows of one cell are steps of a day; only products that look at a whole day are grouped."""
    met = rows.join(F.broadcast(rules), "product", "left")
    has = lambda what: F.coalesce(F.exists("clean", lambda s: s["what"] == what), F.lit(False))
    still = met.where(has("no_still")).groupBy("product", *cell).agg((F.max(F.abs("value")) == 0).alias("still"))
    keys = ["product", *cell]
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = met.where(has("no_still")).alias("r").join(still.alias("s"), on, "left").select("r.*", "still")
    every = met.where(~has("no_still")).withColumn("still", F.lit(False)).unionByName(joined)

    def step(v: Column, s: Column) -> Column:
        is_what = lambda w: s["what"] == w
        return (
            F.when(is_what("scale"), v * s["number"]).when(is_what("above"), F.when(v > s["number"], v)).when(is_what("fill"), F.when(v != s["number"], v))
            .when(is_what("zero"), F.coalesce(v, F.lit(0.0))).when(is_what("no_land"), F.when(~F.coalesce("is_land", F.lit(False)), v)).when(is_what("no_still"), F.when(~F.coalesce("still", F.lit(False)), v)).otherwise(v)
        )

    value = F.aggregate(F.coalesce("clean", F.array().cast("array<struct<place:int,what:string,number:double>>")), F.col("value").cast("double"), step)
    return every.withColumn("value", value).select(*rows.columns)


def turned(grids: DataFrame, products: Sequence[str] = WRAPPED) -> DataFrame:
    """Grids (product, i, j, lat, lon) with the longitudes of the named products between -180 and 180."""
    return grids.withColumn("lon", F.when(F.col("product").isin(list(products)), wrap_longitude(F.col("lon"))).otherwise(F.col("lon")))
