"""File catalogs: dates read from file names by rules that are rows of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """How a product's file names hold their date: a pattern with one group, and the group's format."""

    product: str
    pattern: str
    date_format: str


#: Naming conventions.
RULES = (
    Rule("compact_token", r"_(\d{8})[_.]", "yyyyMMdd"),
    Rule("iso_token", r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    Rule("lettered", r"(y\d{4}m\d{2}d\d{2})", "'y'yyyy'm'MM'd'dd"),
    Rule("parent_folder", r"/(\d{8})/[^/]*$", "yyyyMMdd"),
    Rule("dotted_hour", r"\.(\d{10})\.", "yyyyMMddHH"),
    Rule("dotted_day", r"\.(\d{8})\.", "yyyyMMdd"),
)


def date_of(path: Column, rules: Sequence[Rule]) -> Column:
    """The date by the first rule that gives one; a name that fits none has no date."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(path, r.pattern, 1), F.lit("")), F.lit(r.date_format))) for r in rules])


def mid_date(path: Column, pattern: str = r"_(\d{8})_(\d{8})[_.]") -> Column:
    """The middle, rounded down, of the two dates in a name."""
    a, b = (F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(path, pattern, k), F.lit("")), F.lit("yyyyMMdd"))) for k in (1, 2))
    return F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length of all files below a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def by_date(paths: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """date and its files in order; files without a date are left out."""
    return paths.select(date_of(F.col("path"), rules).alias("date"), "path").where("date IS NOT NULL").groupBy("date").agg(F.sort_array(F.collect_list("path")).alias("files"))


def by_variable(paths: DataFrame, variable: Column, rules: Sequence[Rule] = RULES) -> DataFrame:
    """date and a map of variable to file, the last file in order."""
    rows = paths.select(date_of(F.col("path"), rules).alias("date"), variable.alias("variable"), "path").where("date IS NOT NULL AND variable <> ''")
    one = rows.groupBy("date", "variable").agg(F.max("path").alias("path"))
    return one.groupBy("date").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("variable", "path")))).alias("files"))


def one_file_a_date(rows: DataFrame) -> DataFrame:
    """rows (path, date, ...); a date that two files hold is an error."""
    twice = rows.groupBy("date").agg(F.count_distinct("path").alias("n"))
    bad = F.raise_error(F.concat(F.lit("date in several files: "), F.col("date").cast("string"))).cast("date")
    return rows.join(twice, "date").withColumn("date", F.when(F.col("n") == 1, F.col("date")).otherwise(bad)).drop("n")


def unique_layers(inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Layers wanted by their keys; one that matches several rows is an error."""
    n = inventory.groupBy(*keys).agg(F.count("*").alias("n"), F.first(F.struct(*[c for c in inventory.columns if c not in keys])).alias("r"))
    bad = F.raise_error(F.lit("a layer isn't unique")).cast("long")
    return n.withColumn("n", F.when(F.col("n") == 1, F.col("n")).otherwise(bad)).where("n = 1").select(*keys, "r.*")


def layers(inventory: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inventory's row of each wanted layer; one that matches none or several is an error."""
    rest = [c for c in inventory.columns if c not in keys]
    found = wanted.select(*keys).distinct().join(inventory.withColumn("hit", F.lit(1)), list(keys), "left")
    one = found.groupBy(*keys).agg(F.count("hit").alias("n"), F.first(F.struct(*rest)).alias("r"))
    bad = F.raise_error(F.concat(F.lit("layers that match: "), F.col("n").cast("string"))).cast("long")
    return one.withColumn("n", F.when(F.col("n") == 1, F.col("n")).otherwise(bad)).where("n = 1").select(*keys, "r.*")
