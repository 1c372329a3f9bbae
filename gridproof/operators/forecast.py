"""Forecast runs: rows (init_time, lead_h, valid_time, value, ...) and windows over valid times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(forecast: DataFrame) -> DataFrame:
    """A row per run: its leads in order, first and last valid time."""
    return forecast.groupBy("init_time").agg(F.sort_array(F.collect_set("lead_h")).alias("leads"), F.min("valid_time").alias("first_valid"), F.max("valid_time").alias("last_valid"))


def with_valid_time(forecast: DataFrame) -> DataFrame:
    return forecast.withColumn("valid_time", F.expr("init_time + make_dt_interval(0, lead_h, 0, 0)"))


def lead_report(forecast: DataFrame, expected_max: int, expected_step: int) -> DataFrame:
    """Per run: whether a lead is negative, the last lead is as expected, and all steps are."""
    one = forecast.select("init_time", "lead_h").distinct()
    step = F.col("lead_h") - F.lag("lead_h").over(Window.partitionBy("init_time").orderBy("lead_h"))
    flags = one.withColumn("step", step).groupBy("init_time").agg(F.min("lead_h").alias("lo"), F.max("lead_h").alias("max_lead"), F.max(F.when(F.col("step") != expected_step, 1).otherwise(0)).alias("odd"))
    return flags.select("init_time", "max_lead", (F.col("lo") < 0).alias("negative"), (F.col("max_lead") == expected_max).alias("max_ok"), (F.col("odd") == 0).alias("step_ok"))


def valid_index(forecast: DataFrame) -> DataFrame:
    """valid_time and its (init_time, lead_h), in order of init."""
    return forecast.groupBy("valid_time").agg(F.sort_array(F.collect_set(F.struct("init_time", "lead_h"))).alias("refs"))


def run_leads(forecast: DataFrame, init: Column, leads: Sequence[int]) -> DataFrame:
    """Rows of one run with their place among the wanted leads; a lead it lacks is an error."""
    wanted = forecast.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, leads))).alias("place", "lead_h"))
    found = F.broadcast(wanted).join(forecast.where(F.col("init_time") == init), "lead_h", "left")  # the wanted leads: a short list
    bad = F.raise_error(F.concat(F.lit("the run has no lead "), F.col("lead_h").cast("string")))
    return found.withColumn("init_time", F.when(F.col("init_time").isNotNull(), F.col("init_time")).otherwise(bad.cast("timestamp_ntz")))


def slots(forecast: DataFrame, anchors: DataFrame, length: int, step_h: int, n_slots: int, future: bool = False, order: str = "newest") -> DataFrame:
    """anchor, step, valid_time, slot, init_time, lead_h: the ranked runs for each step of a window.

    Runs that begin after the anchor count only with ``future``."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step")
    spine = anchors.select("anchor", steps).withColumn("valid_time", F.expr(f"anchor + make_dt_interval(0, step * {step_h}, 0, 0)"))
    refs = forecast.select("init_time", "lead_h", "valid_time").distinct()
    rows = spine.join(refs, "valid_time")
    if not future:
        rows = rows.where("init_time <= anchor")
    rank = F.row_number().over(Window.partitionBy("anchor", "step").orderBy(F.col("init_time").desc() if order == "newest" else F.col("init_time")))
    return rows.withColumn("slot", rank - 1).where(F.col("slot") < n_slots).select("anchor", "step", "valid_time", "slot", "init_time", "lead_h")


def anchors(forecast: DataFrame, length: int, step_h: int, future: bool = False, incomplete: bool = False) -> DataFrame:
    """Valid times whose every window step has a run; with ``incomplete`` any step."""
    times = forecast.select(F.col("valid_time").alias("anchor")).distinct()
    have = slots(forecast, times, length, step_h, 1, future).groupBy("anchor").agg(F.countDistinct("step").alias("n"))
    return have.where(F.col("n") >= (1 if incomplete else length)).select("anchor")


def windows(forecast: DataFrame, wanted: DataFrame, length: int, step_h: int, n_slots: int, future: bool = False, order: str = "newest", fill: float = 0.0) -> DataFrame:
    """A row per anchor, slot and step: value (filled), lead_h (-1 where absent) and avail."""
    spine = wanted.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step")).select("anchor", "step", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("slot"))
    refs = slots(forecast, wanted, length, step_h, n_slots, future, order)
    rows = spine.join(refs.select("anchor", "step", "slot", "init_time", "lead_h"), ["anchor", "step", "slot"], "left")
    rows = rows.join(forecast.select("init_time", "lead_h", "value"), ["init_time", "lead_h"], "left")
    return rows.select("anchor", "slot", "step", F.coalesce("value", F.lit(fill)).alias("value"), F.coalesce("lead_h", F.lit(-1)).alias("lead_h"), F.col("init_time").isNotNull().alias("avail"))


def analysis_lead(ts: Column) -> tuple[Column, Column]:
    """init_time, lead_h of six-hourly analyses: before 06 the 12Z run of the day before, before 18
    the 00Z run, else the 12Z run; leads are 6 or 12, others are missing."""
    h = F.hour(ts)
    day = F.date_trunc("DAY", ts).cast("timestamp_ntz")
    back = F.when(h < 6, -12).when(h < 18, 0).otherwise(12)
    lead = h - back
    return F.timestamp_add("HOUR", back, day), F.when(lead.isin(6, 12), lead)


def checked(forecast: DataFrame, expected_max: int, expected_step: int, strict: bool = True) -> DataFrame:
    """The forecast as it is; a negative lead is an error, with ``strict`` an unexpected last lead or step too."""
    flags = lead_report(forecast, expected_max, expected_step)
    wrong = F.when(F.col("negative"), F.lit("a negative lead in run "))
    if strict:
        wrong = wrong.when(~F.col("max_ok"), F.lit("an unexpected last lead in run ")).when(~F.col("step_ok"), F.lit("an unexpected step of leads in run "))
    told = flags.select("init_time", wrong.otherwise(F.lit(None)).alias("wrong"))
    bad = F.raise_error(F.concat("wrong", F.col("init_time").cast("string"))).cast("timestamp_ntz")
    # the reports are a row per run; the forecast's rows of a run meet it once
    return forecast.join(told, "init_time").withColumn("init_time", F.when(F.col("wrong").isNull(), F.col("init_time")).otherwise(bad)).select(*forecast.columns)


def runs_with(forecast: DataFrame, leads: Sequence[int]) -> DataFrame:
    """init_time of the runs that have all the leads."""
    have = forecast.where(F.col("lead_h").isin(list(leads))).groupBy("init_time").agg(F.count_distinct("lead_h").alias("n"))
    return have.where(F.col("n") == len(set(leads))).select("init_time")


def leads_of(forecast: DataFrame, inits: DataFrame, leads: Sequence[int]) -> DataFrame:
    """init_time, place, lead_h and the rest for each wanted run, in the order of the wanted leads; a lead that a run lacks is an error."""
    wanted = inits.select("init_time", F.posexplode(F.array(*map(F.lit, leads))).alias("place", "lead_h"))
    rows = wanted.join(forecast.withColumn("found", F.lit(True)), ["init_time", "lead_h"], "left")
    bad = F.raise_error(F.concat(F.lit("the run has no lead "), F.col("lead_h").cast("string"))).cast("int")
    rest = [c for c in forecast.columns if c not in ("init_time", "lead_h")]
    return rows.select("init_time", "place", F.when(F.col("found"), F.col("lead_h")).otherwise(bad).alias("lead_h"), *rest)


def for_valid(forecast: DataFrame, times: DataFrame) -> DataFrame:
    """All forecasts for each wanted valid time (times: valid_time), with their place in order of init."""
    place = F.row_number().over(Window.partitionBy("valid_time").orderBy("init_time", "lead_h")) - 1
    return forecast.join(times.select("valid_time").distinct(), "valid_time", "left_semi").withColumn("place", place)


def analyses(forecast: DataFrame, times: DataFrame, variables: Sequence[str]) -> DataFrame:
    """ts, init_time, lead_h, variable, value of six-hourly analyses (times: ts); a time that lacks one of the variables is left out."""
    init, lead = analysis_lead(F.col("ts"))
    asked = times.select("ts", init.alias("init_time"), lead.alias("lead_h")).where("lead_h IS NOT NULL")
    rows = asked.join(forecast.where(F.col("variable").isin(list(variables))), ["init_time", "lead_h"])
    whole = rows.groupBy("ts").agg(F.count_distinct("variable").alias("n")).where(F.col("n") == len(set(variables))).select("ts")
    return rows.join(whole, "ts").select("ts", "init_time", "lead_h", "variable", "value")
