"""Time axes: hourly grids, local days and lead times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brierworks.operators.ordering import join_keys, tail_n, ts_number
from brierworks.params import DEFAULTS, Params


def to_local(ts: Column, tz: Column) -> Column:
    """Wall-clock time of a UTC instant in a zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), tz)


def local_date(ts: Column, tz: Column) -> Column:
    return F.to_date(to_local(ts, tz))


def hourly_axis(keys: DataFrame, start: Column, days: int) -> DataFrame:
    """SRC-07: ``days`` x 24 hourly UTC instants for every key row."""
    end = start + F.expr(f"interval {days * 24 - 1} hours")
    return keys.withColumn("valid_time", F.explode(F.sequence(start, end, F.expr("interval 1 hour"))))


def reindex_hourly(df: DataFrame, keys: list[str], start: Column, days: int, at: str = "valid_time") -> DataFrame:
    """SRC-07: put a series on the hourly axis; hours without a value become NULL."""
    axis = hourly_axis(df.select(*keys).distinct(), start, days)
    return axis.join(df.withColumnRenamed(at, "valid_time"), [*keys, "valid_time"], "left")


def local_targets(axis: DataFrame, keys: list[str], tz: str, limit: int, at: str = "valid_time") -> DataFrame:
    """SRC-08: the first ``limit`` local dates an axis covers, per key."""
    days = axis.select(*keys, local_date(F.col(at), F.col(tz)).alias("target_date")).distinct()
    return tail_n(days, keys, [F.col("target_date")], limit)


def backfill_daily(daily: DataFrame, hourly: DataFrame, stations: DataFrame, at: str = "ts", temp: str = "temp_f") -> DataFrame:
    """SRC-09: missing highs and lows from the hourly extremes of the local day."""
    per_day = (
        join_keys(hourly, stations.select("station_id", "tz"), ["station_id"])
        .groupBy("station_id", local_date(F.col(at), F.col("tz")).alias("target_date"))
        .agg(F.max(temp).alias("_hi"), F.min(temp).alias("_lo"))
    )
    return (
        daily.join(per_day, ["station_id", "target_date"], "left")
        .withColumn("high_f", F.coalesce("high_f", "_hi"))
        .withColumn("low_f", F.coalesce("low_f", "_lo"))
        .drop("_hi", "_lo")
    )


def periods_to_daily(df: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-10: day periods give the high, night periods the low."""
    day = F.col("is_day")
    return df.groupBy(*keys).agg(
        F.max(F.when(day, F.col("temp_f"))).alias("high_f"), F.min(F.when(~day, F.col("temp_f"))).alias("low_f")
    )


def lead_hours(daily: DataFrame, hourly: DataFrame, stations: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """PRJ-03: hours from issue to the local day's extreme, or to the usual hour of it."""
    at = F.struct(F.col("temp_f"), -ts_number(F.col("ts")))
    at_low = F.struct(F.col("temp_f"), ts_number(F.col("ts")))
    zones = stations.select("station_id", "tz")
    peaks = (
        join_keys(hourly, zones, ["station_id"])
        .groupBy("station_id", local_date(F.col("ts"), F.col("tz")).alias("target_date"))
        .agg(F.max_by("ts", at).alias("HIGH"), F.min_by("ts", at_low).alias("LOW"))
        .unpivot(["station_id", "target_date"], ["HIGH", "LOW"], "target_type", "peak_at")
    )
    both = join_keys(daily, zones, ["station_id"]).withColumn(
        "target_type", F.explode(F.array(F.lit("HIGH"), F.lit("LOW")))
    )
    hour = F.when(F.col("target_type") == "HIGH", p.anchor_hour_high).otherwise(p.anchor_hour_low)
    wall = F.col("target_date").cast("timestamp") + F.make_interval(hours=hour)
    anchor = F.to_utc_timestamp(wall, F.col("tz"))
    out = both.join(peaks, ["station_id", "target_date", "target_type"], "left")
    target = F.coalesce(F.col("peak_at").cast("timestamp"), anchor)
    return out.select(
        "run_id", "station_id", "target_date", "target_type",
        ((ts_number(target) - ts_number(F.col("issued_at"))) / 3.6e9).alias("lead_hours"),
    )
