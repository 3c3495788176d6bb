"""Forecast documents: validation, parallel arrays, provider shapes, ISO intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brierworks.functions.scalar import convert_units

# Output name -> accepted spellings of the hourly series, first match wins.
HOURLY_ALIASES = {
    "temperature_f": ("temperature_f", "temperature_2m"),
    "dewpoint_f": ("dewpoint_f", "dew_point_2m"),
    "humidity_pct": ("humidity_pct", "relative_humidity_2m"),
    "wind_speed_mph": ("wind_speed_mph", "wind_speed_10m"),
    "wind_dir_deg": ("wind_dir_deg", "wind_direction_10m"),
    "cloud_cover_pct": ("cloud_cover_pct", "cloud_cover"),
    "precip_prob_pct": ("precip_prob_pct", "precipitation_probability"),
}

_SERIES = ", ".join(f"{a}: array<string>" for names in HOURLY_ALIASES.values() for a in names)
# numbers are read as text so that numeric strings and numbers arrive alike
PAYLOAD = (
    "issued_at string, daily array<struct<target_date: string, high_f: string, low_f: string>>, "
    f"hourly struct<time: array<string>, {_SERIES}>, _corrupt string"
)


def parse_payloads(raw: DataFrame, col: str = "raw_json") -> DataFrame:
    """Documents as structs with the reason they are unusable, NULL when they are fine."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # generating the parsed document keeps later filters from parsing it once more
    doc = raw.select("*", F.explode(F.array(F.from_json(F.col(col), PAYLOAD, opts))).alias("doc"))
    reason = (
        F.when(F.col("doc").isNull() | F.col("doc._corrupt").isNotNull() & F.col("doc.issued_at").isNull() & F.col("doc.daily").isNull(), "not_a_document")
        .when(F.coalesce(F.trim("doc.issued_at"), F.lit("")) == "", "issued_at")
        .when(F.col("doc.daily").isNull(), "daily")
    )
    return doc.withColumn("reason", reason)


def ingest_payloads(raw: DataFrame, col: str = "raw_json") -> tuple[DataFrame, DataFrame]:
    """SRC-03: usable documents, and the quarantined ones with the reason."""
    parsed = parse_payloads(raw, col)
    good = parsed.filter(F.col("reason").isNull()).drop("reason", col).withColumn("issued_at", F.trim("doc.issued_at"))
    bad = parsed.filter(F.col("reason").isNotNull()).drop("doc")
    return good, bad


def daily_rows(good: DataFrame, valid: tuple[float, float] | None = None) -> DataFrame:
    """SRC-03: daily rows; short dates and non-numeric temperatures are dropped."""
    keep = [c for c in good.columns if c != "doc"]
    rows = good.select(*keep, F.explode("doc.daily").alias("_d")).select(
        *keep,
        F.substring("_d.target_date", 1, 10).alias("_td"),
        F.col("_d.high_f").try_cast("double").alias("high_f"),
        F.col("_d.low_f").try_cast("double").alias("low_f"),
    )
    rows = rows.filter((F.length("_td") >= 10) & F.col("high_f").isNotNull() & F.col("low_f").isNotNull())
    if valid is not None:
        rows = rows.filter(F.col("high_f").between(*valid) & F.col("low_f").between(*valid))
    return rows.withColumn("target_date", F.to_date("_td")).drop("_td")


def explode_hourly(good: DataFrame) -> DataFrame:
    """SRC-04: parallel arrays to rows, cut to the shortest array, with alternative series names."""
    keep = [c for c in good.columns if c != "doc"]
    series = {k: F.coalesce(*[F.col(f"doc.hourly.{a}") for a in names]) for k, names in HOURLY_ALIASES.items()}
    base = good.select(*keep, F.col("doc.hourly.time").alias("_time"), *[c.alias(f"_{k}") for k, c in series.items()])
    n = F.least(F.size("_time"), *[F.when(F.col(f"_{k}").isNotNull(), F.size(f"_{k}")) for k in series])
    rows = base.select(*keep, F.posexplode(F.slice("_time", 1, n)).alias("_i", "valid_time"), *[f"_{k}" for k in series])
    rows = rows.filter(F.trim("valid_time") != "")
    values = [F.get(F.col(f"_{k}"), F.col("_i")).try_cast("double").alias(k) for k in series]
    return rows.select(*keep, F.trim("valid_time").alias("valid_time"), *values)


_HOUR_VALUES = ("temperature_f", "dewpoint_f", "humidity_pct", "wind_speed_mph", "wind_dir_deg", "cloud_cover_pct", "precip_prob_pct")

# Field names of the three provider document shapes.
SHAPES = {
    "days": {
        "schema": "days array<struct<datetime: string, tempmax: double, tempmin: double, hours: array<struct<"
        "datetimeEpoch: bigint, temp: double, dew: double, humidity: double, windspeed: double, winddir: double, cloudcover: double, precipprob: double>>>>",
        "hour": ("temp", "dew", "humidity", "windspeed", "winddir", "cloudcover", "precipprob"),
    },
    "timelines": {
        "schema": "timelines array<struct<timestep: string, intervals: array<struct<startTime: string, values: struct<"
        "temperatureMax: double, temperatureMin: double, temperature: double, dewPoint: double, humidity: double, windSpeed: double, windDirection: double, cloudCover: double, precipitationProbability: double>>>>>",
        "hour": ("temperature", "dewPoint", "humidity", "windSpeed", "windDirection", "cloudCover", "precipitationProbability"),
    },
    "forecastday": {
        "schema": "forecastday array<struct<date: string, day: struct<maxtemp_f: double, mintemp_f: double>, hour: array<struct<"
        "time_epoch: bigint, temp_f: double, dewpoint_f: double, humidity: double, wind_mph: double, wind_degree: double, cloud: double, chance_of_rain: double>>>>",
        "hour": ("temp_f", "dewpoint_f", "humidity", "wind_mph", "wind_degree", "cloud", "chance_of_rain"),
    },
}


def flatten_provider(df: DataFrame, shape: str, keys: list[str], col: str = "raw_json") -> tuple[DataFrame, DataFrame]:
    """SRC-05: daily and hourly rows of one provider shape. Instants are cut to the hour; within an
    hour the last non-NULL value of each series counts."""
    spec = SHAPES[shape]
    doc = df.select(*keys, F.from_json(col, spec["schema"]).alias("d"))
    hour_of = lambda e: F.date_trunc("hour", F.timestamp_seconds(e))
    if shape == "days":
        day = doc.select(*keys, F.posexplode("d.days").alias("_p", "x"))
        daily = day.select(*keys, F.substring("x.datetime", 1, 10).alias("_d"), F.col("x.tempmax").alias("high_f"), F.col("x.tempmin").alias("low_f"))
        hours = day.select(*keys, "_p", F.posexplode("x.hours").alias("_q", "h")).withColumn("_t", hour_of(F.col("h.datetimeEpoch")))
        get = lambda f: F.col(f"h.{f}")
    elif shape == "forecastday":
        day = doc.select(*keys, F.posexplode("d.forecastday").alias("_p", "x"))
        daily = day.select(*keys, F.substring("x.date", 1, 10).alias("_d"), F.col("x.day.maxtemp_f").alias("high_f"), F.col("x.day.mintemp_f").alias("low_f"))
        hours = day.select(*keys, "_p", F.posexplode("x.hour").alias("_q", "h")).withColumn("_t", hour_of(F.col("h.time_epoch")))
        get = lambda f: F.col(f"h.{f}")
    else:
        line = doc.select(*keys, F.posexplode("d.timelines").alias("_p", "x"))
        iv = line.select(*keys, "_p", "x.timestep", F.posexplode("x.intervals").alias("_q", "h"))
        daily = iv.filter("timestep = '1d'").select(
            *keys, F.substring("h.startTime", 1, 10).alias("_d"), F.col("h.values.temperatureMax").alias("high_f"), F.col("h.values.temperatureMin").alias("low_f")
        )
        hours = iv.filter("timestep = '1h'").withColumn("_t", F.date_trunc("hour", F.to_timestamp("h.startTime")))
        get = lambda f: F.col(f"h.values.{f}")
    daily = daily.filter(F.col("_d") != "").withColumn("target_date", F.to_date("_d")).drop("_d")
    place = F.struct("_p", "_q")
    last = [F.max_by(get(f), F.when(get(f).isNotNull(), place)).alias(n) for n, f in zip(_HOUR_VALUES, spec["hour"])]
    hourly = hours.filter(F.col("_t").isNotNull()).groupBy(*keys, F.col("_t").cast("timestamp_ntz").alias("valid_time")).agg(*last)
    return daily, hourly


DURATION = r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"


def duration_hours(text: Column) -> Column:
    """Whole hours of an ISO duration, at least one; unreadable ones count as one."""
    part = lambda i: F.coalesce(F.regexp_extract(text, DURATION, i).try_cast("int"), F.lit(0))
    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    return F.greatest(F.lit(1), F.bround(seconds / 3600.0, 0).cast("int"))


def expand_intervals(
    df: DataFrame, keys: list[str], order: str, kind: str, start: Column, end: Column,
    interval: str = "valid_time", value: str = "value", uom: str = "uom",
) -> DataFrame:
    """SRC-06: values stated for an ISO interval become hourly rows on the axis; where intervals of
    one series overlap, the later entry wins."""
    pieces = F.split(F.col(interval), "/")
    first = F.to_timestamp(F.get(pieces, F.lit(0)))
    rows = (
        df.withColumn("_a", first)
        .withColumn("_n", duration_hours(F.get(pieces, F.lit(1))))
        .withColumn("_v", convert_units(F.col(value), F.col(uom), kind))
        .filter(F.col("_a").isNotNull() & F.col("_v").isNotNull() & (F.size(pieces) == 2))
        .withColumn("_t", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda h: F.date_trunc("hour", F.col("_a") + F.make_interval(hours=h)))))
        .filter((F.col("_t") >= start) & (F.col("_t") <= end))
    )
    return rows.groupBy(*keys, F.col("_t").cast("timestamp_ntz").alias("valid_time")).agg(F.max_by("_v", order).alias("value"))


def expand_periods(df: DataFrame, keys: list[str], order: str, start: Column, end: Column, begin: str = "start_time", finish: str = "end_time", value: str = "value") -> DataFrame:
    """SRC-06: [start, end) periods to hourly rows."""
    a, b = F.date_trunc("hour", F.col(begin)), F.date_trunc("hour", F.col(finish))
    rows = (
        df.withColumn("_a", a)
        .withColumn("_b", b)
        .filter((F.col("_a") < F.col("_b")) & F.col(value).isNotNull())
        .withColumn("_t", F.explode(F.sequence(F.col("_a"), F.col("_b") - F.expr("interval 1 hour"), F.expr("interval 1 hour"))))
        .filter((F.col("_t") >= start) & (F.col("_t") <= end))
    )
    return rows.groupBy(*keys, F.col("_t").cast("timestamp_ntz").alias("valid_time")).agg(F.max_by(value, order).alias("value"))
