"""Text reports: station readings, climate summaries and forecast discussions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from brierworks.operators.ordering import join_keys, latest_per_key

# ---------------------------------------------------------------- station readings

# The public METAR group formats.
TEMPERATURE_GROUP = r"\b(M?\d{2})/(M?\d{2})\b"
WIND_GROUP = r"\b(\d{3}|VRB)(\d{2,3})(?:G\d{2,3})?KT\b"
TIME_GROUP = r"\b(\d{2})(\d{2})(\d{2})Z\b"


def _group(c: Column, pattern: str, i: int) -> Column:
    """Capture group, NULL without a match."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(i)), F.lit(0))


def _signed(c: Column) -> Column:
    return F.regexp_replace(c, "^M", "-").cast("int")


def decode_metar(df: DataFrame, col: str = "raw", received: str = "received_at") -> DataFrame:
    """SRC-11: temperature and dew point in F, wind, and the observation instant. The report carries
    only day and time: it belongs to the newest month, up to that of receipt, in which that day has come.
    Months without the day are passed over; no such month in the last three gives NULL."""
    raw = F.col(col)
    to_f = lambda c: F.bround(c * 9.0 / 5.0 + 32.0, 1)
    day, hh, mi = (_group(raw, TIME_GROUP, i).cast("int") for i in (1, 2, 3))
    got = F.to_date(F.col(received).cast("timestamp"))
    months = [F.add_months(F.trunc(got, "month"), -k) for k in range(3)]
    fits = [F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(m))) & (F.date_add(m, day - 1) <= got), m) for m in months]
    at = F.coalesce(*fits).cast("timestamp") + F.make_interval(days=day - 1, hours=hh, mins=mi)
    direction = _group(raw, WIND_GROUP, 1)
    out = (
        df.withColumn("temp_f", to_f(_signed(_group(raw, TEMPERATURE_GROUP, 1))))
        .withColumn("dewpoint_f", to_f(_signed(_group(raw, TEMPERATURE_GROUP, 2))))
        .withColumn("wind_kt", _group(raw, WIND_GROUP, 2).cast("int"))
        .withColumn("wind_dir", F.when(direction != "VRB", direction).cast("int"))
        .withColumn("observed_at", at.cast("timestamp_ntz"))
    )
    return out.filter(F.col("temp_f").isNotNull())


# ---------------------------------------------------------------- climate summaries

# Accepted spellings of the daily maximum and minimum, tried in this order.
TOKEN = r"([\-]?\d+(?:\.\d+)?[A-Za-z]?)"
MAX_PATTERNS = (
    rf"(?i)\bMAXIMUM(?:\s+TEMPERATURE)?\s*[:\-]\s*{TOKEN}\b",
    rf"(?i)\bMAX(?:IMUM)?\s+TEMP(?:ERATURE)?\s*[:\-]\s*{TOKEN}\b",
    rf"(?i)\bHIGH(?:\s+TEMPERATURE)?\s*[:\-]\s*{TOKEN}\b",
    rf"(?i)\bMAXIMUM(?:\s+TEMPERATURE)?(?:\s*\(.*?\))?\s*\.{{2,}}\s*{TOKEN}\b",
    rf"(?im)^\s*MAXIMUM\s+{TOKEN}\b",
)
MIN_PATTERNS = (
    rf"(?i)\bMINIMUM(?:\s+TEMPERATURE)?\s*[:\-]\s*{TOKEN}\b",
    rf"(?i)\bMIN(?:IMUM)?\s+TEMP(?:ERATURE)?\s*[:\-]\s*{TOKEN}\b",
    rf"(?i)\bLOW(?:\s+TEMPERATURE)?\s*[:\-]\s*{TOKEN}\b",
    rf"(?i)\bMINIMUM(?:\s+TEMPERATURE)?(?:\s*\(.*?\))?\s*\.{{2,}}\s*{TOKEN}\b",
    rf"(?im)^\s*MINIMUM\s+{TOKEN}\b",
)
REPORT_DATE = r"\bCLIMATE\s+SUMMARY\s+FOR\s+([A-Z]+)\s+(\d{1,2})\s+(\d{4})\b"
TEMP_RANGE = (-120.0, 140.0)


def _first_token(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[_group(text, p, 1) for p in patterns])


def decode_climate_reports(df: DataFrame, col: str = "text") -> DataFrame:
    """SRC-12: report date, high and low, and whether a value carried a letter. Reports without both
    values, or with impossible ones, are dropped."""
    text = F.col(col)
    number = lambda c: F.bround(F.regexp_extract(c, r"^[\-]?\d+(?:\.\d+)?", 0).try_cast("double"), 1)
    upper = F.upper(text)
    stamp = F.concat_ws(" ", F.initcap(_group(upper, REPORT_DATE, 1)), _group(upper, REPORT_DATE, 2), _group(upper, REPORT_DATE, 3))
    found = F.struct(_first_token(text, MAX_PATTERNS).alias("_hi"), _first_token(text, MIN_PATTERNS).alias("_lo"), stamp.alias("_stamp"))
    # generating the tokens keeps the range filter from matching every pattern once more
    out = (
        df.select("*", F.inline(F.array(found)))
        .withColumn("report_date", F.to_date(F.try_to_timestamp("_stamp", F.lit("MMMM d yyyy"))))
        .withColumn("high_f", number(F.col("_hi")))
        .withColumn("low_f", number(F.col("_lo")))
        .withColumn("had_letter", F.col("_hi").rlike("[A-Za-z]$") | F.col("_lo").rlike("[A-Za-z]$"))
    )
    ok = F.col("high_f").between(*TEMP_RANGE) & F.col("low_f").between(*TEMP_RANGE)
    return out.filter(ok).drop("_hi", "_lo", "_stamp")


def site_matches(text: Column, site: Column) -> Column:
    """A report belongs to a site when it names it."""
    return F.upper(text).contains(F.upper(F.trim(site))) & (F.trim(site) != "")


def resolve_observations(wanted: DataFrame, reports: DataFrame, station_obs: DataFrame, gap: float = 20.0, text: str | None = None) -> DataFrame:
    """SRC-13: the observation of every wanted (station, date).

    Newest matching report first. A report with a letter-suffixed value is set aside when it is more
    than ``gap`` away from the station's own readings. Without a report the readings are used, and
    the result says so. ``reports`` holds station_id, site, report_date (NULL fits any date),
    issued_at, report_id, high_f, low_f, had_letter.
    """
    own = station_obs.groupBy("station_id", "target_date").agg(F.max("temp_f").alias("_ohi"), F.min("temp_f").alias("_olo"))
    keys = ["station_id", "target_date"]
    dated = reports.withColumn("target_date", F.coalesce("report_date", F.to_date("issued_at")))
    if text is not None:
        dated = dated.filter(site_matches(F.col(text), F.col("site")))
    cand = dated.join(own, keys, "left")
    off = (F.abs(F.col("high_f") - F.col("_ohi")) > gap) | (F.abs(F.col("low_f") - F.col("_olo")) > gap)
    fine = cand.filter(~(F.col("had_letter") & F.coalesce(off, F.lit(False))))
    best = latest_per_key(fine, keys, [F.col("issued_at").desc(), F.col("report_id").desc()]).select(*keys, "high_f", "low_f", "report_id")
    out = wanted.join(best, keys, "left").join(own, keys, "left")
    source = F.when(F.col("report_id").isNotNull(), "report").when(F.col("_ohi").isNotNull(), "station_fallback")
    return (
        out.withColumn("obs_source", source)
        .withColumn("observed_high_f", F.coalesce("high_f", "_ohi"))
        .withColumn("observed_low_f", F.coalesce("low_f", "_olo"))
        .filter(F.col("obs_source").isNotNull())
        .select(*keys, "observed_high_f", "observed_low_f", "obs_source", "report_id")
    )


# ---------------------------------------------------------------- discussions

# Phrases of the discussion scan, in plain lower case.
HIGH_CONFIDENCE = ("high confidence", "confident", "highly likely", "strong agreement")
LOW_CONFIDENCE = ("low confidence", "uncertain", "unclear", "difficult forecast", "challenging", "tricky", "split")
DISAGREEMENT = ("model spread", "models disagree", "discrepancy between", "model divergence", "run-to-run", "ensemble spread")
WARM = ("warmer than", "above normal", "higher than")
COOL = ("cooler than", "below normal", "lower than")
# Phrases of the graded scan.
SCORE_HIGH = (
    "high confidence", "confident", "well-defined", "strong agreement", "models agree", "ensemble agreement",
    "high probability", "likely", "expected",
)
SCORE_LOW = (
    "low confidence", "uncertain", "tricky", "models disagree", "spread", "diverge", "difficult", "challenge",
    "unclear", "could go either way", "depends on",
)
EXTREME = (
    "record", "near-record", "dangerously", "well above normal", "well below normal", "heat advisory",
    "freeze warning", "frost advisory",
)


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in phrases])


def _hits(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in phrases])


def scan_discussions(docs: DataFrame, col: str = "text") -> DataFrame:
    """SRC-16: confidence, model disagreement, direction and the sigma multiplier of each text.
    Phrase tests are substring tests on the whole text, compiled into the scan stage."""
    out = docs.withColumn("_t", F.lower(col))
    t = F.col("_t")
    out = out.withColumn(
        "confidence", F.when(_any(t, HIGH_CONFIDENCE), "HIGH").when(_any(t, LOW_CONFIDENCE), "LOW").otherwise("NEUTRAL")
    ).withColumn("disagreement", _any(t, DISAGREEMENT).cast("int"))
    out = out.withColumn("direction", F.when(_any(t, WARM), "WARM_BIAS").when(_any(t, COOL), "COOL_BIAS"))
    mult = 1.0 + F.when(F.col("confidence") == "LOW", 0.15).otherwise(0.0) + 0.10 * F.col("disagreement")
    return out.withColumn("sigma_mult", F.round(mult, 2)).drop("_t")


def score_discussions(docs: DataFrame, col: str = "text") -> DataFrame:
    """SRC-16, graded form: score in [-1, 1], a sigma factor from it, and an extreme-event flag."""
    out = docs.withColumn("_t", F.lower(col))
    out = out.withColumn("_h", _hits(F.col("_t"), SCORE_HIGH)).withColumn("_l", _hits(F.col("_t"), SCORE_LOW))
    score = (F.col("_h") - F.col("_l")) / F.greatest(F.col("_h") + F.col("_l"), F.lit(1))
    out = out.withColumn("score", score).withColumn("extreme", _any(F.col("_t"), EXTREME))
    mod = F.when(F.col("score") > 0.3, 0.90).when(F.col("score") < -0.3, 1.15).otherwise(1.0)
    return out.withColumn("sigma_mod", mod).drop("_t", "_h", "_l")


def signals_by_station(signals: DataFrame, stations: DataFrame) -> DataFrame:
    """SRC-16: an office's text applies to each of its stations."""
    return join_keys(signals, stations.filter("is_active").select("station_id", "office"), ["office"])
