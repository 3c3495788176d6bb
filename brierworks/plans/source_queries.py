"""Decoder and sink queries: documents and reports are written from warehouse rows, then read back."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brierworks.operators.ordering import join_keys
from brierworks.plans import bindings as B
from brierworks.plans.bindings import with_tables as T
from brierworks.plans.registry import R, query, r6, rounded
from brierworks.schemas import contract
from brierworks.session import shared_folder
from brierworks.sources import axis as AX, listings as L, payloads as PL, reports as RP, snapshots, store as ST, tables as TB


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("src01_read_table", "SELECT event_id, value FROM events WHERE event_type = 'view' AND value > 50")
def _(spark, sf):
    return TB.read_table(spark, sf, "events.parquet", (F.col("event_type") == "view") & (F.col("value") > 50), ["event_id", "value"], "event_id bigint, event_type string, value double")


@query("src01_store", f"""WITH f AS (SELECT user_id % 20 AS station_id, CAST(ts AS DATE) AS target_date, count(*) AS n, avg(value) AS mean_f FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
 o AS (SELECT user_id % 20 AS station_id, CAST(ts AS DATE) AS target_date, max(value) AS top FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT station_id, target_date, n, {R('mean_f - top', 'mean_error')} FROM f JOIN o USING (station_id, target_date)
 WHERE target_date IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'view' AND value > 200)""")
def _(spark, sf):
    """Forecasts and observations are stored by month and bucket; those of the days with a high reading are compared. The
    stored tables are grouped and joined without a shuffle, and only the months of those days are read."""
    tables = {}
    for name, rows in (("forecasts", B.forecasts(spark, sf)), ("observations", B.observations(spark, sf))):
        tables[name] = f"{name}_{uuid.uuid4().hex}"
        ST.write_store(rows, tables[name], scratch(spark, f"store-{name}"))
    days = B.readings(spark, sf).filter("temp_f > 200").select(F.to_date("ts").alias("target_date"))
    fc, obs = (ST.on_days(ST.read_store(spark, t), days) for t in tables.values())
    keys = ["station_id", "target_date"]
    mean = fc.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("high_f").alias("mean_f"))
    return rounded(mean.join(obs, keys).select(*keys, "n", (F.col("mean_f") - F.col("observed_high_f")).alias("mean_error")))


@query("src02_obs_csv", f"""SELECT event_id, 'K' || lpad((user_id % 20)::VARCHAR, 3, 'A') AS station_id, date_trunc('minute', ts) AS valid, CAST(ts AS DATE) AS local_date,
 {R('CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END', 'temp_f')} FROM events""")
def _(spark, sf):
    line = F.concat_ws(
        ",", F.expr("concat('K', lpad(cast(user_id % 20 as string), 3, 'A'))"), F.date_format("ts", "yyyy-MM-dd HH:mm"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN 'M' WHEN event_id % 11 = 0 THEN 'trace' ELSE cast(value as string) END"))
    return rounded(TB.parse_obs_lines(B.events(spark, sf).select("event_id", line.alias("line"))))


@query("src02_obs_files", f"""SELECT 'K' || lpad((user_id % 20)::VARCHAR, 3, 'A') AS station_id, date_trunc('minute', ts) AS valid, CAST(ts AS DATE) AS local_date,
 {R('CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END', 'temp_f')} FROM events""")
def _(spark, sf):
    """Observation files with a header land in a folder and are scanned."""
    path = scratch(spark, "obs-csv")
    B.events(spark, sf).select(
        F.expr("concat('K', lpad(cast(user_id % 20 as string), 3, 'A'))").alias("station_id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("valid"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN 'M' WHEN event_id % 11 = 0 THEN 'trace' ELSE cast(value as string) END").alias("tmpf")).write.csv(path, header=True)
    return rounded(TB.read_obs_csv(spark, path))


# ------------------------------------------------------------------ forecast documents

def payload_docs(spark, sf):
    """One document per event; the event number decides what is wrong with it."""
    kind = F.col("event_id") % 8
    day = F.date_format("ts", "yyyy-MM-dd")
    num = lambda c: c.cast("string")
    issued = F.when(kind == 0, F.lit("")).when(kind == 1, F.lit('"issued_at":"  ",')).otherwise(F.concat(F.lit('"issued_at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z",')))
    high = F.when(kind == 3, F.concat(F.lit('"'), num(F.col("value")), F.lit('"'))).when(kind == 4, F.lit('"warm"')).otherwise(num(F.col("value")))
    date = F.when(kind == 5, F.lit("2024-1")).otherwise(day)
    row = lambda d, h: F.concat(F.lit('{"target_date":"'), d, F.lit('","high_f":'), h, F.lit(',"low_f":'), num(F.col("value") / 2), F.lit("}"))
    daily = F.when(kind == 2, F.lit('"daily":"none"')).otherwise(F.concat(F.lit('"daily":['), row(date, high), F.lit(","), row(day, num(F.col("value"))), F.lit("]")))
    n, m = F.col("event_id") % 4 + 1, F.col("event_id") % 3 + 2
    arr = lambda k, f: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), k.cast("int")), f), ","), F.lit("]"))
    hourly = F.concat(
        F.lit(',"hourly":{"time":'), arr(n, lambda i: F.concat(F.lit('"t'), i.cast("string"), F.lit('"'))),
        F.lit(',"temperature_2m":'), arr(m, lambda i: F.when(i == 2, F.lit("null")).otherwise((F.col("event_id") + i).cast("string"))),
        F.lit(',"humidity_pct":'), arr(n, lambda i: F.concat(F.lit('"'), (i * 10).cast("string"), F.lit('"'))), F.lit("}"))
    text = F.when(kind == 6, F.lit("{oops")).otherwise(F.concat(F.lit("{"), issued, daily, hourly, F.lit("}")))
    return B.events(spark, sf).select("event_id", text.alias("raw_json"))


@query("src03_ingest_payloads", f"""WITH k AS (SELECT *, event_id % 8 AS kind FROM events)
 SELECT event_id, CAST(ts AS DATE) AS target_date, {R('value', 'high_f')}, {R('value / 2', 'low_f')} FROM k WHERE kind IN (3, 7)
 UNION ALL SELECT event_id, CAST(ts AS DATE), {R('value')}, {R('value / 2')} FROM k WHERE kind IN (3, 4, 5, 7)""")
def _(spark, sf):
    good, _bad = PL.ingest_payloads(payload_docs(spark, sf))
    return rounded(PL.daily_rows(good).select("event_id", "target_date", "high_f", "low_f"))


@query("src03_quarantine", "SELECT event_id, CASE event_id % 8 WHEN 2 THEN 'daily' WHEN 6 THEN 'not_a_document' ELSE 'issued_at' END AS reason FROM events WHERE event_id % 8 IN (0, 1, 2, 6)")
def _(spark, sf):
    _good, bad = PL.ingest_payloads(payload_docs(spark, sf))
    return bad.select("event_id", "reason")


@query("src04_explode_hourly", f"""WITH k AS (SELECT *, unnest(range(1, least(event_id % 4 + 1, event_id % 3 + 2) + 1)) AS i FROM events WHERE event_id % 8 NOT IN (0, 1, 2, 6))
 SELECT event_id, 't' || i::VARCHAR AS valid_time, {R('CASE WHEN i = 2 THEN NULL ELSE event_id + i END', 'temperature_f')}, {R('i * 10', 'humidity_pct')} FROM k""")
def _(spark, sf):
    good, _bad = PL.ingest_payloads(payload_docs(spark, sf))
    return rounded(PL.explode_hourly(good).select("event_id", "valid_time", "temperature_f", "humidity_pct"))


def provider_docs(spark, sf, shape):
    """One provider document per event with two hours, the first stated twice."""
    num = lambda c: c.cast("string")
    day, v = F.date_format("ts", "yyyy-MM-dd"), F.col("value")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    if shape == "days":
        h = lambda e, t: F.concat(F.lit('{"datetimeEpoch":'), num(e), F.lit(',"temp":'), t, F.lit("}"))
        text = F.concat(F.lit('{"days":[{"datetime":"'), day, F.lit('","tempmax":'), num(v), F.lit(',"tempmin":'), num(v / 2), F.lit(',"hours":['),
                        h(epoch, num(v)), F.lit(","), h(epoch + 3600, num(v + 1)), F.lit(","), h(epoch, num(v + 2)), F.lit(","), h(epoch, F.lit("null")), F.lit("]}]}"))
    elif shape == "forecastday":
        h = lambda e, t: F.concat(F.lit('{"time_epoch":'), num(e), F.lit(',"temp_f":'), t, F.lit("}"))
        text = F.concat(F.lit('{"forecastday":[{"date":"'), day, F.lit('","day":{"maxtemp_f":'), num(v), F.lit(',"mintemp_f":'), num(v / 2), F.lit('},"hour":['),
                        h(epoch, num(v)), F.lit(","), h(epoch + 3600, num(v + 1)), F.lit(","), h(epoch, num(v + 2)), F.lit("]}]}"))
    else:
        iso = lambda e: F.date_format(F.timestamp_seconds(e), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        h = lambda e, t: F.concat(F.lit('{"startTime":"'), iso(e), F.lit('","values":{"temperature":'), t, F.lit("}}"))
        text = F.concat(F.lit('{"timelines":[{"timestep":"1d","intervals":[{"startTime":"'), day, F.lit('T00:00:00Z","values":{"temperatureMax":'), num(v), F.lit(',"temperatureMin":'), num(v / 2),
                        F.lit('}}]},{"timestep":"1h","intervals":['), h(epoch, num(v)), F.lit(","), h(epoch + 3600, num(v + 1)), F.lit(","), h(epoch, num(v + 2)), F.lit("]}]}"))
    return B.events(spark, sf).select("event_id", text.alias("raw_json"))


HOURS_SQL = f"""SELECT event_id, date_trunc('hour', ts) AS valid_time, {R('value + 2', 'temperature_f')} FROM events
 UNION ALL SELECT event_id, date_trunc('hour', ts) + INTERVAL 1 HOUR, {R('value + 1')} FROM events"""
for _shape in PL.SHAPES:
    @query(f"src05_hourly_{_shape}", HOURS_SQL)
    def _(spark, sf, shape=_shape):
        _daily, hourly = PL.flatten_provider(provider_docs(spark, sf, shape), shape, ["event_id"])
        return rounded(hourly.select("event_id", "valid_time", "temperature_f"))

    @query(f"src05_daily_{_shape}", f"SELECT event_id, CAST(ts AS DATE) AS target_date, {R('value', 'high_f')}, {R('value / 2', 'low_f')} FROM events")
    def _(spark, sf, shape=_shape):
        daily, _hourly = PL.flatten_provider(provider_docs(spark, sf, shape), shape, ["event_id"])
        return rounded(daily)


AXIS_A, AXIS_B = "2024-01-02 00:00:00", "2024-01-29 23:00:00"


@query("src06_expand_intervals", f"""WITH x AS (SELECT user_id % 20 AS station_id, event_id, value * 9.0::DOUBLE / 5.0 + 32.0 AS v, ts,
  greatest(1, CAST(round_even((event_id % 5) + (event_id % 60) / 60.0, 0) AS INT)) AS n FROM events),
 y AS (SELECT station_id, event_id, v, date_trunc('hour', ts + to_hours(unnest(range(n)))) AS valid_time FROM x)
 SELECT station_id, valid_time, {R('arg_max(v, event_id)', 'value')} FROM y WHERE valid_time BETWEEN TIMESTAMP '{AXIS_A}' AND TIMESTAMP '{AXIS_B}' GROUP BY 1, 2""")
def _(spark, sf):
    iv = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00/PT"), F.expr("cast(event_id % 5 as string)"), F.lit("H"), F.expr("cast(event_id % 60 as string)"), F.lit("M"))
    df = B.events(spark, sf).select("event_id", F.expr("user_id % 20").alias("station_id"), iv.alias("valid_time"), "value", F.lit("wmoUnit:degC").alias("uom"))
    a, b = F.lit(AXIS_A).cast("timestamp"), F.lit(AXIS_B).cast("timestamp")
    return rounded(PL.expand_intervals(df, ["station_id"], "event_id", "temperature", a, b))


@query("src06_expand_periods", f"""WITH y AS (SELECT user_id % 20 AS station_id, event_id, value AS v, date_trunc('hour', ts) + to_hours(unnest(range(event_id % 4))) AS valid_time FROM events)
 SELECT station_id, valid_time, {R('arg_max(v, event_id)', 'value')} FROM y WHERE valid_time BETWEEN TIMESTAMP '{AXIS_A}' AND TIMESTAMP '{AXIS_B}' GROUP BY 1, 2""")
def _(spark, sf):
    end = F.col("ts").cast("timestamp") + F.make_interval(hours=(F.col("event_id") % 4).cast("int"))
    df = B.events(spark, sf).select("event_id", F.expr("user_id % 20").alias("station_id"), F.col("ts").cast("timestamp").alias("start_time"), end.alias("end_time"), "value")
    a, b = F.lit(AXIS_A).cast("timestamp"), F.lit(AXIS_B).cast("timestamp")
    return rounded(PL.expand_periods(df, ["station_id"], "event_id", a, b))


# ------------------------------------------------------------------ axes and daily values

HR_SQL = "hr AS (SELECT station_id, date_trunc('hour', ts) AS h, max(temp_f) AS temp_f FROM rd GROUP BY 1, 2)"


def hourly_readings(spark, sf):
    rd = B.readings(spark, sf)
    return rd.groupBy("station_id", F.date_trunc("hour", "ts").alias("valid_time")).agg(F.max("temp_f").alias("temp_f"))


@query("src07_reindex_hourly", T("rd", extra=HR_SQL + """, ax AS (SELECT station_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS valid_time FROM (SELECT DISTINCT station_id FROM hr))""") + f"""
SELECT ax.station_id, valid_time, {R('temp_f', 'temp_f')} FROM ax LEFT JOIN hr ON hr.station_id = ax.station_id AND hr.h = valid_time""")
def _(spark, sf):
    out = AX.reindex_hourly(hourly_readings(spark, sf), ["station_id"], F.lit("2024-01-01").cast("timestamp"), 30)
    return rounded(out.withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz")))


@query("src08_local_targets", T("rd", "st", extra="""
d AS (SELECT DISTINCT rd.station_id, CAST(timezone(tz, timezone('UTC', ts)) AS DATE) AS target_date FROM rd JOIN st USING (station_id))""") + """
SELECT station_id, target_date FROM d QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY target_date) <= 4""")
def _(spark, sf):
    axis = join_keys(B.readings(spark, sf), B.stations(spark, sf).select("station_id", "tz"), ["station_id"])
    return AX.local_targets(axis, ["station_id"], "tz", 4, "ts")


@query("src09_backfill_daily", T("fc", "rd", "st", extra="""
d AS (SELECT station_id, target_date, CASE WHEN (station_id + day(target_date)) % 3 = 0 THEN NULL ELSE max(high_f) END AS high_f, CASE WHEN (station_id + day(target_date)) % 4 = 0 THEN NULL ELSE min(low_f) END AS low_f FROM fc GROUP BY 1, 2),
h AS (SELECT rd.station_id, CAST(timezone(tz, timezone('UTC', ts)) AS DATE) AS target_date, max(temp_f) AS hi, min(temp_f) AS lo FROM rd JOIN st USING (station_id) GROUP BY 1, 2)""") + f"""
SELECT station_id, target_date, {R('coalesce(high_f, hi)', 'high_f')}, {R('coalesce(low_f, lo)', 'low_f')} FROM d LEFT JOIN h USING (station_id, target_date)""")
def _(spark, sf):
    k = F.col("station_id") + F.dayofmonth("target_date")
    d = B.forecasts(spark, sf).groupBy("station_id", "target_date").agg(F.max("high_f").alias("high_f"), F.min("low_f").alias("low_f"))
    d = d.withColumn("high_f", F.when(k % 3 != 0, F.col("high_f"))).withColumn("low_f", F.when(k % 4 != 0, F.col("low_f")))
    return rounded(AX.backfill_daily(d, B.readings(spark, sf), B.stations(spark, sf)))


@query("src10_periods_to_daily", T("rd") + f"""SELECT station_id, CAST(ts AS DATE) AS target_date, {R('max(CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN temp_f END)', 'high_f')}, {R('min(CASE WHEN NOT hour(ts) BETWEEN 6 AND 17 THEN temp_f END)', 'low_f')} FROM rd GROUP BY 1, 2""")
def _(spark, sf):
    rd = B.readings(spark, sf).withColumn("target_date", F.to_date("ts")).withColumn("is_day", F.hour("ts").between(6, 17))
    return rounded(AX.periods_to_daily(rd, ["station_id", "target_date"]))


# ------------------------------------------------------------------ text reports

@query("src11_decode_metar", f"""WITH x AS (SELECT event_id, ts, CAST(floor(value) AS BIGINT) % 60 - 20 AS t, CAST(floor(value) AS BIGINT) % 25 - 15 AS d FROM events WHERE event_id % 13 <> 0)
 SELECT event_id, {R('round(t * 9.0::DOUBLE / 5.0 + 32.0, 1)', 'temp_f')}, {R('round(d * 9.0::DOUBLE / 5.0 + 32.0, 1)', 'dewpoint_f')}, CAST(event_id % 40 AS INT) AS wind_kt,
  CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 36 * 10 END AS INT) AS wind_dir, date_trunc('minute', ts) AS observed_at FROM x""")
def _(spark, sf):
    two = lambda c: F.lpad(F.abs(c).cast("string"), 2, "0")
    mark = lambda c: F.concat(F.when(c < 0, F.lit("M")).otherwise(F.lit("")), two(c))
    t, d = F.expr("cast(floor(value) as bigint) % 60 - 20"), F.expr("cast(floor(value) as bigint) % 25 - 15")
    wind = F.concat(F.when(F.col("event_id") % 5 == 0, F.lit("VRB")).otherwise(F.lpad((F.col("event_id") % 36 * 10).cast("string"), 3, "0")), two(F.col("event_id") % 40), F.when(F.col("event_id") % 2 == 0, F.lit("G45")).otherwise(F.lit("")), F.lit("KT"))
    body = F.when(F.col("event_id") % 13 == 0, F.lit("//")).otherwise(F.concat(mark(t), F.lit("/"), mark(d)))
    raw = F.concat(F.lit("KXYZ "), F.date_format("ts", "ddHHmm"), F.lit("Z "), wind, F.lit(" 10SM SCT040 "), body, F.lit(" A2998"))
    # received nine days later: some reports belong to the month before
    df = B.events(spark, sf).select("event_id", raw.alias("raw"), (F.col("ts").cast("timestamp") + F.expr("interval 9 days")).alias("received_at"))
    return rounded(RP.decode_metar(df).select("event_id", "temp_f", "dewpoint_f", "wind_kt", "wind_dir", "observed_at"))


def climate_texts(spark, sf):
    """One summary per event in one of five layouts; some values carry a letter, some are absurd."""
    hi, lo = F.expr("cast(floor(value) as bigint) % 160"), F.expr("cast(floor(value) as bigint) % 50 - 10")
    letter = F.when(F.col("event_id") % 6 == 0, F.lit("R")).otherwise(F.lit(""))
    h, w = F.concat(hi.cast("string"), letter), lo.cast("string")
    k = F.col("event_id") % 5
    body = (
        F.when(k == 0, F.concat(F.lit("MAXIMUM TEMPERATURE: "), h, F.lit("\nMINIMUM TEMPERATURE: "), w))
        .when(k == 1, F.concat(F.lit("Max Temp - "), h, F.lit("\nMin Temp: "), w))
        .when(k == 2, F.concat(F.lit("HIGH: "), h, F.lit("\nLOW: "), w))
        .when(k == 3, F.concat(F.lit("MAXIMUM (F)...."), h, F.lit("\nMINIMUM (F)..."), w))
        .otherwise(F.concat(F.lit("  MAXIMUM   "), h, F.lit("  1500\n  MINIMUM   "), w, F.lit("  0600"))))
    head = F.concat(F.lit("CLIS"), F.lpad(F.expr("cast(user_id % 20 as string)"), 2, "0"), F.lit("\nCLIMATE SUMMARY FOR "), F.upper(F.date_format("ts", "MMMM d yyyy")), F.lit("\n"))
    return B.events(spark, sf).select("event_id", F.expr("user_id % 20").alias("station_id"), "ts", F.concat(head, body, F.lit("\n")).alias("text"))


CLIMATE_SQL = """cr AS (SELECT event_id, user_id % 20 AS station_id, ts, CAST(ts AS DATE) AS report_date, (CAST(floor(value) AS BIGINT) % 160)::DOUBLE AS high_f, CASE WHEN event_id % 5 = 4 THEN abs(CAST(floor(value) AS BIGINT) % 50 - 10) ELSE CAST(floor(value) AS BIGINT) % 50 - 10 END::DOUBLE AS low_f, event_id % 6 = 0 AS had_letter FROM events WHERE CAST(floor(value) AS BIGINT) % 160 <= 140)"""


@query("src12_decode_climate_reports", "WITH " + CLIMATE_SQL + f" SELECT event_id, report_date, {R('high_f', 'high_f')}, {R('low_f', 'low_f')}, had_letter FROM cr")
def _(spark, sf):
    return rounded(RP.decode_climate_reports(climate_texts(spark, sf)).select("event_id", "report_date", "high_f", "low_f", "had_letter"))


@query("src13_resolve_observations", T("rd", extra=CLIMATE_SQL + """,
own AS (SELECT station_id, CAST(ts AS DATE) AS target_date, max(temp_f) AS ohi, min(temp_f) AS olo FROM rd GROUP BY 1, 2),
fine AS (SELECT cr.*, report_date AS target_date FROM cr LEFT JOIN own ON own.station_id = cr.station_id AND own.target_date = cr.report_date
  WHERE NOT (had_letter AND coalesce(abs(high_f - ohi) > 20 OR abs(low_f - olo) > 20, false))),
best AS (SELECT * FROM fine QUALIFY row_number() OVER (PARTITION BY station_id, target_date ORDER BY ts DESC, event_id DESC) = 1),
want AS (SELECT DISTINCT user_id % 20 AS station_id, CAST(ts AS DATE) AS target_date FROM events)""") + f"""
SELECT want.station_id, want.target_date, {R('coalesce(high_f, ohi)', 'observed_high_f')}, {R('coalesce(low_f, olo)', 'observed_low_f')}, CASE WHEN event_id IS NOT NULL THEN 'report' ELSE 'station_fallback' END AS obs_source, event_id AS report_id
FROM want LEFT JOIN best USING (station_id, target_date) LEFT JOIN own USING (station_id, target_date) WHERE event_id IS NOT NULL OR ohi IS NOT NULL""")
def _(spark, sf):
    rep = RP.decode_climate_reports(climate_texts(spark, sf)).withColumnRenamed("event_id", "report_id").withColumnRenamed("ts", "issued_at")
    rep = rep.withColumn("site", F.concat(F.lit("S"), F.lpad(F.col("station_id").cast("string"), 2, "0")))
    own = B.readings(spark, sf).withColumn("target_date", F.to_date("ts"))
    wanted = B.events(spark, sf).select(F.expr("user_id % 20").alias("station_id"), F.to_date("ts").alias("target_date")).distinct()
    return rounded(RP.resolve_observations(wanted, rep, own, text="text"))


PHRASES = ("High confidence in the outcome", "A challenging setup, models disagree and model spread is wide", "Warmer than guidance", "cooler than normal", "Uncertain", "nothing of note")


def discussions(spark, sf):
    pick = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (F.col("doc_id") % 6 + 1).cast("int"))
    return B.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("office"), F.concat_ws("\n", "text", pick).alias("text"))


DISC_SQL = "ds AS (SELECT doc_id, doc_id % 7 AS office, lower(text || chr(10) || [" + ", ".join(f"'{x}'" for x in PHRASES) + "][(doc_id % 6 + 1)::INT]) AS t FROM documents)"


def any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


SCAN_SQL = DISC_SQL + f""", sc AS (SELECT doc_id, office, CASE WHEN {any_sql(RP.HIGH_CONFIDENCE)} THEN 'HIGH' WHEN {any_sql(RP.LOW_CONFIDENCE)} THEN 'LOW' ELSE 'NEUTRAL' END AS confidence,
  CAST({any_sql(RP.DISAGREEMENT)} AS INT) AS disagreement, CASE WHEN {any_sql(RP.WARM)} THEN 'WARM_BIAS' WHEN {any_sql(RP.COOL)} THEN 'COOL_BIAS' END AS direction FROM ds)"""


@query("src16_scan_discussions", T("st", extra=SCAN_SQL) + f"""SELECT doc_id, station_id, confidence, disagreement, direction, {R("1.0 + CASE WHEN confidence = 'LOW' THEN 0.15 ELSE 0 END + 0.1 * disagreement", 'sigma_mult')} FROM sc JOIN st USING (office) WHERE is_active""")
def _(spark, sf):
    s = RP.signals_by_station(RP.scan_discussions(discussions(spark, sf)), B.stations(spark, sf))
    return rounded(s.select("doc_id", "station_id", "confidence", "disagreement", "direction", "sigma_mult"))


def hits_sql(words) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words) + ")"


@query("src16_score_discussions", "WITH " + DISC_SQL + f""", h AS (SELECT doc_id, {hits_sql(RP.SCORE_HIGH)} AS h, {hits_sql(RP.SCORE_LOW)} AS l, {any_sql(RP.EXTREME)} AS extreme FROM ds),
 s AS (SELECT *, (h - l) / greatest(h + l, 1) AS score FROM h) SELECT doc_id, {R('score', 'score')}, extreme, {R('CASE WHEN score > 0.3 THEN 0.9 WHEN score < -0.3 THEN 1.15 ELSE 1.0 END', 'sigma_mod')} FROM s""")
def _(spark, sf):
    return rounded(RP.score_discussions(discussions(spark, sf)).select("doc_id", "score", "extreme", "sigma_mod"))


# ------------------------------------------------------------------ listings

def listing_docs(orders):
    """One listing per order: five interior bins and two tails, with or without strike metadata."""
    k = F.col("o_orderkey") % 4
    base = (F.col("o_orderkey") % 60 + 20).cast("double")
    head = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("KXHIGH")).otherwise(F.lit("KXLOW")), F.lit("C"), F.lpad((F.col("o_custkey") % 25).cast("string"), 2, "0"))
    day = F.upper(F.date_format("o_orderdate", "yyMMMdd"))
    event = F.concat(head, F.lit("-"), day, F.lit("-N"), F.col("o_orderkey").cast("string"))
    # kind 2: half-integer labels of width 2; others integer labels
    shift = F.when(k == 2, 0.5).otherwise(0.0)
    text = lambda v: F.when(k == 2, v.cast("string")).otherwise(v.cast("bigint").cast("string"))
    tick = lambda kind, v: F.concat(head, F.lit("-"), day, F.lit("-"), F.lit(kind), text(v))
    strike = lambda st, lo, hi: F.when(
        k == 0, F.concat(F.lit(f',"strike_type":"{st}"'), *([F.lit(',"floor_strike":'), lo.cast("string")] if lo is not None else []), *([F.lit(',"cap_strike":'), hi.cast("string")] if hi is not None else []))
    ).otherwise(F.lit(""))
    mk = lambda t, st: F.concat(F.lit('{"ticker":"'), t, F.lit('","status":"open","yes_ask":42,"last_price":null'), st, F.lit("}"))
    inner = [mk(tick("B", base + 2 * i + shift), strike("between", base + 2 * i, base + 2 * i + 1)) for i in range(5)]
    low, high = mk(tick("T", base - 2), strike("less", None, base - 1)), mk(tick("T", base + 12), strike("greater", base + 10, None))
    title = F.concat(F.lit("What will the temperature be in Old Town on "), (F.col("o_custkey") % 25).cast("string"), F.lit(" tomorrow?"))
    doc = F.concat(F.lit('{"event_ticker":"'), event, F.lit('","series_ticker":"'), F.when(k == 1, head).otherwise(F.lit("NONE")), F.lit('","title":"'), title, F.lit('","markets":['),
                   F.array_join(F.array(low, *inner, high), ","), F.lit("]}"))
    return orders.select("o_orderkey", doc.alias("raw_json"))


def landed_listings(spark, sf):
    """The listings as landed files, several per table, which is how a feed delivers them.

    Orders are dealt out before their texts are written: they are short, and few tasks read them. The count keeps
    adaptive execution from joining tasks by the size of orders, which says nothing of the texts.
    """
    path = scratch(spark, "listings")
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    listing_docs(orders.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")).write.parquet(path)
    return spark.read.schema("o_orderkey bigint, raw_json string").parquet(path)


@query("src14_decode_markets", f"""WITH e AS (SELECT o_orderkey, o_orderkey % 4 AS k, (o_orderkey % 60 + 20)::DOUBLE AS b, CAST(o_orderdate AS DATE) AS target_date FROM orders WHERE o_orderkey % 10 <> 3),
 m AS (SELECT *, unnest(range(-1, 6)) AS i FROM e)
 SELECT o_orderkey, target_date, i IN (-1, 5) AS is_tail,
  {R('''CASE WHEN i = -1 THEN NULL WHEN k = 0 THEN CASE WHEN i = 5 THEN b + 9.5 ELSE b + 2 * i - 0.5 END WHEN i = 5 THEN CASE WHEN k = 2 THEN b + 10.5 ELSE b + 11.5 END WHEN k = 2 THEN b + 2 * i + 0.5 ELSE b + 2 * i - 0.5 END''', 'bin_lower')},
  {R('''CASE WHEN i = 5 THEN NULL WHEN k = 0 THEN CASE WHEN i = -1 THEN b - 0.5 ELSE b + 2 * i + 1.5 END WHEN i = -1 THEN CASE WHEN k = 2 THEN b + 0.5 ELSE b - 1.5 END WHEN k = 2 THEN b + 2 * i + 2.5 ELSE b + 2 * i + 1.5 END''', 'bin_upper')},
  {R('0.42', 'yes_ask')} FROM m""")
def _(spark, sf):
    ev = L.parse_events(landed_listings(spark, sf))
    ignored = ev.filter("o_orderkey % 10 = 3").select("event_ticker")
    return rounded(L.decode_markets(ev, ignored).select("o_orderkey", "target_date", "is_tail", "bin_lower", "bin_upper", "yes_ask"))


@query("src14_ticker_edges", f"""SELECT o_orderkey, {R('CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 90 - 0.5 WHEN 1 THEN o_orderkey % 90 - 0.5 END', 'bin_lower')}, {R('CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 90 + 1.5 WHEN 2 THEN o_orderkey % 90 + 0.5 END', 'bin_upper')} FROM orders""")
def _(spark, sf):
    t = F.expr("concat('KXHIGH-S-20240101-', CASE o_orderkey % 3 WHEN 0 THEN 'B' ELSE 'T' END, cast(o_orderkey % 90 as string), CASE o_orderkey % 3 WHEN 1 THEN 'ABOVE' WHEN 2 THEN 'below' ELSE '' END)")
    lo, hi = L.ticker_edges(t)
    return B.table(spark, sf, "orders").select("o_orderkey", r6(lo, "bin_lower"), r6(hi, "bin_upper"))


@query("src15_match_station", """WITH s AS (SELECT DISTINCT user_id % 20 AS station_id FROM events), e AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_custkey % 25 AS c FROM orders)
 SELECT o_orderkey, s.station_id, CASE WHEN s.station_id IS NULL THEN NULL WHEN k = 1 AND c < 5 THEN 'series' WHEN c < 15 THEN 'city_code' ELSE 'title' END AS matched_by
 FROM e LEFT JOIN s ON s.station_id = c""")
def _(spark, sf):
    ev = L.parse_events(landed_listings(spark, sf)).drop("markets")
    two = F.lpad(F.col("station_id").cast("string"), 2, "0")
    st = B.stations(spark, sf).select(
        "station_id", F.concat(F.lit("Old Town on "), F.col("station_id").cast("string")).alias("city"),
        F.when(F.col("station_id") < 15, F.concat(F.lit("C"), two)).alias("city_code"),
        F.when(F.col("station_id") < 5, F.concat(F.lit("KXHIGHC"), two)).alias("series_high"), F.when(F.col("station_id") < 5, F.concat(F.lit("KXLOWC"), two)).alias("series_low"))
    return L.match_station(ev, st).select("o_orderkey", "station_id", "matched_by")


@query("src17_load_dims", T("st") + """SELECT station_id, tz, office, city_code, (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events WHERE event_type <> 'view') AS sources,
 (SELECT min(user_id) % 3 + 4.5::DOUBLE FROM events) AS spread_max FROM st WHERE is_active""")
def _(spark, sf):
    src = B.events(spark, sf).select(F.col("event_type").alias("source_id"), (F.col("event_type") != "view").alias("is_enabled")).distinct()
    stored = B.events(spark, sf).groupBy(F.lit("spread_max").alias("param_key")).agg((F.min("user_id") % 3 + 4.5).cast("string").alias("param_value"))
    p = TB.load_params(stored)
    st, on = TB.load_dims(B.stations(spark, sf), src)
    names = on.agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("s"))
    return st.select("station_id", "tz", "office", "city_code", names.scalar().alias("sources"), F.lit(p.spread_max).alias("spread_max"))


# ------------------------------------------------------------------ sinks

MERGE_SQL = """tg AS (SELECT user_id % 20 AS station_id, CAST(ts AS DATE) AS target_date, max(value) AS v, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
 sr AS (SELECT user_id % 20 AS station_id, CAST(ts AS DATE) AS target_date, CASE WHEN count(*) % 2 = 0 THEN min(value) END AS v, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2)"""


def merge_sides(spark, sf):
    e, key = B.events(spark, sf), [F.expr("user_id % 20").alias("station_id"), F.to_date("ts").alias("target_date")]
    tg = e.filter("event_type IN ('view', 'click')").groupBy(*key).agg(F.max("value").alias("v"), F.count(F.lit(1)).alias("n"))
    sr = e.filter("event_type = 'error'").groupBy(*key).agg(F.when(F.count(F.lit(1)) % 2 == 0, F.min("value")).alias("v"), F.count(F.lit(1)).alias("n"))
    return tg, sr


@query("snk01_upsert", "WITH " + MERGE_SQL + f" SELECT station_id, target_date, {R('CASE WHEN sr.n IS NOT NULL THEN sr.v ELSE tg.v END', 'v')}, coalesce(sr.n, tg.n) AS n FROM tg FULL OUTER JOIN sr USING (station_id, target_date)")
def _(spark, sf):
    return rounded(TB.upsert(*merge_sides(spark, sf), ["station_id", "target_date"]))


@query("snk01_upsert_partitions", "WITH " + MERGE_SQL + f" SELECT station_id, target_date, {R('CASE WHEN tg.n IS NULL OR sr.n >= tg.n THEN sr.v ELSE tg.v END', 'v')}, greatest(coalesce(sr.n, 0), coalesce(tg.n, 0)) AS n FROM tg FULL OUTER JOIN sr USING (station_id, target_date)")
def _(spark, sf):
    tg, sr = merge_sides(spark, sf)
    path = scratch(spark, "upsert")
    # the second batch holds newer rows, older ones (fewer readings) and, the third time, only repeats
    for side in (tg, sr, sr):
        TB.write_upsert(spark, path, side, ["station_id", "target_date"], "target_date", ["n"])
    return rounded(spark.read.schema(tg.schema).parquet(path))


@query("snk01_snapshot_commit", "WITH " + MERGE_SQL + f" SELECT station_id, target_date, {R('CASE WHEN tg.n IS NULL OR sr.n >= tg.n THEN sr.v ELSE tg.v END', 'v')}, greatest(coalesce(sr.n, 0), coalesce(tg.n, 0)) AS n, 2::BIGINT AS version FROM tg FULL OUTER JOIN sr USING (station_id, target_date)")
def _(spark, sf):
    """Versions of a keyed table: a write whose tasks fail half-way and a repeated batch publish nothing."""
    tg, sr = merge_sides(spark, sf)
    path, keys = scratch(spark, "snapshot"), ["station_id", "target_date"]
    snapshots.merge(spark, path, tg, keys, "target_date", ["n"])
    broken = tg.withColumn("n", F.when(F.col("station_id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("n") + 1000))
    try:
        snapshots.replace_partitions(spark, path, broken, "target_date", 1)
    except (PySparkException, Py4JJavaError) as failed:
        if "lost" not in str(failed):
            raise
    for _again in range(2):
        version = snapshots.merge(spark, path, sr, keys, "target_date", ["n"])
    return rounded(snapshots.read(spark, path, tg.schema).withColumn("version", F.lit(version).cast("long")))


@query("snk02_upsert_coalesce", "WITH " + MERGE_SQL + f" SELECT station_id, target_date, {R('coalesce(sr.v, tg.v)', 'v')}, coalesce(sr.n, tg.n) AS n FROM tg FULL OUTER JOIN sr USING (station_id, target_date)")
def _(spark, sf):
    return rounded(TB.upsert(*merge_sides(spark, sf), ["station_id", "target_date"], "coalesce"))


@query("snk03_register_runs", "SELECT DISTINCT sha256(event_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS run_id, event_type, CAST(ts AS DATE) AS run_date FROM events")
def _(spark, sf):
    runs = B.events(spark, sf).select("event_type", F.to_date("ts").alias("run_date"))
    empty = spark.createDataFrame([], "event_type string, run_date date, run_id string")
    first = TB.register_runs(empty, runs.filter("run_date < '2024-01-20'"), ["event_type", "run_date"])
    return TB.register_runs(first, runs, ["event_type", "run_date"]).select("run_id", "event_type", "run_date")


@query("snk04_accumulate_extremes", T("rd") + f"""SELECT station_id, CAST(ts AS DATE) AS local_date, {R('max(temp_f)', 't_max_f')}, {R('min(temp_f)', 't_min_f')}, count(*) AS obs_count, max(ts) AS last_obs_at
 FROM (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY station_id, ts ORDER BY temp_f DESC) = 1) GROUP BY 1, 2""")
def _(spark, sf):
    rd = B.readings(spark, sf).withColumn("local_date", F.to_date("ts"))
    keys = ["station_id", "local_date"]
    wrong = rd.filter("hour(ts) < 3").withColumn("temp_f", F.col("temp_f") + 500)
    held = TB.merge_readings(rd.filter("hour(ts) >= 3 AND hour(ts) < 12").unionByName(wrong), rd.filter("hour(ts) < 12"), keys, "ts")
    held = TB.merge_readings(held, rd.filter("hour(ts) >= 9"), keys, "ts")
    return rounded(TB.accumulate_extremes(held, keys, "ts", "temp_f"))


@query("snk05_append_history", f"SELECT event_id, {R('value', 'value')}, CAST(ts AS DATE) AS run_date, 'r' || (event_id % 2)::VARCHAR AS run_stamp FROM events")
def _(spark, sf):
    path = scratch(spark, "history")
    e = B.events(spark, sf).select("event_id", "value", F.to_date("ts").alias("run_date"))
    # clustered by date first, crowded dates split, so each task writes few files
    for i in (0, 1):
        TB.append_history(e.filter(F.col("event_id") % 2 == i).hint("rebalance", F.col("run_date")), path, f"r{i}")
    return rounded(spark.read.schema("event_id bigint, value double, run_stamp string, run_date date").parquet(path))


@query("snk06_purge", "SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-24')")
def _(spark, sf):
    a = B.events(spark, sf).selectExpr("event_id", "event_id % 3 = 0 AS is_resolved", "ts AS resolved_ts")
    return TB.purge(a, F.lit("2024-01-31").cast("timestamp_ntz"), 7).select("event_id")


@query("snk07_finalize", "SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' AND event_id % 2 = 0 THEN TIMESTAMP '2024-01-06' WHEN event_id % 2 = 1 THEN ts END AS updated_at FROM events")
def _(spark, sf):
    e = B.events(spark, sf).select("event_id", F.to_date("ts").alias("target_date"), F.when(F.col("event_id") % 2 == 1, F.col("ts")).alias("updated_at"))
    return TB.finalize(e, F.lit("2024-01-05").cast("date"), F.lit("2024-01-06").cast("timestamp_ntz")).select("event_id", "updated_at")


@query("snk08_export", f"SELECT event_id, event_type, {R('value', 'value')} FROM events")
def _(spark, sf):
    a, b = scratch(spark, "csv"), scratch(spark, "json")
    e = B.events(spark, sf).select("event_id", "event_type", "value")
    TB.export(e.filter("event_id % 2 = 0"), a, "csv")
    TB.export(e.filter("event_id % 2 = 1"), b, "json")
    return rounded(spark.read.schema(e.schema).csv(a, header=True).unionByName(spark.read.schema(e.schema).json(b)))


@query("snk09_conform", T("obs") + f"SELECT station_id::VARCHAR AS station_id, target_date, {R('observed_high_f', 'observed_high_f')}, {R('observed_low_f', 'observed_low_f')}, 'unknown' AS source, false AS amended FROM obs")
def _(spark, sf):
    return rounded(TB.conform(B.observations(spark, sf), contract("observations"), {"source": "unknown", "amended": False}))


@query("snk10_capture_amendments", T("obs", extra="""
nw AS (SELECT station_id, target_date, CASE WHEN station_id % 3 = 0 THEN observed_high_f + 1 ELSE observed_high_f END AS hi, CASE WHEN station_id % 4 = 0 THEN NULL ELSE observed_low_f END AS lo FROM obs WHERE station_id % 5 <> 0),
j AS (SELECT obs.*, hi, lo, nw.station_id IS NOT NULL AND target_date >= DATE '2024-01-20' AND target_date <= DATE '2024-01-31' AND (observed_high_f IS DISTINCT FROM hi OR observed_low_f IS DISTINCT FROM lo) AS amended FROM obs LEFT JOIN nw USING (station_id, target_date))""") + f"""
SELECT station_id, target_date, amended, {R('CASE WHEN amended THEN hi ELSE observed_high_f END', 'observed_high_f')}, {R('CASE WHEN amended THEN lo ELSE observed_low_f END', 'observed_low_f')}, {R('CASE WHEN amended THEN observed_high_f END', 'original_high_f')}, {R('CASE WHEN amended THEN observed_low_f END', 'original_low_f')} FROM j""")
def _(spark, sf):
    obs = B.observations(spark, sf)
    new = obs.filter("station_id % 5 <> 0").withColumn("observed_high_f", F.expr("observed_high_f + CASE WHEN station_id % 3 = 0 THEN 1 ELSE 0 END")).withColumn(
        "observed_low_f", F.expr("CASE WHEN station_id % 4 <> 0 THEN observed_low_f END"))
    return rounded(TB.capture_amendments(obs, new, F.lit("2024-01-31").cast("date"), 11))


@query("udf02_source_registry", f"SELECT event_id AS run_id, {R('value', 'high_f')} FROM events WHERE event_type = 'click'")
def _(spark, sf):
    TB.register_source("click", lambda raw: raw.filter("event_type = 'click'").selectExpr("event_id AS run_id", "value AS high_f", "props"))
    return rounded(TB.ingest_source(B.events(spark, sf), "click", ["run_id", "high_f"]))
