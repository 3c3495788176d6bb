"""Streams over the warehouse files, run to the end of what is available, against their batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brierworks.operators import bias as K
from brierworks.plans import bindings as B
from brierworks.plans.bindings import with_tables as T
from brierworks.plans.registry import R, query, rounded
from brierworks.plans.source_queries import payload_docs, scratch
from brierworks.plans.verify_queries import errors
from brierworks.sources import snapshots
from brierworks.session import cut_lineage
from brierworks.streaming import feeds as S


def schema_of(df) -> StructType:
    return StructType.fromJson(df.schema.jsonValue())


def event_stream(spark, sf):
    """The events table as a stream, event time as an instant."""
    return S.table_stream(spark, sf, B.events(spark, sf).schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def finish(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("st01_extremes_stream", T("rd") + f"""SELECT station_id, CAST(ts AS DATE) AS local_date, {R('max(temp_f)', 't_max_f')}, {R('min(temp_f)', 't_min_f')}, count(*) AS obs_count, max(ts) AS last_obs_at
 FROM (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY station_id, ts ORDER BY temp_f) = 1) GROUP BY 1, 2""")
def _(spark, sf):
    path = scratch(spark, "st01")
    rd = event_stream(spark, sf).filter("event_type = 'view'").select(B.station().alias("station_id"), "ts", F.col("value").alias("temp_f"))
    out = S.extremes_stream(rd)
    finish(S.keep_table(out, f"{path}/table", f"{path}/state", ["station_id", "local_date"], "local_date", ["revision"]))
    table = snapshots.read(spark, f"{path}/table", schema_of(out)).drop("revision")
    return rounded(table.withColumn("last_obs_at", F.col("last_obs_at").cast("timestamp_ntz")))


@query("st01_corrected_readings", T("rd") + f"""SELECT station_id, CAST(ts AS DATE) AS local_date, {R('max(temp_f)', 't_max_f')}, {R('min(temp_f)', 't_min_f')}, count(temp_f) AS obs_count, max(ts) AS last_obs_at
 FROM (SELECT * REPLACE (CASE WHEN reading_id % 11 <> 0 THEN temp_f END AS temp_f) FROM rd QUALIFY row_number() OVER (PARTITION BY station_id, ts ORDER BY reading_id DESC) = 1) GROUP BY 1, 2""")
def _(spark, sf):
    """Three polls: wrong values that hold the extremes, the corrections (some take a value back), and repeats."""
    path = scratch(spark, "st01-corrected")
    rd = B.readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("reading_id", "poll")
    right = rd.withColumn("temp_f", F.when(F.col("poll") % 11 != 0, F.col("temp_f")))
    wrong = rd.withColumn("temp_f", F.col("temp_f") + F.when(F.col("poll") % 2 == 0, 500).otherwise(-500)).where("poll % 3 = 0")
    schema, out = rd.schema, None
    for k, polled in enumerate((wrong.unionByName(right.where("poll % 3 = 1")), right, right.where("poll % 2 = 0"))):
        polled.write.parquet(f"{path}/landing/p{k}")  # one poll lands, the stream picks it up
        out = S.extremes_stream(S.table_stream(spark, f"{path}/landing/*", schema), lateness="1000 days", poll="poll")
        finish(S.keep_table(out, f"{path}/table", f"{path}/state", ["station_id", "local_date"], "local_date", ["revision"]))
    table = snapshots.read(spark, f"{path}/table", schema_of(out)).drop("revision")
    return rounded(table.withColumn("last_obs_at", F.col("last_obs_at").cast("timestamp_ntz")))


@query("st02_latest_book_stream", T("snap") + f"SELECT ticker, snapshot_id, snapshot_at, {R('price', 'price')} FROM snap QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY snapshot_at DESC, snapshot_id DESC) = 1")
def _(spark, sf):
    path = scratch(spark, "st02")
    li = S.table_stream(spark, sf, B.table(spark, sf, "lineitem").schema, "lineitem.parquet")
    snaps = li.selectExpr("l_partkey AS ticker", "l_orderkey * 10 + l_linenumber AS snapshot_id", "l_shipdate AS snapshot_at", "round(l_discount * 100) / 100 AS price")
    finish(S.latest_book_stream(snaps, f"{path}/table", f"{path}/state", 8))
    table = snapshots.read(spark, f"{path}/table", "ticker bigint, snapshot_id bigint, snapshot_at timestamp_ntz, price double, bucket int")
    return rounded(table.drop("bucket"))


@query("st03_forecast_stream", f"""WITH k AS (SELECT *, event_id % 8 AS kind FROM events)
 SELECT event_id, CAST(ts AS DATE) AS target_date, {R('value', 'high_f')}, {R('value / 2', 'low_f')} FROM k WHERE kind IN (3, 4, 5, 7)""")
def _(spark, sf):
    path = scratch(spark, "st03")
    # documents land as files first; the stream picks them up
    payload_docs(spark, sf).write.parquet(f"{path}/landing")
    docs = S.table_stream(spark, f"{path}/landing", payload_docs(spark, sf).schema)
    finish(S.forecast_stream(docs, f"{path}/table", f"{path}/state"))
    table = snapshots.read(spark, f"{path}/table", "event_id bigint, target_date date, high_f double, low_f double, issued_at string")
    return rounded(table.drop("issued_at"))


@query("st04_stale_stream", T("rd", extra="""
m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM rd), l AS (SELECT station_id, max(ts) AS last_at FROM rd GROUP BY 1)""") + """
SELECT station_id, date_trunc('millisecond', last_at) AS last_at, date_trunc('millisecond', last_at) + INTERVAL 120 MINUTE AS alert_at FROM l, m WHERE date_trunc('millisecond', last_at) + INTERVAL 120 MINUTE <= date_trunc('millisecond', wm)""")
def _(spark, sf):
    path = scratch(spark, "st04")
    rd = event_stream(spark, sf).filter("event_type = 'view'").select(B.station().alias("station_id"), "ts")
    finish(S.append_table(S.stale_stream(rd), f"{path}/table", f"{path}/state"))
    t = spark.read.schema(S.STALE_OUT).parquet(f"{path}/table")
    return t.select("station_id", F.col("last_at").cast("timestamp_ntz").alias("last_at"), F.col("alert_at").cast("timestamp_ntz").alias("alert_at"))


def bias_oracle() -> str:
    from brierworks.plans.ensemble_queries import KAL_SQL

    return KAL_SQL + f"SELECT station_id, target_type, target_date, CAST(k AS INT) AS state_version, {R('b', 'b_k')}, {R('u', 'u_k')}, {R('q', 'q_k')}, {R('g', 'k_k')}, {R('eps', 'epsilon')}, false AS late FROM kf WHERE k > 0"


@query("st05_bias_stream", bias_oracle())
def _(spark, sf):
    path = scratch(spark, "st05")
    series = K.daily_errors(errors(spark, sf), ["station_id", "target_type"])
    series.write.parquet(f"{path}/landing")
    finish(S.append_table(S.bias_stream(S.table_stream(spark, f"{path}/landing", series.schema)), f"{path}/table", f"{path}/state"))
    return rounded(spark.read.schema(S.BIAS_OUT).parquet(f"{path}/table").drop("r_k", "arrived"))


@query("st05_late_days", bias_oracle().replace(", false AS late", ""))
def _(spark, sf):
    """Days arrive out of order; the late ones are replayed, and a new query goes on from the replayed states."""
    path, by = scratch(spark, "st05-late"), ["station_id", "target_type"]
    day = F.unix_date("target_date")
    series = cut_lineage(K.daily_errors(errors(spark, sf), by).withColumn("part", F.when(day % 5 == 0, 1).when(day % 4 == 3, 2).otherwise(0)))
    newest = series.agg(F.max(day)).first()[0] or 0
    for k, rows in enumerate((series.where((F.col("part") == 0) & (day < newest - 6)), series.where((F.col("part") == 1) & (day < newest - 6)), series.where((F.col("part") == 2) & (day < newest - 6)))):
        rows.drop("part").write.parquet(f"{path}/first/p{k}")
        stream = S.table_stream(spark, f"{path}/first/*", series.drop("part").schema)
        finish(S.append_table(S.bias_stream(stream), f"{path}/table", f"{path}/state"))
    rows = spark.read.schema(S.BIAS_OUT).parquet(f"{path}/table")
    history, states = S.replay_bias(rows, S.bias_states(spark, f"{path}/state"))
    history, states = cut_lineage(history), cut_lineage(states)
    series.where(day >= newest - 6).drop("part").write.parquet(f"{path}/second")
    stream = S.table_stream(spark, f"{path}/second", series.drop("part").schema)
    finish(S.append_table(S.bias_stream(stream, states=states), f"{path}/later", f"{path}/state-later"))
    later = spark.read.schema(S.BIAS_OUT).parquet(f"{path}/later")
    return rounded(history.unionByName(later).where("NOT late").drop("r_k", "arrived", "late"))


@query("st06_error_window_stream", f"""WITH e AS (SELECT user_id % 20 AS station_id, event_type AS source_id, ts, value - 60 AS e FROM events),
 w AS (SELECT *, date_trunc('day', ts) - to_days(unnest(range(7))::INT) AS window_start FROM e)
 SELECT station_id, source_id, window_start, count(*) AS n, {R('avg(e)', 'bias')}, {R('avg(abs(e))', 'mae')}, {R('sqrt(avg(e * e))', 'rmse')} FROM w GROUP BY 1, 2, 3""")
def _(spark, sf):
    path = scratch(spark, "st06")
    e = event_stream(spark, sf).select(B.station().alias("station_id"), F.col("event_type").alias("source_id"), "ts", (F.col("value") - 60).alias("error_raw"))
    out = S.error_window_stream(e).withColumn("window_day", F.to_date("window_start"))
    finish(S.keep_table(out, f"{path}/table", f"{path}/state", ["station_id", "source_id", "window_start"], "window_day", ["n"]))
    return rounded(snapshots.read(spark, f"{path}/table", schema_of(out)).drop("window_day"))
