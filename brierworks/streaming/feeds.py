"""Incremental forms of the batch operators on Structured Streaming.

Streaming inputs carry event time in a TIMESTAMP column. Tables kept up to date by a stream are published
in whole versions (see ``sources.snapshots``), one merge per micro-batch; the merge keys make a replayed
batch harmless.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from brierworks.operators import bias
from brierworks.params import DEFAULTS, Params
from brierworks.session import SETTINGS
from brierworks.sources.payloads import daily_rows, ingest_payloads
from brierworks.sources import snapshots
from brierworks.streaming import handlers
from brierworks.streaming.handlers import BIAS_OUT, BIAS_STATE, EXTREMES_OUT, STALE_OUT, OnlineBias, RunningExtremes, StaleStation

# the handlers travel inside the query, so Python workers need not have this package installed
cloudpickle.register_pickle_by_value(handlers)


def table_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as an unbounded table."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def extremes_stream(readings: DataFrame, lateness: str = "3 hours", at: str = "ts", poll: str | None = None) -> DataFrame:
    """ST-01: running daily extremes per station; a corrected reading replaces the one it corrects.

    A reading is known by its station and instant, so polls may repeat it. The one of the newest batch counts (of one
    batch, that of the highest ``poll``, if there is such a column, and of these the lowest temperature); a former
    maximum that is corrected is taken back. Readings up to ``lateness`` behind are accepted, and the readings of a day
    are forgotten that long after its end. ``revision`` counts a day's changes: order a keyed table by it.
    """
    _keyed_state(readings.sparkSession)
    ms = readings.sparkSession.sql(f"SELECT CAST(INTERVAL {lateness} AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000
    newest = F.col(poll).cast("double") if poll else F.lit(0.0)
    timed = readings.withWatermark(at, lateness).select("station_id", F.to_date(at).alias("local_date"), at, F.unix_micros(at).alias("at_us"), F.col("temp_f").cast("double").alias("temp_f"), newest.alias("poll"))
    return timed.groupBy("station_id", "local_date").transformWithStateInPandas(
        statefulProcessor=RunningExtremes(int(ms)), outputStructType=_typed(EXTREMES_OUT, timed), outputMode="update", timeMode="eventTime"
    )


def error_window_stream(errors: DataFrame, lateness: str = "2 days", at: str = "ts") -> DataFrame:
    """ST-06: error statistics over the last seven days, sliding by one."""
    e = F.col("error_raw")
    return (
        errors.withWatermark(at, lateness)
        .groupBy("station_id", "source_id", F.window(at, "7 days", "1 day"))
        .agg(F.count("error_raw").alias("n"), F.avg("error_raw").alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
        .select("station_id", "source_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", "bias", "mae", "rmse")
    )


def _start(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start with as many state partitions as the cluster has slots. Stream shuffles are not
    coalesced at run time, and the count is fixed with a query's first batch."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)


def _upsert_batches(spark: SparkSession, path: str, keys: list[str], partition: str, order: list[str]):
    def write(batch: DataFrame, _id: int) -> None:
        snapshots.merge(spark, path, batch, keys, partition, order)

    return write


def keep_table(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], partition: str, order: list[str], mode: str = "update"
) -> StreamingQuery:
    """Run a stream over what is available and publish a version of the keyed table for every batch that changes it."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    batches = _upsert_batches(stream.sparkSession, path, keys, partition, order)
    return _start(stream.sparkSession, writer.foreachBatch(batches))


def latest_book_stream(snaps: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """ST-02: newest order-book snapshot per ticker. Tickers are spread over hash buckets, so that a batch rewrites only
    the buckets it changes; an older snapshot that arrives late does not replace a newer one."""
    keyed = snaps.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"))
    return keep_table(keyed, path, checkpoint, ["ticker"], "bucket", ["snapshot_at", "snapshot_id"], "append")


def forecast_stream(docs: DataFrame, path: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """ST-03: arriving documents are validated, flattened and merged by key and target date."""
    good, _bad = ingest_payloads(docs)
    rows = daily_rows(good).select(key, "target_date", "high_f", "low_f", "issued_at")
    return keep_table(rows, path, checkpoint, [key, "target_date"], "target_date", ["issued_at", "high_f"], "append")


# ---------------------------------------------------------------- custom state

def _keyed_state(spark: SparkSession) -> None:
    """Timers and named state need the RocksDB store, which also keeps state off the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])


def _typed(schema: str, df: DataFrame) -> str:
    """The output schema with the station ids of ``df``, numbers or text."""
    return schema.replace("station_id bigint", f"station_id {dict(df.dtypes)['station_id']}", 1)


def stale_stream(readings: DataFrame, minutes: int = DEFAULTS.reading_stale_minutes, lateness: str = "10 minutes") -> DataFrame:
    """ST-04: one row per station that had no reading for ``minutes`` of event time."""
    _keyed_state(readings.sparkSession)
    timed = readings.select("station_id", "ts").withWatermark("ts", lateness)
    return timed.groupBy("station_id").transformWithStateInPandas(
        statefulProcessor=StaleStation(minutes), outputStructType=_typed(STALE_OUT, timed), outputMode="append", timeMode="eventTime"
    )


def bias_stream(errors: DataFrame, p: Params = DEFAULTS, states: DataFrame | None = None) -> DataFrame:
    """ST-05: online bias per key. ``errors`` holds one innovation per key and day (see the batch filter) and may hold its
    measurement noise ``r_k``; a key's work per batch is the number of its new days. Days at or before a key's last one
    are passed on as late, for :func:`replay_bias`, whose ``states`` a new query starts from."""
    _keyed_state(errors.sparkSession)
    by = ["station_id", "target_type"]
    if "r_k" not in errors.columns:
        errors = errors.withColumn("r_k", F.lit(p.r_default))
    return errors.select(*by, "target_date", "epsilon", "r_k").groupBy(*by).transformWithStateInPandas(
        statefulProcessor=OnlineBias(p), outputStructType=_typed(BIAS_OUT, errors), outputMode="append", timeMode="none",
        initialState=None if states is None else states.groupBy(*by),
    )


def bias_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ST-05: the filter states of a stopped query, read from its state store."""
    _keyed_state(spark)
    held = spark.read.format("statestore").option("stateVarName", OnlineBias.STATE).load(checkpoint)
    return held.select("key.station_id", "key.target_type", *[F.col(f"value.{c.split()[0]}").alias(c.split()[0]) for c in BIAS_STATE.split(", ")])


def replay_bias(rows: DataFrame, states: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """ST-05: work the late days into the history, and the states that a new query goes on from.

    ``rows`` are all rows that the stream has put out, ``states`` those of its state store. Keys with late days are
    recomputed from the first of them (KAL-04): a late day that was not known is inserted, one that was known takes its
    new innovation. Returns the whole history (the columns of ``rows``, none late) and one state per key; keys without
    late days keep theirs.
    """
    by = ["station_id", "target_type"]
    kept, late = rows.where("NOT late"), rows.where("late")
    newest = late.groupBy(*by, "target_date").agg(F.max_by(F.struct("epsilon", "r_k"), F.struct("arrived", "epsilon")).alias("_n"))
    series = kept.select(*by, "target_date", F.struct("epsilon", "r_k").alias("_o")).join(newest, [*by, "target_date"], "full_outer")
    series = series.select(*by, "target_date", *[F.coalesce(f"_n.{c}", f"_o.{c}").alias(c) for c in ("epsilon", "r_k")])
    history = bias.kalman_replay(kept.select(*by, "target_date", *bias.HISTORY), series, late.select(*by, "target_date"), by, p=p)
    touched = late.select(*by).distinct()
    last = bias.final_state(history.join(touched, by, "left_semi").select(*by, "target_date", *bias.HISTORY), by)
    ends = last.select(*by, F.col("target_date").alias("_end"), "b_k", "u_k", "state_version")
    noise = bias.with_noise(series.join(touched, by, "left_semi"), by, p=p).join(ends, by)
    day = F.unix_date("target_date")
    near = noise.where(day >= F.unix_date("_end") - OnlineBias.WINDOW_DAYS)
    recent = F.array_sort(F.collect_list(F.struct(day.alias("day"), F.col("epsilon").alias("eps"))))
    redone = near.groupBy(*by, "_end", "b_k", "u_k", "state_version").agg(F.max_by("q_next", "target_date").alias("q"), recent.alias("_r"))
    redone = redone.select(
        *by, F.col("b_k").alias("b"), F.col("u_k").alias("u"), "q", F.col("state_version").alias("version"), F.unix_date("_end").alias("last"),
        F.col("_r.day").alias("days"), F.col("_r.eps").alias("eps"),
    )
    out = history.select(*by, "target_date", *bias.HISTORY, F.lit(False).alias("late"), F.lit(None).cast("bigint").alias("arrived"))
    return out.select(*rows.columns), states.join(touched, by, "left_anti").unionByName(redone)


def append_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a Parquet folder."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return _start(stream.sparkSession, writer.format("parquet").option("path", path))
