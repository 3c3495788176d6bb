"""Streams in several batches against the batch operators."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brierworks.operators import bias as K
from brierworks.plans import bindings as B
from brierworks.plans.verify_queries import errors
from brierworks.sources import snapshots
from brierworks.streaming import feeds as S
from conftest import SF


def split_files(df, path, order, n=4):
    """One file per chunk of the order column, written in that order."""
    bounds = df.approxQuantile(order, [i / n for i in range(1, n)], 0.0)
    edges = [float("-inf"), *bounds, float("inf")]
    for i in range(n):
        df.filter((F.col(order) > edges[i]) & (F.col(order) <= edges[i + 1])).coalesce(1).write.mode("append").parquet(path)


def plain(schema):
    """A stream's schema without its watermark."""
    return StructType.fromJson(schema.jsonValue())


def wait(q):
    q.awaitTermination()
    assert q.exception() is None


def test_extremes_in_batches(spark, tmp_path):
    rd = B.readings(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("sec", F.col("ts").cast("double"))
    split_files(rd, f"{tmp_path}/in", "sec")
    stream = S.table_stream(spark, f"{tmp_path}/in", rd.schema, files_per_batch=1)
    out = S.extremes_stream(stream)
    wait(S.keep_table(out, f"{tmp_path}/t", f"{tmp_path}/c", ["station_id", "local_date"], "local_date", ["revision"]))
    got = snapshots.read(spark, f"{tmp_path}/t", plain(out.schema)).select("station_id", "local_date", "t_max_f", "t_min_f", "obs_count")
    want = rd.groupBy("station_id", F.to_date("ts").alias("local_date")).agg(F.max("temp_f"), F.min("temp_f"), F.count("temp_f"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


READINGS = "station_id string, at string, temp_f double, poll int"


def poll(spark, path, rows):
    df = spark.createDataFrame(rows, READINGS).select("station_id", F.to_timestamp("at").alias("ts"), "temp_f", "poll")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_corrected_readings_are_taken_back(spark, tmp_path):
    polls = [
        [("KATL", "2024-01-01 01:00:00", 90.0, 1), ("KATL", "2024-01-01 02:00:00", 50.0, 1), ("KJFK", "2024-01-01 02:00:00", None, 1)],
        [("KATL", "2024-01-01 01:00:00", 60.0, 2), ("KATL", "2024-01-01 01:00:00", 99.0, 1), ("KATL", "2024-01-01 03:00:00", 55.0, 2)],
        [("KATL", "2024-01-01 02:00:00", None, 3), ("KATL", "2024-01-02 00:00:00", 1.0, 3), ("KJFK", "2024-01-01 02:00:00", 7.0, 3)],
        [("KATL", "2024-01-01 03:00:00", 55.0, 4)],
    ]
    want = [(90.0, 50.0, 2), (60.0, 50.0, 3), (60.0, 55.0, 2), (60.0, 55.0, 2)]
    versions = []
    for rows, expected in zip(polls, want):
        schema = poll(spark, f"{tmp_path}/in", rows)
        out = S.extremes_stream(S.table_stream(spark, f"{tmp_path}/in", schema), lateness="2 days", poll="poll")
        wait(S.keep_table(out, f"{tmp_path}/t", f"{tmp_path}/c", ["station_id", "local_date"], "local_date", ["revision"]))
        r = snapshots.read(spark, f"{tmp_path}/t", plain(out.schema)).where("station_id = 'KATL' AND local_date = '2024-01-01'").first()
        assert (r.t_max_f, r.t_min_f, r.obs_count) == expected and str(r.last_obs_at) in ("2024-01-01 02:00:00", "2024-01-01 03:00:00")
        versions.append(snapshots.current(spark, f"{tmp_path}/t"))
    assert versions[2] == versions[3]  # a repeated poll publishes nothing
    jfk = snapshots.read(spark, f"{tmp_path}/t", plain(out.schema)).where("station_id = 'KJFK'").first()
    assert (jfk.t_max_f, jfk.t_min_f, jfk.obs_count) == (7.0, 7.0, 1)


def test_readings_of_a_past_day_are_forgotten(spark, tmp_path):
    for k, at in enumerate(("2024-01-01 01:00:00", "2024-02-01 01:00:00", "2024-02-01 02:00:00", "2024-02-01 03:00:00")):
        schema = poll(spark, f"{tmp_path}/in", [("KATL", at, 50.0 + k, k)])
        wait(S.keep_table(S.extremes_stream(S.table_stream(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/t", f"{tmp_path}/c", ["station_id", "local_date"], "local_date", ["revision"]))
    held = spark.read.format("statestore").option("stateVarName", "sums").load(f"{tmp_path}/c")
    assert [str(r[0]) for r in held.select("key.local_date").collect()] == ["2024-02-01"]


def test_late_days_are_replayed(spark, tmp_path):
    """Inserted and corrected days, a key without late days, and a new query that goes on from the replayed states."""
    by, day = ["station_id", "target_type"], F.col("d")
    rows = [(s, "HIGH", d, float((d * 7 + s * 3) % 11) - 5) for s in (1, 2) for d in range(90)]
    df = spark.createDataFrame(rows, "station_id bigint, target_type string, d int, epsilon double")
    df = df.withColumn("target_date", F.date_add(F.lit("2024-01-01").cast("date"), day)).withColumn("r_k", F.lit(0.5) + day % 3)
    late = (F.col("station_id") == 1) & day.isin(0, 40, 41)
    fixed = df.withColumn("epsilon", F.when((F.col("station_id") == 1) & (day == 50), 9.0).otherwise(F.col("epsilon")))
    for batch in (df.where(~late & (day < 70)), fixed.where((late | (day == 50)) & (day < 70) & (F.col("station_id") == 1))):
        batch.drop("d").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.table_stream(spark, f"{tmp_path}/in", df.drop("d").schema)
        wait(S.append_table(S.bias_stream(stream), f"{tmp_path}/t", f"{tmp_path}/c"))
    out = spark.read.schema(S.BIAS_OUT).parquet(f"{tmp_path}/t")
    assert out.where("late").count() == 4
    history, states = S.replay_bias(out, S.bias_states(spark, f"{tmp_path}/c"))
    history, states = history.cache(), states.cache()
    assert states.count() == 2 and history.count() == 140
    df.where(day >= 70).drop("d").coalesce(1).write.parquet(f"{tmp_path}/in2")
    stream = S.table_stream(spark, f"{tmp_path}/in2", df.drop("d").schema)
    wait(S.append_table(S.bias_stream(stream, states=states), f"{tmp_path}/t2", f"{tmp_path}/c2"))
    got = history.unionByName(spark.read.schema(S.BIAS_OUT).parquet(f"{tmp_path}/t2")).orderBy(*by, "target_date").select("b_k", "u_k", "q_k", "r_k", "state_version").collect()
    want = K.kalman_filter(fixed.drop("d"), by).orderBy(*by, "target_date").select("b_k", "u_k", "q_k", "r_k", "state_version").collect()
    assert len(got) == len(want) == 180
    for x, y in zip(got, want):
        assert tuple(x) == pytest.approx(tuple(y))


def test_bias_in_batches_and_late_days(spark, tmp_path):
    by = ["station_id", "target_type"]
    series = K.daily_errors(errors(spark, SF), by).withColumn("d", F.unix_date("target_date").cast("double"))
    split_files(series, f"{tmp_path}/in", "d", 3)
    late = series.groupBy(*by).agg(F.min_by(F.struct("target_date", "epsilon", "d"), "d").alias("x")).select(*by, "x.*")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = S.table_stream(spark, f"{tmp_path}/in", series.schema, files_per_batch=1)
    wait(S.append_table(S.bias_stream(stream.select(*by, "target_date", "epsilon")), f"{tmp_path}/t", f"{tmp_path}/c"))
    got = spark.read.schema(S.BIAS_OUT).parquet(f"{tmp_path}/t")
    assert got.filter("late").count() == late.count()
    a = got.filter("NOT late").orderBy(*by, "target_date").select("b_k", "u_k", "state_version").collect()
    b = K.kalman_filter(series.drop("d"), by).orderBy(*by, "target_date").select("b_k", "u_k", "state_version").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert tuple(x) == pytest.approx(tuple(y))


def test_book_ignores_older_snapshot(spark, tmp_path):
    schema = "ticker int, snapshot_id int, snapshot_at timestamp_ntz, price double"

    def land(rows):
        df = spark.createDataFrame(rows, "ticker int, snapshot_id int, at string, price double")
        df.select("ticker", "snapshot_id", F.to_timestamp_ntz("at").alias("snapshot_at"), "price").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    for rows in ([(1, 2, "2024-01-02 00:00:00", 0.5), (2, 1, "2024-01-01 00:00:00", 0.1)], [(1, 1, "2024-01-01 00:00:00", 0.9), (2, 3, "2024-01-05 00:00:00", 0.2)]):
        land(rows)
        wait(S.latest_book_stream(S.table_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), f"{tmp_path}/t", f"{tmp_path}/c", 4))
    got = snapshots.read(spark, f"{tmp_path}/t", schema + ", bucket int")
    assert sorted((r.ticker, r.price) for r in got.collect()) == [(1, 0.5), (2, 0.2)]


def test_text_station_ids(spark, tmp_path):
    rows = [("KATL", "2024-01-01 00:00:00"), ("KJFK", "2024-01-01 05:00:00"), ("KJFK", "2024-01-01 09:00:00")]
    rd = spark.createDataFrame(rows, "station_id string, at string").select("station_id", F.to_timestamp("at").alias("ts"))
    rd.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = S.stale_stream(S.table_stream(spark, f"{tmp_path}/in", rd.schema))
    wait(S.append_table(out, f"{tmp_path}/t", f"{tmp_path}/c"))
    assert [r.station_id for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/t").collect()] == ["KATL"]
    errors_ = spark.createDataFrame([("KATL", "HIGH", "2024-01-01", 1.5)], "station_id string, target_type string, d string, epsilon double")
    errors_ = errors_.select("station_id", "target_type", F.to_date("d").alias("target_date"), "epsilon")
    errors_.coalesce(1).write.parquet(f"{tmp_path}/e")
    out = S.bias_stream(S.table_stream(spark, f"{tmp_path}/e", errors_.schema))
    wait(S.append_table(out, f"{tmp_path}/b", f"{tmp_path}/d"))
    assert [(r.station_id, r.state_version) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/b").collect()] == [("KATL", 1)]
