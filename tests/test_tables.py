"""File scans, sinks, parameters and contracts."""

import pytest
from pyspark.sql import functions as F

from brierworks import schemas
from brierworks.operators import series as W
from brierworks.params import DEFAULTS
from brierworks.sources import axis as AX, tables as TB


def test_read_obs_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station_id,valid,tmpf\nKATL,2024-01-01 00:53,30.5\nKATL,2024-01-01 01:53,M\nKJFK,2024-01-02 01:00,oops\n")
    rows = TB.read_obs_csv(spark, str(tmp_path / "a.csv")).orderBy("station_id", "valid").collect()
    assert [r.station_id for r in rows] == ["KATL", "KATL", "KJFK"]
    assert [r.temp_f for r in rows] == [30.5, None, None] and str(rows[0].local_date) == "2024-01-01"


def test_read_table_prunes(spark, tmp_path):
    spark.createDataFrame([("a", True), ("b", False)], schemas.contract("sources")).write.parquet(f"{tmp_path}/sources")
    df = TB.read_table(spark, str(tmp_path), "sources", "is_enabled", ["source_id"])
    assert [r.source_id for r in df.collect()] == ["a"]
    assert "PushedFilters: [IsNotNull(is_enabled), EqualTo(is_enabled,true)]" in df._jdf.queryExecution().executedPlan().toString()


def test_upsert_is_idempotent_and_local(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "k int, v double, d int")
    TB.write_upsert(spark, path, make([(1, 1.0, 1), (2, 2.0, 1), (3, 3.0, 2)]), ["k", "d"], "d", ["v"])
    untouched = {p.name for p in (tmp_path / "t" / "d=2").iterdir()}
    for _ in range(2):
        TB.write_upsert(spark, path, make([(1, 9.0, 1), (1, 5.0, 1), (4, 4.0, 1)]), ["k", "d"], "d", ["v"])
        got = spark.read.schema("k int, v double, d int").parquet(path)
        assert sorted(map(tuple, got.collect())) == [(1, 9.0, 1), (2, 2.0, 1), (3, 3.0, 2), (4, 4.0, 1)]
    assert {p.name for p in (tmp_path / "t" / "d=2").iterdir()} == untouched


def test_late_batch_does_not_overwrite(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "k int, v string, at int, d int")
    for rows in ([(1, "new", 5, 1), (2, "a", 1, 1)], [(1, "old", 3, 1), (2, "b", 2, 1), (3, "c", 0, 1)], [(1, "fixed", 5, 1)]):
        TB.write_upsert(spark, path, make(rows), ["k", "d"], "d", ["at"])
    got = spark.read.schema("k int, v string, at int, d int").parquet(path)
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "fixed"), (2, "b"), (3, "c")]


def test_repeated_polls_count_once(spark):
    make = lambda rows: spark.createDataFrame(rows, "s string, at int, t double")
    held = make([("KATL", 1, 50.0), ("KATL", 2, 60.0)])
    for polled in ([("KATL", 1, 50.0), ("KATL", 2, 60.0)], [("KATL", 2, 58.0), ("KATL", 0, 40.0)]):
        held = TB.merge_readings(held, make(polled), ["s"], "at")
    r = TB.accumulate_extremes(held, ["s"], "at", "t").first()
    assert (r.t_max_f, r.t_min_f, r.obs_count, r.last_obs_at) == (58.0, 40.0, 3, 2)


def test_params(spark):
    rows = spark.createDataFrame([("beta", "3.5", "float"), ("tranche_size", "10", "int"), ("unknown", "1", "int")], "param_key string, param_value string, dtype string")
    p = TB.load_params(rows)
    assert (p.beta, p.tranche_size, p.gamma) == (3.5, 10, DEFAULTS.gamma)


def test_every_contract_parses():
    assert all(schemas.columns(n) for n in schemas.CONTRACT_DDL) and len(schemas.CONTRACT_DDL) >= 34


def test_source_contract_is_checked(spark):
    TB.register_source("bad", lambda raw: raw.select("id"))
    with pytest.raises(ValueError):
        TB.ingest_source(spark.range(1), "bad", ["id", "high_f"])
    with pytest.raises(KeyError):
        TB.ingest_source(spark.range(1), "nobody", ["id"])


def test_local_day_across_clock_change(spark):
    df = spark.createDataFrame([("2024-03-10 04:59:00",), ("2024-03-10 05:00:00",), ("2024-03-11 03:59:00",), ("2024-03-11 04:00:00",)], "s string")
    days = df.select(AX.local_date(F.to_timestamp("s"), F.lit("America/New_York")).alias("d")).collect()
    assert [str(r.d) for r in days] == ["2024-03-09", "2024-03-10", "2024-03-10", "2024-03-11"]


def test_lags_and_fill_respect_gaps(spark):
    df = spark.createDataFrame([(1, f"2024-01-{d:02d}", float(d)) for d in (1, 2, 3, 7)], "k int, d string, v double").withColumn("d", F.to_date("d"))
    rows = W.calendar_lags(df, ["k"], "d", "v", [1]).withColumn("f", W.ffill(F.col("v"), ["k"], "d", 2)).orderBy("d").collect()
    assert [r.v_lag1 for r in rows] == [None, 1.0, 2.0, 3.0, None, None, None]
    assert [r.f for r in rows] == [1.0, 2.0, 3.0, 3.0, 3.0, None, 7.0]


def test_ewm_variance(spark):
    df = spark.createDataFrame([([1.0],), ([3.0, 3.0, 3.0],), ([0.0, 5.0, 0.0, 5.0, 0.0],)], "xs array<double>")
    a, b, c = [r[0] for r in df.select(W.ewm_variance_of(F.col("xs"))).collect()]
    assert a == 0.01 and b < 0.01 and c > 0.1
