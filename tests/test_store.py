"""Stored tables: the same rows as plain ones, pruned months, joins without a shuffle."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from brierworks.sources import store as S

LAYOUT = S.Layout(buckets=3)
SCHEMA = "station_id string, target_date date, v double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two stores; a third of the rows are of one station, some lack a day or a station."""
    root, out = tmp_path_factory.mktemp("store"), {}
    for name, days in (("f", 120), ("o", 100)):
        rows = [("K0" if i % 3 == 0 else f"K{i % 7}", dt.date(2024, 1, 10) + dt.timedelta(i % days), float(i)) for i in range(900)]
        rows += [(None, dt.date(2024, 2, 1), -1.0), ("K1", None, -2.0), ("K1", None, -2.0)]
        df = spark.createDataFrame(rows, SCHEMA)
        table = f"{name}_{uuid.uuid4().hex}"
        S.write_store(df, table, f"{root}/{name}", LAYOUT)
        out[name] = (table, df, f"{root}/{name}")
    yield out
    for table, *_ in out.values():
        spark.sql(f"DROP TABLE {table}")


def rows_of(df):
    return sorted(map(tuple, df.select("station_id", "target_date", "v").collect()), key=str)


def test_content_and_range(spark, tables):
    table, df, _ = tables["f"]
    assert rows_of(S.read_store(spark, table)) == rows_of(df)
    a, b = F.lit(dt.date(2024, 2, 20)), F.lit(dt.date(2024, 3, 5))
    got = S.read_store(spark, table, LAYOUT, a, b)
    assert rows_of(got) == rows_of(df.filter(F.col("target_date").between(a, b)))
    files = {r["path"].split("store_month=")[1][:7] for r in got.select(F.col("_metadata.file_path").alias("path")).distinct().collect()}
    assert files == {"2024-02", "2024-03"} and "PartitionFilters: [isnotnull(store_month" in plan(got)


def test_days_prune_at_run_time(spark, tables):
    table, df, _ = tables["f"]
    days = spark.createDataFrame([(dt.date(2024, 3, 3), "again"), (dt.date(2024, 3, 3), "again"), (dt.date(2024, 1, 12), "fine"), (None, "again")], "d date, why string")
    got = S.on_days(S.read_store(spark, table), days.where("why = 'again'").select("d"), LAYOUT)
    assert "dynamicpruning" in plan(got)
    assert rows_of(got) == rows_of(df.filter(F.col("target_date") == dt.date(2024, 3, 3)))


def test_joins_and_groups_without_a_shuffle(spark, tables):
    (f, fc, _), (o, obs, _) = tables["f"], tables["o"]
    days = spark.createDataFrame([(dt.date(2024, 2, 1) + dt.timedelta(k), k) for k in range(40)], "d date, k int").where("k % 2 = 0").select("d")

    def joined(left, right):
        mean = left.groupBy("station_id", "target_date").agg(F.avg("v").alias("f"))
        top = right.groupBy("station_id", "target_date").agg(F.max("v").alias("o"))
        return mean.join(top.hint("merge"), ["station_id", "target_date"]).select("station_id", "target_date", (F.col("f") - F.col("o")).alias("v"))

    got = joined(S.on_days(S.read_store(spark, f), days, LAYOUT), S.on_days(S.read_store(spark, o), days, LAYOUT))
    text = plan(got)
    # the only exchanges are those of the broadcast days
    assert "SortMergeJoin" in text and "dynamicpruning" in text and "Bucketed: true" in text
    assert "hashpartitioning(station_id" not in text
    keep = lambda df: df.join(days.withColumnRenamed("d", "target_date"), "target_date", "left_semi")
    assert rows_of(got) == rows_of(joined(keep(fc), keep(obs)))


def test_opened_by_another_session(spark, tables):
    table, df, folder = tables["f"]
    other = f"again_{uuid.uuid4().hex}"
    S.open_store(spark.newSession(), other, folder, SCHEMA, LAYOUT)
    got = S.read_store(spark, other)
    assert rows_of(got) == rows_of(df)
    assert "hashpartitioning" not in plan(got.groupBy("station_id", "target_date").count())
    spark.sql(f"DROP TABLE {other}")
