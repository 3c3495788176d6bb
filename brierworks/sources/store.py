"""SRC-01 on stored tables: partitioned by month and bucketed by the join keys.

A store is a catalog table of Parquet files. A date range, or a join with a table of days, opens only the months it
needs; two stores of one layout join and aggregate by their keys without a shuffle, however often that is done. Keys
should hold the day beside the station, so that a crowded station lies in all buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MONTH = "store_month"


@dataclass(frozen=True)
class Layout:
    """``keys`` are spread over ``buckets``; ``day`` is the date column. Tables that are joined share a layout. A bucket is
    read by one task, so there should be as many as it takes for the months read at once to fit (some 128 MB each)."""

    day: str = "target_date"
    keys: tuple[str, ...] = ("station_id", "target_date")
    buckets: int = 8


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def write_store(df: DataFrame, name: str, folder: str, layout: Layout = Layout()) -> None:
    """Write ``df`` as the new table ``name`` in ``folder``. Rows are dealt by bucket first, so a month has one file in each
    bucket, sorted by the keys. Rows without a day have a partition of their own."""
    dealt = df.withColumn(MONTH, month_of(F.col(layout.day))).repartition(layout.buckets, *layout.keys)
    writer = dealt.write.partitionBy(MONTH).bucketBy(layout.buckets, *layout.keys).sortBy(*layout.keys)
    writer.option("path", folder).format("parquet").saveAsTable(name)


def open_store(spark: SparkSession, name: str, folder: str, schema: str, layout: Layout = Layout()) -> None:
    """Enter a store that another session has written into this session's catalog, with the months it has."""
    keys = ", ".join(f"`{k}`" for k in layout.keys)
    spark.sql(
        f"CREATE TABLE `{name}` ({schema}, {MONTH} DATE) USING parquet PARTITIONED BY ({MONTH}) "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout.buckets} BUCKETS LOCATION '{folder}'"
    )
    spark.catalog.recoverPartitions(name)


def read_store(spark: SparkSession, name: str, layout: Layout = Layout(), since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows of the days from ``since`` to ``until``, both included; only their months are listed and read."""
    df, day = spark.table(name), F.col(layout.day)
    if since is not None:
        df = df.filter((F.col(MONTH) >= month_of(since)) & (day >= since))
    if until is not None:
        df = df.filter((F.col(MONTH) <= month_of(until)) & (day <= until))
    return df


def on_days(df: DataFrame, days: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Rows of a store whose day is in ``days`` (one date column). Which months are read is found when the query runs, from
    the days that are left by then. Days are distinct, so the calendar bounds what is broadcast."""
    wanted = days.select(F.col(days.columns[0]).cast("date").alias(layout.day)).distinct()
    wanted = wanted.withColumn(MONTH, month_of(F.col(layout.day)))
    return df.join(F.broadcast(wanted), [MONTH, layout.day], "left_semi")
