"""Table scans, dimension loaders and sinks over plain Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from brierworks.operators.ordering import latest_per_key
from brierworks.params import DEFAULTS, Params
from brierworks.schemas import contract


def read_table(spark: SparkSession, root: str, name: str, where: Column | str | None = None, columns: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """SRC-01: declared-schema scan; filter and projection reach the Parquet reader."""
    df = spark.read.schema(schema or contract(name)).parquet(f"{root}/{name}")
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


OBS_CSV = "station_id string, valid string, tmpf string"


def typed_observations(df: DataFrame) -> DataFrame:
    """SRC-02: text readings to typed rows; ``M`` and other non-numbers become NULL. Ids stay text."""
    return df.select(
        "station_id",
        F.to_timestamp_ntz("valid", F.lit("yyyy-MM-dd HH:mm")).alias("valid"),
        F.to_date(F.substring("valid", 1, 10)).alias("local_date"),
        F.col("tmpf").try_cast("double").alias("temp_f"),
    )


def read_obs_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: scan of observation files with header."""
    return typed_observations(spark.read.schema(OBS_CSV).csv(path, header=True, nullValue="M"))


def parse_obs_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """SRC-02 on a column of text lines (landed as a table rather than as files)."""
    rec = F.from_csv(F.col(col), OBS_CSV, {"nullValue": "M"})
    keep = [c for c in lines.columns if c != col]
    flat = lines.select(*keep, rec.alias("_r")).select(*keep, "_r.*")
    return flat.select(
        *keep, "station_id",
        F.to_timestamp_ntz("valid", F.lit("yyyy-MM-dd HH:mm")).alias("valid"),
        F.to_date(F.substring("valid", 1, 10)).alias("local_date"),
        F.col("tmpf").try_cast("double").alias("temp_f"),
    )


def load_dims(stations: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-17: active stations and enabled sources."""
    return stations.filter("is_active"), sources.filter("is_enabled").select("source_id")


def load_params(overrides: DataFrame, base: Params = DEFAULTS) -> Params:
    """SRC-17: stored parameter overrides on top of the defaults. The table holds at most one row
    per known parameter, so it is read by key."""
    known = list(Params.__dataclass_fields__)
    rows = overrides.filter(F.col("param_key").isin(known)).groupBy("param_key").agg(F.max("param_value").alias("v"))
    return base.override({r["param_key"]: r["v"] for r in rows.limit(len(known)).collect()})


# ---------------------------------------------------------------- sinks

def upsert(target: DataFrame, src: DataFrame, keys: list[str], mode: str = "overwrite") -> DataFrame:
    """SNK-01 / SNK-02: the table after a keyed merge. ``overwrite`` takes the source row,
    ``coalesce`` keeps old values where the new ones are NULL."""
    others = [c for c in target.columns if c not in keys]
    s = src.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in others if c in src.columns], F.lit(True).alias("_new"))
    joined = target.withColumn("_old", F.lit(True)).join(s, keys, "full_outer")
    out = []
    for c in others:
        if c not in src.columns:
            out.append(F.col(c))
        elif mode == "coalesce":
            out.append(F.coalesce(f"_n_{c}", c).alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*keys, *out)


def write_upsert(spark: SparkSession, path: str, src: DataFrame, keys: list[str], partition: str, order: list[str], mode: str = "overwrite") -> None:
    """SNK-01 on plain files: only the partitions that receive rows are read and rewritten. Tables that are read while
    they are written belong in ``sources.snapshots``, which publishes whole versions.

    The newest source row per key wins, unless the stored row is newer by ``order``; so batches may
    arrive late or twice. The merged rows are checkpointed before they replace the files they were
    read from: a failed write can be repeated from there, but plain files have no atomic swap, so
    readers should not rely on a partition while it is written. Crowded partitions are split among
    writers.
    """
    from brierworks.session import cut_lineage

    newest = cut_lineage(latest_per_key(src, keys, [F.col(c).desc_nulls_last() for c in order]))
    merged = newest
    try:
        old = spark.read.schema(src.schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        touched = old.join(newest.select(partition).distinct(), partition, "left_semi")
        stamp = touched.select(*keys, F.struct(*order).alias("_stored"))
        fresh = newest.join(stamp, keys, "left").filter(F.col("_stored").isNull() | (F.struct(*order) >= F.col("_stored"))).drop("_stored")
        merged = cut_lineage(upsert(touched, fresh.select(*newest.columns), keys, mode))
    writer = merged.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition).parquet(path)


def register_runs(existing: DataFrame, incoming: DataFrame, natural_key: list[str]) -> DataFrame:
    """SNK-03: insert only unknown runs; the id is a digest of the natural key, so re-runs agree."""
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in natural_key]), 256)
    fresh = incoming.select(*natural_key).distinct().withColumn("run_id", digest)
    return existing.unionByName(fresh.join(existing.select("run_id"), "run_id", "left_anti"))


def merge_readings(held: DataFrame, polled: DataFrame, keys: list[str], at: str) -> DataFrame:
    """SNK-04, reading level: polls repeat readings and correct them. One row stays per key and
    instant, that of the newest poll."""
    both = held.withColumn("_poll", F.lit(0)).unionByName(polled.withColumn("_poll", F.lit(1)))
    rest = [F.col(c).desc_nulls_last() for c in held.columns if c not in (*keys, at)]
    return latest_per_key(both, [*keys, at], [F.col("_poll").desc(), *rest]).drop("_poll")


def accumulate_extremes(readings: DataFrame, keys: list[str], at: str, temp: str) -> DataFrame:
    """SNK-04: extremes of merged readings; max and min skip NULLs."""
    return readings.groupBy(*keys).agg(
        F.max(temp).alias("t_max_f"), F.min(temp).alias("t_min_f"), F.count(temp).alias("obs_count"), F.max(at).alias("last_obs_at")
    )


def append_history(df: DataFrame, path: str, run_id: str, date: str = "run_date") -> None:
    """SNK-05: append rows stamped with their run, one folder per date."""
    df.withColumn("run_stamp", F.lit(run_id)).write.mode("append").partitionBy(date).parquet(path)


def publish_book(spark: SparkSession, book: DataFrame, path: str, history: str, run_no: int) -> None:
    """DST-05, sinks: the newest price of every ticker, and each run's prices as history.

    ``book`` has ticker, target_date and whatever goes with them. A run that is published again, or
    after a later one, changes no current price; history keeps one copy per run and publication. Current prices
    are a table of ``sources.snapshots``: readers see all prices of a run or none."""
    from brierworks.sources import snapshots

    rows = book.withColumn("run_no", F.lit(run_no))
    snapshots.merge(spark, path, rows, ["ticker"], "target_date", ["run_no"])
    append_history(rows, history, str(run_no), "target_date")


def purge(df: DataFrame, asof: Column, days: int = DEFAULTS.retention_days) -> DataFrame:
    """SNK-06: what stays after dropping resolved rows older than ``days``."""
    old = F.col("is_resolved") & (F.col("resolved_ts") < asof - F.make_interval(days=F.lit(days)))
    return df.filter(~F.coalesce(old, F.lit(False)))


def finalize(df: DataFrame, date: Column, stamp: Column, on: str = "target_date", mark: str = "updated_at") -> DataFrame:
    """SNK-07: stamp the still open rows of one date."""
    return df.withColumn(mark, F.when((F.col(on) == date) & F.col(mark).isNull(), stamp).otherwise(F.col(mark)))


def export(df: DataFrame, path: str, fmt: str) -> None:
    """SNK-08: results as CSV or JSON files."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def conform(df: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """SNK-09: fit older rows to a contract: missing columns are added, NULLs take their default."""
    defaults = defaults or {}
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name))
    return df.select(*out)


def capture_amendments(stored: DataFrame, refetched: DataFrame, asof: Column, lookback: int, high: str = "observed_high_f", low: str = "observed_low_f") -> DataFrame:
    """SNK-10: adopt changed re-fetched values inside the look-back, keeping the originals."""
    new = refetched.select("station_id", "target_date", F.col(high).alias("_hi"), F.col(low).alias("_lo"), F.lit(True).alias("_seen"))
    recent = (F.col("target_date") >= F.date_sub(asof, lookback)) & (F.col("target_date") <= asof)
    changed = F.coalesce(F.col("_seen"), F.lit(False)) & recent & ~(F.col(high).eqNullSafe(F.col("_hi")) & F.col(low).eqNullSafe(F.col("_lo")))
    return (
        stored.join(new, ["station_id", "target_date"], "left")
        .withColumn("amended", changed)
        .withColumn("original_high_f", F.when(F.col("amended"), F.col(high)))
        .withColumn("original_low_f", F.when(F.col("amended"), F.col(low)))
        .withColumn(high, F.when(F.col("amended"), F.col("_hi")).otherwise(F.col(high)))
        .withColumn(low, F.when(F.col("amended"), F.col("_lo")).otherwise(F.col(low)))
        .drop("_hi", "_lo", "_seen")
    )


def amended_in_window(df: DataFrame, asof: Column, lookback: int) -> DataFrame:
    """SNK-10: the keys a replay has to start from."""
    return df.filter(F.col("amended") & (F.col("target_date") >= F.date_sub(asof, lookback))).select("station_id", "target_date")


# ---------------------------------------------------------------- UDF-02

SOURCES: dict[str, object] = {}


def register_source(name: str, transform) -> None:
    """UDF-02: make a raw-to-rows transform available under a source name."""
    SOURCES[name] = transform


def ingest_source(raw: DataFrame, name: str, required: list[str]) -> DataFrame:
    """UDF-02: run a registered transform and check its output columns."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}")
    out = raw.transform(SOURCES[name])
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"source {name!r} lacks {missing}")
    return out.select(*required)
