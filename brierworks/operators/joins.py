"""Joins Spark has no single keyword for: as-of, range, circular, sweep and resolution joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brierworks.functions.scalar import in_bin
from brierworks.operators.ordering import join_keys, latest_per_key, running, ts_number


def attach_issue(fc: DataFrame, runs: DataFrame) -> DataFrame:
    """J-01."""
    return fc.join(runs.select("run_id", "issued_at"), "run_id")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    payload: list[str],
    strict: bool = True,
    bounded: bool = False,
    n_blocks: int | None = None,
) -> DataFrame:
    """J-07: attach the most recent right row before (``strict``) or at-or-before each left row.

    Both sides go through one union; the last right payload is carried forward in time order with
    block-wise prefixes, so a key holding a third of the rows is still spread over many tasks, and so is an
    instant. Of right rows with one key and time, that with the greatest hash counts.
    """
    state = F.struct(*[F.col(c) for c in payload])
    lefts = left.columns
    kept = F.struct(*[F.col(c) for c in lefts])
    a = left.select(*by, F.col(left_on).alias("_at"), F.lit(0 if strict else 1).alias("_side"), kept.alias("_row"))
    b = right.select(*by, F.col(right_on).alias("_at"), F.lit(1 if strict else 0).alias("_side"), state.alias("_state"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_tie", F.xxhash64("_row", "_state"))
    number = ts_number(F.col("_at")) if dict(both.dtypes)["_at"] != "date" else F.unix_date("_at")
    filled = running(
        both, by, ["_at", "_side", "_tie"], {"_hit": ("last", F.col("_state"))}, None if bounded else number, n_blocks
    )
    return filled.filter(F.col("_row").isNotNull()).select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in payload])


def locate_bin(
    values: DataFrame, bins: DataFrame, by: list[str], value: str, width: float, salt: int = 1
) -> DataFrame:
    """J-04: find the half-open bin a value falls in. Bins are spread over buckets of ``width`` so the
    join has an equality key; bins with an open edge go under their own bucket tag. ``salt`` copies the
    small bin side so one crowded (group, bucket) is shared by several tasks.
    """
    lo, hi = F.floor(F.col("bin_lower") / width), F.floor(F.col("bin_upper") / width)
    closed = F.col("bin_lower").isNotNull() & F.col("bin_upper").isNotNull()
    # one extra tag per open side: tested against every value of the group, at most two bins per group
    buckets = F.when(closed, F.sequence(lo, hi)).otherwise(F.array(F.lit(None).cast("bigint")))
    tags = bins.withColumn("_bucket", F.explode(buckets))
    narrow = tags.filter(F.col("_bucket").isNotNull())
    open_ended = tags.filter(F.col("_bucket").isNull()).drop("_bucket")
    keyed = values.withColumn("_bucket", F.floor(F.col(value) / width))
    on = [*by, "_bucket"]
    if salt > 1:
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(*values.columns), F.lit(salt)).cast("int"))
        narrow = narrow.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salt)])))
        open_ended = open_ended.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salt)])))
        on = [*on, "_salt"]
    hit = in_bin(F.col(value), F.col("bin_lower"), F.col("bin_upper"))
    inner = keyed.join(narrow, on).filter(hit).drop("_bucket", "_salt")
    tails = keyed.drop("_bucket").join(open_ended, [c for c in on if c != "_bucket"]).filter(hit).drop("_salt")
    return inner.unionByName(tails)


def attach_bracket(graded: DataFrame, errors: DataFrame, default: str = "h3", fanout: bool = False) -> DataFrame:
    """J-05: borrow the lead bracket of the errors; ``fanout`` keeps one row per source."""
    keys = ["station_id", "target_date", "target_type"]
    table = errors.select(*keys, "lead_bracket")
    if not fanout:
        table = table.groupBy(*keys).agg(F.min("lead_bracket").alias("lead_bracket"))
    return graded.join(table, keys, "left").withColumn("lead_bracket", F.coalesce("lead_bracket", F.lit(default)))


def attach_latest(preds: DataFrame, snaps: DataFrame, key: str = "ticker", at: str = "snapshot_at", tie: str = "snapshot_id") -> DataFrame:
    """J-06: newest snapshot of each ticker; a prediction without one keeps NULLs."""
    newest = latest_per_key(snaps, [key], [F.col(at).desc(), F.col(tie).desc()])
    return preds.join(newest, key, "left")


def in_run(snaps: DataFrame, preds: DataFrame, key: str = "ticker") -> DataFrame:
    """J-08."""
    return snaps.join(preds.select(key), key, "left_semi")


def not_held(bets: DataFrame, positions: DataFrame, key: str = "ticker") -> DataFrame:
    """J-09."""
    return bets.join(positions.select(key), key, "left_anti")


def attach_dims(df: DataFrame, *dims: tuple[DataFrame, list[str]]) -> DataFrame:
    """J-11: look up small dimensions; their counted size decides whether they are broadcast."""
    for dim, keys in dims:
        df = join_keys(df, dim, keys, "left")
    return df


def seasonal_mean(hist: DataFrame, by: list[str], date: str, value: str, window: int = 7) -> DataFrame:
    """J-13: mean over all years of the days within ``window`` of each day of the year.

    Sums per day of year come first (at most 366 rows per key), then each is spread to its
    neighbours, so the row-level data are shuffled once and already reduced.
    """
    doy = hist.groupBy(*by, F.dayofyear(date).alias("_d")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    # distance 358..365 also counts as near: the year wraps
    near = F.filter(
        F.sequence(F.lit(1), F.lit(366)),
        lambda x: (F.abs(x - F.col("_d")) <= window) | (F.abs(x - F.col("_d")) >= 365 - window),
    )
    spread = doy.select(*by, F.explode(near).alias("doy"), "_s", "_n")
    return spread.groupBy(*by, "doy").agg(
        (F.sum("_s") / F.sum("_n")).alias("seasonal_mean"), F.sum("_n").alias("n")
    )


def sweep(df: DataFrame, by: list[str], grid: list[float], loss: "callable", name: str = "value", width: int = 32) -> DataFrame:
    """J-14: objective per key and grid value. A row feeds ``width`` sums at once; only wider grids
    copy rows, once for each ``width`` values. Partial sums are taken before the shuffle, so traffic
    is keys x grid whatever the number of rows."""
    grid = [float(g) for g in grid]
    parts = [grid[i : i + width] for i in range(0, len(grid), width)]
    at = lambda j: F.get(F.array(*[F.lit(x[j] if j < len(x) else None).cast("double") for x in parts]), F.col("_part"))
    values = [at(j) if len(parts) > 1 else F.lit(grid[j]) for j in range(len(parts[0]))]
    rows = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))) if len(parts) > 1 else F.lit(0))
    sums = rows.groupBy(*by, "_part").agg(*[F.sum(loss(w)).alias(f"_s{j}") for j, w in enumerate(values)])
    pairs = F.array(*[F.struct(w.alias(name), F.col(f"_s{j}").alias("objective")) for j, w in enumerate(values)])
    return sums.select(*by, F.inline(pairs)).filter(F.col(name).isNotNull())


def sweep_best(swept: DataFrame, by: list[str], name: str = "value") -> DataFrame:
    """Grid value with the least objective, the smallest one on ties."""
    return swept.groupBy(*by).agg(
        F.min_by(name, F.struct("objective", name)).alias(name), F.min("objective").alias("objective")
    )


def align_actuals(fc: DataFrame, obs: DataFrame, how: str = "inner") -> DataFrame:
    """J-15: training keeps matched days only, inference keeps every forecast."""
    return fc.join(obs, ["station_id", "target_date"], how)


def exposure_by_office(positions: DataFrame, stations: DataFrame) -> DataFrame:
    """J-16: sums per station first, so the office join and regroup see one row per station."""
    by_station = positions.groupBy("station_id").agg(F.sum(F.col("entry_price") * F.col("contracts")).alias("exposure"))
    return by_station.join(stations, "station_id").groupBy("office").agg(F.sum("exposure").alias("exposure"))


def consensus(fc: DataFrame, skill: DataFrame, floor: float, tol: float = 1.0) -> DataFrame:
    """J-17: share of qualified sources within ``tol`` of the qualified mean."""
    grp = ["station_id", "target_date", "target_type"]
    good = fc.join(skill.filter(F.col("skill") > floor), ["station_id", "target_type", "source_id"], "left_semi")
    mean = good.groupBy(*grp).agg(F.avg("f").alias("f_bar"))
    near = F.avg(F.when(F.abs(F.col("f") - F.col("f_bar")) <= tol, 1.0).otherwise(0.0))
    return good.join(mean, grp).groupBy(*grp).agg(near.alias("hmas"), F.count(F.lit(1)).alias("n_qualified")).withColumn(
        "hmas_mod", 0.7 + 0.6 * F.col("hmas")
    )


def stale_keys(dim: DataFrame, readings: DataFrame, asof: Column, minutes: int, key: str = "station_id", at: str = "ts") -> DataFrame:
    """J-10: members of the dimension without a reading in the last ``minutes``."""
    last = readings.groupBy(key).agg(F.max(at).alias("last_at"))
    limit = asof - F.expr(f"interval {minutes} minutes")
    return dim.join(last, key, "left").filter(F.col("last_at").isNull() | (F.col("last_at") < limit))


def missed_runs(expected: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """J-18: scheduled runs with no matching record."""
    return expected.join(runs.select(*keys).distinct(), keys, "left_anti")
