"""Error statistics, skill, calibration and degradation alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.functions.scalar import brier, in_bin, lead_bracket, preferred_error, shrink, trailing, unbiased_skew
from brierworks.operators.joins import attach_issue
from brierworks.operators.ordering import grouped_percentiles, join_keys, latest_per_key
from brierworks.params import DEFAULTS, Params
from brierworks.session import cut_lineage

CELL = ["station_id", "target_type", "lead_bracket"]
GROUP = ["station_id", "target_date", "target_type"]
BRACKETS = ("h1", "h2", "h3", "h4", "h5")


def bracket_ordinal(c: Column) -> Column:
    return F.substring(c, 2, 1).cast("int")


def unpivot_targets(df: DataFrame, ids: list[str], high: str, low: str, name: str) -> DataFrame:
    """PRJ-01: one row per target type, NULL measures dropped, in one pass."""
    wide = df.select(*ids, F.col(high).alias("HIGH"), F.col(low).alias("LOW"))
    return wide.unpivot(ids, ["HIGH", "LOW"], "target_type", name).filter(F.col(name).isNotNull())


def latest_forecasts(fc: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest issue per station, source and date."""
    return latest_per_key(
        attach_issue(fc, runs),
        ["station_id", "source_id", "target_date"],
        [F.col("issued_at").desc(), F.col("run_id").desc()],
    )


def forecast_errors(
    fc: DataFrame, runs: DataFrame, obs: DataFrame, p: Params = DEFAULTS,
    since: Column | None = None, until: Column | None = None, max_lead_days: int | None = None,
) -> DataFrame:
    """J-02: forecast minus observation per source and target type, from the newest issue.

    ``since`` and ``until`` limit the target dates before anything is joined, so they reach the scans
    of forecasts and observations. Given ``max_lead_days``, no forecast is issued longer before its
    date, and the runs are limited too."""
    day = F.col("target_date")
    for bound, inside in ((since, lambda c: c >= since), (until, lambda c: c <= until)):
        if bound is not None:
            fc, obs = fc.filter(inside(day)), obs.filter(inside(day))
    if since is not None and max_lead_days is not None:
        runs = runs.filter(F.col("issued_at") >= F.date_sub(since, max_lead_days).cast("timestamp_ntz"))
    ids = ["station_id", "source_id", "target_date", "lead_hours"]
    f = unpivot_targets(latest_forecasts(fc, runs), ids, "high_f", "low_f", "f_raw")
    o = unpivot_targets(obs, ["station_id", "target_date"], "observed_high_f", "observed_low_f", "observed")
    return f.join(o, GROUP).select(
        "station_id",
        "source_id",
        "target_date",
        "target_type",
        lead_bracket(F.col("lead_hours"), p).alias("lead_bracket"),
        "f_raw",
        "observed",
        (F.col("f_raw") - F.col("observed")).alias("error_raw"),
        F.lit(None).cast("double").alias("error_adjusted"),
    )


def used_errors(errors: DataFrame) -> DataFrame:
    """PRJ-05: the error each statistic works on; rows with neither form are dropped."""
    return errors.withColumn("e", preferred_error(F.col("error_adjusted"), F.col("error_raw"))).filter(
        F.col("e").isNotNull()
    )


def dashboard(errors: DataFrame, asof: Column, windows: tuple[int, ...] = (2, 3, 7, 14, 30, 90)) -> DataFrame:
    """AGG-01: error statistics per source cell over several trailing windows.

    A cell holds one row per day of the widest window, so its errors are a bounded array. Each row is shuffled once, with
    its age, however many windows it is in; the array is sorted once, and every window reads its statistics from the part
    that is young enough, which is still sorted.
    """
    age = F.datediff(asof, F.col("target_date"))
    cell = ["station_id", "source_id", "target_type", "lead_bracket"]
    base = trailing(used_errors(errors), "target_date", asof, max(windows))
    cells = base.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct(F.col("e").cast("double").alias("e"), age.alias("age")))).alias("held"))

    def inside(w: Column) -> Column:
        young = F.filter("held", lambda x: x["age"] <= w)
        return F.struct(w.alias("window_days"), F.transform(young, lambda x: x["e"]).alias("v"))

    wide = cells.select(*cell, F.explode(F.transform(F.array(*[F.lit(w) for w in windows]), inside)).alias("w"))
    rows = wide.select(*cell, "w.window_days", "w.v").filter(F.size("v") > 0)
    n = F.size("v").cast("long")
    rows = rows.withColumns({"n": n, "bias": _total("v", lambda x: x) / n})
    away = lambda power: _total("v", lambda x: F.pow(x - F.col("bias"), F.lit(power))) / n
    level = F.element_at("v", 1) == F.element_at("v", -1)
    rows = rows.withColumn("skew_biased", F.when((n < 3) | level, 0.0).otherwise(away(3) / F.pow(away(2), F.lit(1.5))))
    share = lambda test: _total("v", lambda x: F.when(test(x), 1.0).otherwise(0.0)) / n
    return rows.select(
        *cell,
        "window_days",
        "n",
        "bias",
        (_total("v", F.abs) / n).alias("mae"),
        F.sqrt(_total("v", lambda x: x * x) / n).alias("rmse"),
        *[_sorted_percentile("v", q / 100.0).alias(f"p{q}") for q in (10, 25, 50, 75, 90)],
        share(lambda x: F.abs(x) <= 0.5).alias("pct_within_05"),
        share(lambda x: F.abs(x) <= 1.0).alias("pct_within_1"),
        share(lambda x: x > 0).alias("pct_over"),
        share(lambda x: x < 0).alias("pct_under"),
        "skew_biased",
        unbiased_skew(F.col("n"), F.col("skew_biased")).alias("skew_unbiased"),
    )


def _total(values: str, of: Callable[[Column], Column]) -> Column:
    """Sum over an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + of(x))


def _sorted_percentile(values: str, q: float) -> Column:
    """Percentile of a sorted array that is not empty, linear between neighbours."""
    place = (F.size(values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    below, above = F.get(F.col(values), low), F.get(F.col(values), F.ceil(place).cast("int"))
    return below + (above - below) * (place - low)


def _skew_or_zero(col: str) -> Column:
    s = F.skewness(col)
    degenerate = (F.count(col) < 3) | s.isNull() | F.isnan(s)
    return F.when(degenerate, 0.0).otherwise(s)


def skew(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """AGG-02: m3 / m2^1.5, zero for fewer than three values or no variance."""
    return df.groupBy(*by).agg(F.count(col).alias("n"), _skew_or_zero(col).alias("g"))


def robust_skew(df: DataFrame, col: str, by: list[str], p: Params = DEFAULTS) -> DataFrame:
    """AGG-03: small-sample corrected skewness, clamped to zero where not significant."""
    return skew(df, col, by).withColumn("g1", unbiased_skew(F.col("n"), F.col("g"), p))


def recent_errors(errors: DataFrame, asof: Column | None, p: Params = DEFAULTS) -> DataFrame:
    """Errors of the trailing window that are known before the day ``asof``; all of them without one."""
    if asof is None:
        return errors
    return errors.filter((F.col("target_date") >= F.date_sub(asof, p.rmse_window_days)) & (F.col("target_date") < asof))


def rmse_by(errors: DataFrame, by: list[str]) -> DataFrame:
    """AGG-04 / AGG-05: root mean square error and count at any level."""
    return used_errors(errors).groupBy(*by).agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count("e").alias("n")
    )


def pooled_rmse(errors: DataFrame) -> DataFrame:
    """AGG-05."""
    return rmse_by(errors, ["target_type", "lead_bracket"])


def robust_sigma(sigmas: DataFrame, by: list[str], pool_by: list[str], date: str = "target_date", sigma: str = "sigma", window: int = 7) -> DataFrame:
    """AGG-06: drop members above twice their own rolling mean, then median and mean of members.

    ``sigmas`` is a daily series per member, so the rolling window is bounded; the pool over all
    members is not, hence the distributed percentile.
    """
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(-(window - 1), 0)
    kept = cut_lineage(sigmas.withColumn("_roll", F.avg(sigma).over(w)).filter(F.col(sigma) <= 2.0 * F.col("_roll")))
    mean = kept.groupBy(*pool_by).agg(F.avg(sigma).alias("sigma_mean"), F.count(sigma).alias("n"))
    return grouped_percentiles(kept, pool_by, sigma, {"sigma_median": 0.5}).join(mean, pool_by)


def shrink_sigma(errors: DataFrame, p: Params = DEFAULTS, asof: Column | None = None) -> DataFrame:
    """AGG-07: cell sigma pulled to the pooled sigma of its type and bracket, over the window before ``asof``."""
    cell = cut_lineage(rmse_by(recent_errors(errors, asof, p), CELL))
    # pooled from cell sums: the second level costs one row per cell
    pool = cell.groupBy("target_type", "lead_bracket").agg(
        F.sqrt(F.sum(F.col("rmse") * F.col("rmse") * F.col("n")) / F.sum("n")).alias("pooled")
    )
    return join_keys(cell, pool, ["target_type", "lead_bracket"]).withColumn(
        "sigma_adj", shrink(F.col("n"), F.col("rmse"), F.col("pooled"), p)
    )


def grade(preds: DataFrame, obs: DataFrame) -> DataFrame:
    """J-03 / AGG-11: outcome and score of every prediction that has been observed."""
    o = unpivot_targets(obs, ["station_id", "target_date"], "observed_high_f", "observed_low_f", "observed")
    hit = F.when(in_bin(F.col("observed"), F.col("bin_lower"), F.col("bin_upper")), 1).otherwise(0)
    return preds.join(o, GROUP).withColumn("outcome", hit).withColumn("brier", brier(F.col("p_win"), F.col("outcome")))


def skill_matrix(graded: DataFrame, asof: Column, p: Params = DEFAULTS) -> DataFrame:
    """AGG-12: Brier skill against climatology per cell, cells with enough rows only."""
    clim = (F.lit(p.climatology) - F.col("outcome")) * (F.lit(p.climatology) - F.col("outcome"))
    cells = (
        trailing(graded, "target_date", asof, p.skill_window_days)
        .groupBy(*CELL)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(brier(F.col("p"), F.col("outcome"))).alias("bs_model"), F.avg(clim).alias("bs_clim"))
    )
    bss = F.when(F.col("bs_clim") > 0, 1.0 - F.col("bs_model") / F.col("bs_clim"))
    return cells.filter(F.col("n") >= p.skill_min_rows).withColumn("bss", bss)


def market_skill(graded: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """AGG-13: skill against the market's own probabilities."""
    out = graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(brier(F.col("p"), F.col("outcome"))).alias("bs_model"),
        F.avg(brier(F.col(price), F.col("outcome"))).alias("bs_market"),
    )
    return out.withColumn("bss_market", F.when(F.col("bs_market") > 0, 1.0 - F.col("bs_model") / F.col("bs_market")))


def calibration_bins(df: DataFrame, p: str, outcome: str, by: list[str] | None = None, buckets: int = 10) -> DataFrame:
    """AGG-14: mean probability and frequency per probability bucket."""
    bucket = F.least(F.floor(F.col(p) * buckets), F.lit(buckets - 1)).cast("int")
    return df.groupBy(*(by or []), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(outcome).alias("freq")
    )


def calibration(df: DataFrame, p: str, outcome: str, by: list[str] | None = None, buckets: int = 10) -> DataFrame:
    """AGG-14: mean gap over the non-empty buckets, NULL below ten rows."""
    gap = F.avg(F.abs(F.col("mean_p") - F.col("freq")))
    return calibration_bins(df, p, outcome, by, buckets).groupBy(*(by or [])).agg(
        F.sum("n").alias("n"), F.when(F.sum("n") >= 10, gap).alias("calibration_error")
    )


def hysteresis(df: DataFrame, by: list[str], order: str, bss: str = "bss", p: Params = DEFAULTS) -> DataFrame:
    """W-10: qualification that is entered at one threshold and left at a lower one, and its changes.

    At or above the entry level the answer is yes, below the exit level or unknown it is no,
    between them it is whatever it was: a carry-forward, not a fold.
    """
    b = F.col(bss)
    signal = F.when(b >= p.skill_enter, 1).when(b.isNull() | (b < p.skill_exit), 0)
    w = Window.partitionBy(*by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(signal, ignorenulls=True).over(run), F.lit(0))
    with_state = df.withColumn("_q", state)
    before = F.lag("_q", 1, 0).over(w)
    return (
        with_state.withColumn("qualified", F.col("_q") == 1)
        .withColumn("entered", (F.col("_q") == 1) & (before == 0))
        .withColumn("exited", (F.col("_q") == 0) & (before == 1))
        .drop("_q")
    )


def lead_ceiling(matrix: DataFrame) -> DataFrame:
    """W-11: longest qualified bracket per station and type."""
    best = F.max(F.when(F.col("qualified"), bracket_ordinal(F.col("lead_bracket"))))
    return matrix.groupBy("station_id", "target_type").agg(best.alias("h_star"))


def monotone_decay(matrix: DataFrame, slope: float = -0.05) -> DataFrame:
    """W-14: keys whose skill never rises with lead and falls steeply end to end."""
    by = ["station_id", "target_type"]
    w = Window.partitionBy(*by).orderBy("_o")
    steps = (
        matrix.filter(F.col("bss").isNotNull())
        .withColumn("_o", bracket_ordinal(F.col("lead_bracket")))
        .withColumn("_ok", F.coalesce(F.col("bss") <= F.lag("bss").over(w), F.lit(True)))
    )
    out = steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.bool_and("_ok").alias("monotone"),
        ((F.max_by("bss", "_o") - F.min_by("bss", "_o")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("slope"),
    )
    return out.filter((F.col("n_cells") >= 3) & F.col("monotone") & (F.col("slope") < slope))


def skill_alerts(matrix: DataFrame, weights: DataFrame, p: Params = DEFAULTS, asof: Column | None = None, days: int = 7) -> DataFrame:
    """AGG-23: four degradation patterns as alert rows. With ``asof``, weights count only if their
    ``computed_at`` lies in the ``days`` before it."""
    if asof is not None:
        weights = weights.filter((F.col("computed_at") >= F.date_sub(asof, days)) & (F.col("computed_at") <= asof))
    known = matrix.filter(F.col("bss").isNotNull())
    none_s = F.lit(None).cast("string")
    none_i = F.lit(None).cast("bigint")

    def shape(df, kind, severity, station, bracket, source, metric):
        return df.select(
            F.lit(kind).alias("alert_type"),
            F.lit(severity).alias("severity"),
            station.alias("station_id"),
            bracket.alias("lead_bracket"),
            source.alias("source_id"),
            metric.alias("metric"),
        )

    row = known.groupBy("station_id").agg(F.avg("bss").alias("m"), F.count(F.lit(1)).alias("n"))
    row = row.filter((F.col("n") >= 3) & (F.col("m") < p.skill_exit))
    col = known.groupBy("lead_bracket").agg(F.avg("bss").alias("m"), F.count(F.lit(1)).alias("n"))
    col = col.filter((F.col("n") >= 5) & (F.col("m") < p.skill_exit))
    diagonal = monotone_decay(matrix)
    top = latest_per_key(weights, CELL, [F.col("weight").desc(), F.col("source_id")]).filter(F.col("weight") > 0.60)
    return (
        shape(row, "SKILL_ROW", 0.6, F.col("station_id"), none_s, none_s, F.col("m"))
        .unionByName(shape(col, "SKILL_COLUMN", 0.7, none_i, F.col("lead_bracket"), none_s, F.col("m")))
        .unionByName(shape(diagonal, "SKILL_DIAGONAL", 0.4, F.col("station_id"), none_s, none_s, F.col("slope")))
        .unionByName(shape(top, "WEIGHT_CONVERGENCE", 0.3, F.col("station_id"), F.col("lead_bracket"), F.col("source_id"), F.col("weight")))
    )


def forecast_metrics(df: DataFrame, preds: dict[str, str], actual: str, by: list[str]) -> DataFrame:
    """AGG-25: quality of one or more predictions against the actual; improvements refer to the first."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, col in preds.items():
        e = F.col(col) - F.col(actual)
        aggs += [
            F.avg(F.abs(e)).alias(f"mae_{name}"),
            F.sqrt(F.avg(e * e)).alias(f"rmse_{name}"),
            F.avg(e).alias(f"bias_{name}"),
            *[(F.avg(F.when(F.abs(e) <= k, 1.0).otherwise(0.0)) * 100.0).alias(f"within_{k}_{name}") for k in (1, 2, 3)],
        ]
    out = df.groupBy(*by).agg(*aggs)
    base, *rest = preds
    for name in rest:
        gain = (F.col(f"mae_{base}") - F.col(f"mae_{name}")) / F.nullif(F.col(f"mae_{base}"), F.lit(0.0)) * 100.0
        out = out.withColumn(f"improvement_{name}", gain)
    return out


def bias_diagnostics(df: DataFrame, pred: str, actual: str, date: str, by: list[str]) -> DataFrame:
    """AGG-26: bias by calendar month and by cold / normal / hot tercile of the actual."""
    e = (F.col(pred) - F.col(actual)).alias("e")
    cuts = grouped_percentiles(df, by, actual, {"_c": 0.33, "_h": 0.66})
    a = F.col(actual)
    tercile = F.when(a <= F.col("_c"), "Cold").when(a <= F.col("_h"), "Normal").otherwise("Hot")
    rows = join_keys(df, cuts, by).select(*by, e, F.concat(F.lit("M"), F.lpad(F.month(date).cast("string"), 2, "0")).alias("_m"), tercile.alias("_t"))
    # both groupings from one pass: each row lands once in a month and once in a tercile
    return (
        rows.withColumn("segment", F.explode(F.array("_m", "_t")))
        .groupBy(*by, "segment")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"))
    )


def missingness_bias(df: DataFrame, actual: str, lag: str, by: list[str]) -> DataFrame:
    """AGG-27: are missing lags more frequent on extreme days?"""
    cuts = grouped_percentiles(df.filter(F.col(actual).isNotNull()), by, actual, {"_lo": 0.05, "_hi": 0.95})
    extreme = (F.col(actual) <= F.col("_lo")) | (F.col(actual) >= F.col("_hi"))
    miss = F.when(F.col(lag).isNull(), 1.0).otherwise(0.0)
    return join_keys(df.filter(F.col(actual).isNotNull()), cuts, by).groupBy(*by).agg(
        F.count_if(extreme).alias("n_extreme"),
        F.avg(F.when(extreme, miss)).alias("extreme_rate"),
        F.avg(F.when(~extreme, miss)).alias("normal_rate"),
    ).withColumn("biased", F.col("extreme_rate") > 1.5 * F.col("normal_rate"))


def trial_diagnostics(trials: DataFrame) -> DataFrame:
    """AGG-28: best trial per model, trials per state, and instability of the folds."""
    by = ["station_id", "target_type", "model"]
    done = F.col("state") == "COMPLETE"

    def spread(col: str) -> Column:
        """Range of the folds over their mean; NULL for a single fold or a mean that is not positive."""
        known = F.filter(col, lambda v: v.isNotNull())
        mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
        return F.when((F.size(known) > 1) & (mean > 0), (F.array_max(known) - F.array_min(known)) / mean)

    best = F.max_by(F.struct("trial_id", "value", "fold_rounds", "fold_mae"), F.when(done, F.struct(-F.col("value"), -F.col("trial_id"))))
    return (
        trials.groupBy(*by)
        .agg(best.alias("_b"), F.count(F.lit(1)).alias("n_trials"), F.count_if(done).alias("n_complete"))
        .select(*by, "n_trials", "n_complete", F.col("_b.trial_id").alias("best_trial"), F.col("_b.value").alias("best_value"), F.col("_b.fold_rounds").alias("_r"), F.col("_b.fold_mae").alias("_m"))
        .withColumn("unstable", (F.coalesce(spread("_r"), F.lit(0.0)) > 1.0) | (F.coalesce(spread("_m"), F.lit(0.0)) > 0.4))
        .drop("_r", "_m")
    )


REGRESSION = 1e-9


def summary_comparison(results: DataFrame, by: list[str]) -> DataFrame:
    """AGG-29: roll-up of per-cell holdout results. An improvement below ``-REGRESSION`` percent is a regression;
    less is what rounding leaves of two equal averages."""
    worse = F.abs(F.col("bias_blend")) > F.abs(F.col("bias_raw"))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("improvement").alias("mean_improvement"),
        F.count_if(F.col("improvement") < -REGRESSION).alias("n_regressions"),
        F.count_if((F.col("weight") < 0.05) | (F.col("weight") > 0.95)).alias("n_extreme_blend"),
        F.count_if(worse).alias("n_bias_growth"),
    )


def group_coverage(df: DataFrame, keys: list[str], predicate: Column) -> DataFrame:
    """AGG-31: groups before and after a filter; reduced to one row per group before counting."""
    per_group = df.groupBy(*keys).agg(F.bool_or(predicate).alias("_hit"))
    return per_group.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("_hit").alias("n_surviving"))


def day_completeness(forecasts: DataFrame, scored: DataFrame, date: str = "target_date") -> DataFrame:
    """AGG-21: stations forecast and scored per day, healthy when both are present."""
    f = forecasts.groupBy(date).agg(F.count_distinct("station_id").alias("n_forecast"))
    s = scored.groupBy(date).agg(F.count_distinct("station_id").alias("n_scored"))
    out = f.join(s, date, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0).cast("bigint")))
    return out.withColumn("healthy", (F.col("n_forecast") > 0) & (F.col("n_scored") > 0))


def daily_extremes(obs: DataFrame, min_count: int, by: str = "station_id", date: str = "local_date", temp: str = "temp_f") -> DataFrame:
    """AGG-20: daily high and low of days with enough valid readings."""
    return (
        obs.groupBy(by, date)
        .agg(F.max(temp).alias("t_max_f"), F.min(temp).alias("t_min_f"), F.count(temp).alias("n_valid"))
        .filter(F.col("n_valid") >= min_count)
    )


