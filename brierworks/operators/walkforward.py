"""Walk-forward evaluation and parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from brierworks.functions.scalar import bic, in_bin
from brierworks.operators.joins import sweep
from brierworks.operators.series import walk_forward_folds


def daily_scores(graded: DataFrame, by: list[str], date: str = "target_date") -> DataFrame:
    """One row per key and day: mean score over the ladder and the growth of the favourite's bet.

    The bet assumes a price 10 % below the model's probability, at most a tenth of the bankroll and a
    7 % fee on winnings; a day's result is then a multiple of the bankroll.
    """
    fav = F.max_by(
        F.struct("p_win", "outcome"), F.struct(F.col("p_win"), -F.coalesce(F.col("bin_lower"), F.lit(-1e18)))
    )
    day = graded.groupBy(*by, date).agg(F.avg("brier").alias("brier"), fav.alias("_f"))
    p = F.col("_f.p_win")
    price = 0.9 * p
    stake = F.least(F.when(price < 1.0, (p - price) / (1.0 - price)).otherwise(0.0), F.lit(0.10))
    won = F.col("_f.outcome") == 1
    rate = F.when(won, (1.0 - price) / price * stake * 0.93).otherwise(-stake)
    return day.select(*by, date, "brier", won.alias("won"), rate.alias("rate"))


def walk_forward(
    graded: DataFrame, by: list[str], date: str = "target_date", train: int = 60, test: int = 30, folds: int = 3,
    bankroll: float = 1000.0, cents: bool = False,
) -> DataFrame:
    """KAL-06: score, skill and compounded profit per test fold.

    A bet is a share of the bankroll, so the final value is a product and order does not matter.
    ``cents`` rounds every day's result to cents, which does depend on order: the days of one fold
    (at most ``test``) are then folded in date order.
    """
    days = walk_forward_folds(daily_scores(graded, by, date), by, date, train, test, folds)
    tested = days.filter(F.col("role") == "test")
    aggs = [
        F.count(F.lit(1)).alias("n_days"),
        F.avg("brier").alias("mean_brier"),
        F.avg(F.col("won").cast("double")).alias("win_rate"),
        (bankroll * F.exp(F.sum(F.log1p("rate")))).alias("_final"),
    ]
    if cents:
        aggs.append(F.array_sort(F.collect_list(F.struct(date, "rate"))).alias("_days"))
    out = tested.groupBy(*by, "fold").agg(*aggs)
    final = F.col("_final")
    if cents:
        final = F.aggregate("_days", F.lit(bankroll), lambda b, d: b + F.bround(b * d["rate"], 2))
    return (
        out.withColumn("bss", 1.0 - F.col("mean_brier") / 0.25)
        .withColumn("final_bankroll", final)
        .withColumn("pnl", F.col("final_bankroll") - bankroll)
        .drop("_final", "_days")
    )


def acceptance(folds: DataFrame, by: list[str]) -> DataFrame:
    """KAL-06: averages over folds and the pass/fail verdict."""
    out = folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("bss").alias("avg_bss"),
        F.avg("mean_brier").alias("avg_brier"),
        F.sum("pnl").alias("total_pnl"),
    )
    ok = (F.col("avg_bss") >= 0.05) & (F.col("avg_brier") <= 0.22) & (F.col("total_pnl") >= 0)
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


# The factors that a grid spans, and the candidates where the current value gives no span.
SPAN = (0.5, 2.0)
NEAR_ZERO, SMALL_COUNTS = (0.0, 0.01, 0.05, 0.1, 0.5), (1.0, 2.0, 3.0, 4.0, 5.0)


def grid_around(current: float, whole: bool = False, n: int = 5) -> list[float]:
    """KAL-07: ``n`` evenly spaced candidates over ``SPAN`` times the current value. Whole-number
    parameters have whole ends and a whole step, at least one."""
    if whole and current <= 2:
        return list(SMALL_COUNTS)
    if current == 0:
        return list(NEAR_ZERO)
    ends = np.array(SPAN) * current
    if not whole:
        return np.linspace(*ends, n).round(6).tolist()
    first, last = np.maximum(np.floor(ends), 1.0)
    step = max(1.0, (last - first) // (n - 1))
    return (first + step * np.arange(n)).tolist()


MetricBuilder = Callable[[Column], Column]  # UDF-01: parameter column -> per-row loss column


def param_sweep(df: DataFrame, by: list[str], current: float, metric: MetricBuilder, grid: list[float] | None = None) -> DataFrame:
    """KAL-07: evaluate a loss over a parameter grid; change the parameter only if its BIC falls.

    The grid sits inside each row, so one scan serves all candidates and the shuffle carries one row
    per key and candidate.
    """
    grid = grid or grid_around(current)
    values = sorted({*grid, float(current)})
    sums = sweep(df.withColumn("_one", F.lit(1)), by, values, metric, "candidate")
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    scored = sums.join(n, by).withColumn("bic", bic(F.col("n"), F.greatest(F.col("objective") / F.col("n"), F.lit(1e-9)), 1))
    now = F.col("candidate") == F.lit(float(current))
    out = scored.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.min_by("candidate", F.struct("bic", "candidate")).alias("best_value"),
        F.min("bic").alias("best_bic"),
        F.max(F.when(now, F.col("bic"))).alias("current_bic"),
        F.max(F.when(now, F.col("objective") / F.col("n"))).alias("current_metric"),
        F.min(F.col("objective") / F.col("n")).alias("best_metric"),
    )
    better = (F.col("best_value") != F.lit(float(current))) & (F.col("best_bic") < F.col("current_bic"))
    return out.withColumn("accepted", better).withColumn("new_value", F.when(better, F.col("best_value")).otherwise(F.lit(float(current))))


def grade_bins(preds: DataFrame, values: DataFrame, on: list[str], value: str) -> DataFrame:
    """Outcome and score of ladders against one observed value per group."""
    hit = F.when(in_bin(F.col(value), F.col("bin_lower"), F.col("bin_upper")), 1).otherwise(0)
    out = preds.join(values, on).withColumn("outcome", hit)
    return out.withColumn("brier", (F.col("p_win") - F.col("outcome")) * (F.col("p_win") - F.col("outcome")))
