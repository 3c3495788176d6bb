"""Settlement, equity and portfolio statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.functions.scalar import in_bin, order_fee
from brierworks.operators.verification import unpivot_targets
from brierworks.params import DEFAULTS, Params


def settle(positions: DataFrame, obs: DataFrame, asof: Column, fee: float = 0.07) -> DataFrame:
    """J-12: settles the live positions that are open, whose day is over and has been observed."""
    live = (F.col("status") == "OPEN") & (F.col("target_date") < asof)
    if "is_paper" in positions.columns:
        live &= ~F.coalesce(F.col("is_paper").cast("boolean"), F.lit(False))
    return grade_positions(positions.filter(live), obs, fee).withColumn("status", F.lit("SETTLED"))


def grade_positions(positions: DataFrame, obs: DataFrame, fee: float = 0.07) -> DataFrame:
    """Outcome and profit in cents of every position whose day has been observed; one join."""
    o = unpivot_targets(obs, ["station_id", "target_date"], "observed_high_f", "observed_low_f", "observed")
    won = in_bin(F.col("observed"), F.col("bin_lower"), F.col("bin_upper"))
    entry, n = F.col("entry_price"), F.col("contracts")
    gross = F.when(won, (1.0 - entry) * n * 100.0).otherwise(-entry * n * 100.0)
    return (
        positions.join(o, ["station_id", "target_date", "target_type"])
        .withColumn("outcome", F.when(won, 1).otherwise(0))
        .withColumn("pnl_gross", gross)
        .withColumn("pnl_net", F.col("pnl_gross") - F.abs("pnl_gross") * fee)
    )


def settlement_stats(positions: DataFrame, asof: Column, by: list[str] | None = None) -> DataFrame:
    """AGG-18: counts by result, cumulative and same-day profit."""
    pnl = F.coalesce("pnl_net", F.lit(0.0))
    return positions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("outcome") == 1).alias("n_won"),
        F.count_if(F.col("outcome") == 0).alias("n_lost"),
        F.count_if(F.col("status") == "OPEN").alias("n_open"),
        F.sum(pnl).alias("cumulative_pnl"),
        F.sum(F.when(F.col("target_date") == asof, pnl).otherwise(0.0)).alias("daily_pnl"),
    )


def daily_pnl(settled: DataFrame, by: list[str], date: str = "target_date") -> DataFrame:
    """One row per key and day: the only form in which equity is ordered."""
    return settled.groupBy(*by, date).agg(
        F.sum(F.coalesce("pnl_net", F.lit(0.0))).alias("daily_pnl"),
        F.count(F.lit(1)).alias("n_bets"),
        F.count_if(F.col("outcome") == 1).alias("n_won"),
    )


def equity_curve(settled: DataFrame, by: list[str], start: float, date: str = "target_date") -> DataFrame:
    """W-09: cumulative profit, drawdown and its all-time and 90-day maximum.

    The daily table is bounded by the calendar, so a single portfolio is a short series too.
    """
    w = Window.partitionBy(*by).orderBy(date)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    days = Window.partitionBy(*by).orderBy(F.unix_date(F.col(date))).rangeBetween(-89, 0)
    value = F.col("portfolio_value")
    peak = F.greatest(F.max(value).over(run), F.lit(start))
    return (
        daily_pnl(settled, by, date)
        .withColumn("cumulative_pnl", F.sum("daily_pnl").over(run))
        .withColumn("win_rate", F.col("n_won") / F.col("n_bets"))
        .withColumn("portfolio_value", F.col("cumulative_pnl") + F.lit(start))
        .withColumn("drawdown", (peak - value) / peak)
        .withColumn("mdd_all", F.max("drawdown").over(run))
        .withColumn("mdd_90", F.max("drawdown").over(days))
    )


def portfolio_metrics(settled: DataFrame, by: list[str], fee_rate: float = DEFAULTS.taker_rate, date: str = "target_date") -> DataFrame:
    """AGG-17: per key: hit rate, Sharpe over betting days, fee drag, edge utilisation, win counts.

    ``settled`` may carry ``offered`` (contracts that passed the edge gate) for the utilisation.
    """
    pnl = F.col("pnl_net")
    fee = order_fee(F.col("entry_price"), F.col("contracts"), fee_rate)
    offered = F.col("offered") if "offered" in settled.columns else F.col("contracts")
    day = settled.groupBy(*by, date).agg(
        F.sum(pnl).alias("_p"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(pnl > 0).alias("_w"),
        F.sum(F.greatest(F.col("pnl_gross"), F.lit(0.0))).alias("_g"),
        F.sum(fee).alias("_f"),
        F.sum("contracts").alias("_c"),
        F.sum(offered).alias("_o"),
    )
    out = day.groupBy(*by).agg(
        F.sum("_n").alias("n_bets"),
        F.sum("_w").alias("n_won"),
        F.sum("_p").alias("net_profit"),
        F.sum("_g").alias("gross_profit"),
        F.sum("_f").alias("total_fees"),
        (F.sum("_w") / F.sum("_n")).alias("hit_rate"),
        (F.avg("_p") / F.nullif(F.stddev_samp("_p"), F.lit(0.0))).alias("sharpe"),
        (F.sum("_c") / F.nullif(F.sum("_o").cast("double"), F.lit(0.0))).alias("edge_utilisation"),
    )
    return out.withColumn("n_lost", F.col("n_bets") - F.col("n_won")).withColumn(
        "fee_drag", F.col("total_fees") / F.nullif(F.col("gross_profit"), F.lit(0.0))
    )


def rolling_sharpe(settled: DataFrame, by: list[str], n: int = 30, date: str = "target_date") -> DataFrame:
    """AGG-17: Sharpe of the last ``n`` betting days."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(-(n - 1), 0)
    d = daily_pnl(settled, by, date)
    value = F.avg("daily_pnl").over(w) / F.nullif(F.stddev_samp("daily_pnl").over(w), F.lit(0.0))
    return d.select(*by, date, "daily_pnl", value.alias("sharpe_30"))


def adverse_selection(settled: DataFrame, asof: Column, days: int, by: list[str] | None = None, date: str = "target_date") -> DataFrame:
    """AGG-15: are resting fills worse than crossing ones? Dollars per contract by order type, over
    positions that were filled or settled."""
    recent = settled.filter(F.col("status").isin("FILLED", "SETTLED") & (F.col(date) >= F.date_sub(asof, days)) & (F.col(date) <= asof))
    quality = F.col("pnl_net") / (F.col("contracts") * 100.0)
    maker = F.avg(F.when(F.col("order_type") == "MAKER", quality))
    taker = F.avg(F.when(F.col("order_type") == "TAKER", quality))
    out = recent.groupBy(*(by or [])).agg(
        F.count_if(F.col("order_type") == "MAKER").alias("n_maker"),
        F.count_if(F.col("order_type") == "TAKER").alias("n_taker"),
        maker.alias("maker_quality"),
        taker.alias("taker_quality"),
    )
    delta = F.col("maker_quality") - F.col("taker_quality")
    level = F.when(delta < -0.05, "CRITICAL").when(delta < -0.02, "WARNING").otherwise("OK")
    return out.withColumn("delta", delta).withColumn("level", level)
