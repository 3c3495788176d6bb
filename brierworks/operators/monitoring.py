"""Health and risk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brierworks.operators.ordering import first_by
from brierworks.params import DEFAULTS, Params


def drawdown_status(metrics: DataFrame, date: str = "metric_date", p: Params = DEFAULTS) -> DataFrame:
    """MON-01: OK / WARNING / HALT from the newest metric row."""
    last = first_by(metrics, [F.col(date).desc()])
    m = F.coalesce("mdd_all", F.lit(0.0))
    return last.withColumn("status", F.when(m >= p.mdd_halt, "HALT").when(m >= p.mdd_safe, "WARNING").otherwise("OK"))


def risk_off(daily: DataFrame, date: str = "metric_date", p: Params = DEFAULTS) -> DataFrame:
    """MON-02: the off switch over time: reasons per day and the days on which it flips.

    ``daily`` has one row per day: mdd_all, bankroll, healthy_days (counted so far).
    """
    reasons = F.concat_ws(
        " | ",
        F.when(F.col("mdd_all") >= p.mdd_halt, F.lit("drawdown")),
        F.when(F.col("bankroll") <= p.min_bankroll, F.lit("bankroll")),
        F.when(F.col("healthy_days") < p.warmup_days, F.lit("warmup")),
    )
    out = daily.withColumn("reason", F.when(reasons == "", "NOMINAL").otherwise(reasons))
    out = out.withColumn("offline", F.col("reason") != "NOMINAL")
    # one row per calendar day: a bounded series
    before = F.lag("offline", 1, False).over(Window.orderBy(date))
    change = F.when(F.col("offline") & ~before, "SYSTEM_OFFLINE").when(~F.col("offline") & before, "SYSTEM_RECOVERY")
    return out.withColumn("alert_type", change)


def build_alerts(df: DataFrame, details: list[str], open_alerts: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """MON-03: alert rows with JSON details, minus those already open for the same key."""
    alerts = df.withColumn("details", F.to_json(F.struct(*details)))
    if open_alerts is not None:
        alerts = alerts.join(open_alerts.select(*keys), keys, "left_anti")
    return alerts


def open_alerts(alerts: DataFrame, n: int = 20, min_severity: float = 0.7) -> DataFrame:
    """TOP-04: the newest unresolved severe alerts."""
    live = alerts.filter(~F.col("is_resolved") & (F.col("severity") >= min_severity))
    return live.orderBy(F.col("alert_ts").desc(), F.col("alert_id").desc()).limit(n)


def collection_status(counts: DataFrame, by: list[str]) -> DataFrame:
    """MON-04: ERROR without any good row, PARTIAL from a failure rate of one half, else OK."""
    total = F.col("n_good") + F.col("n_bad")
    rate = F.col("n_bad") / F.nullif(total.cast("double"), F.lit(0.0))
    status = F.when(F.col("n_good") == 0, "ERROR").when(rate >= 0.5, "PARTIAL").otherwise("OK")
    return counts.withColumn("failure_rate", rate).withColumn("status", status)


def health_report(*checks: tuple[str, DataFrame, int, bool]) -> DataFrame:
    """MON-05: (name, rows found, limit, whether it decides) checks as one table with an overall verdict:
    all deciding checks stay below their limit. The others only report."""
    rows = None
    for name, found, limit, decides in checks:
        row = found.agg(F.count(F.lit(1)).alias("n_found")).select(
            F.lit(name).alias("check"), "n_found", (F.col("n_found") < limit).alias("ok"), F.lit(decides).alias("decides")
        )
        rows = row if rows is None else rows.unionByName(row)
    verdict = rows.agg(F.bool_and(F.col("ok") | ~F.col("decides")))
    return rows.withColumn("healthy", verdict.scalar()).drop("decides")
