"""Daily series: gaps, lags, fills, rolling statistics and chronological splits.

A series has one row per key and calendar day, so a key's length is bounded by its date range and
plain windows are balanced over keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.params import DEFAULTS, Params


def densify_daily(df: DataFrame, by: list[str], date: str = "target_date") -> DataFrame:
    """Insert the missing calendar days of every key."""
    span = df.groupBy(*by).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = span.select(*by, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    return days.join(df, [*by, date], "left")


def calendar_lags(df: DataFrame, by: list[str], date: str, col: str, lags: list[int], dense: bool = False) -> DataFrame:
    """W-03: lags that mean days, not rows."""
    base = df if dense else densify_daily(df, by, date)
    w = Window.partitionBy(*by).orderBy(date)
    return base.select("*", *[F.lag(col, k).over(w).alias(f"{col}_lag{k}") for k in lags])


def ffill(col: Column, by: list[str], order: str, limit: int) -> Column:
    """W-04: carry the last value over at most ``limit`` gaps."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-limit, 0)
    return F.last(col, ignorenulls=True).over(w)


def rolling_stats(by: list[str], order: str, col: Column, specs: dict[str, tuple[str, int, int]]) -> list[Column]:
    """W-05: ``name -> (mean|std, width, minimum count)`` as columns over row frames."""
    out = []
    for name, (kind, width, least) in specs.items():
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width - 1), 0)
        stat = F.avg(col).over(w) if kind == "mean" else F.stddev_samp(col).over(w)
        out.append(F.when(F.count(col).over(w) >= least, stat).alias(name))
    return out


def last_n(by: list[str], order: str, col: Column, n: int) -> Column:
    """W-20: the last ``n`` values up to and with the current row, oldest first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.collect_list(col).over(w)


def adaptive_span(xs: Column, p: Params = DEFAULTS) -> Column:
    """Span of the weighted variance from how volatile the recent values are."""
    n = F.size(xs)
    recent = F.slice(xs, F.greatest(F.lit(1), n - p.ewm_span_volatile + 1), p.ewm_span_volatile)
    ratio = _var(recent) / F.when(_var(xs) > 0, _var(xs))
    t = F.least(ratio / p.ewm_vol_threshold, F.lit(1.0))
    gap = p.ewm_span_stable - p.ewm_span_volatile
    return (
        F.when(n < p.ewm_span_volatile, p.ewm_span_stable)
        .when(ratio.isNull(), p.ewm_span_stable)
        .when(ratio > p.ewm_vol_threshold, p.ewm_span_volatile)
        .otherwise(F.floor(p.ewm_span_stable - t * gap))
    )


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _var(xs: Column) -> Column:
    n = F.size(xs)
    total = F.aggregate(
        xs,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
    )
    mean = total["s"] / n
    return F.greatest(total["q"] / n - mean * mean, F.lit(0.0))


def ewm_variance_of(xs: Column, span: Column | None = None, p: Params = DEFAULTS) -> Column:
    """W-17 on an ordered array of bounded length: exponentially weighted variance, floored."""
    span = adaptive_span(xs, p) if span is None else span
    alpha = 2.0 / (span + 1.0)
    # the smoothing factor rides along in the state so it is computed once per row
    init = F.struct(xs[0].alias("m"), F.lit(0.0).alias("v"), alpha.alias("a"))

    def step(s: Column, x: Column) -> Column:
        d = x - s["m"]
        return F.struct(
            (s["m"] + s["a"] * d).alias("m"),
            ((1.0 - s["a"]) * (s["v"] + s["a"] * d * d)).alias("v"),
            s["a"].alias("a"),
        )

    tail = F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0)))
    folded = F.aggregate(tail, init, step)["v"]
    return F.when(F.size(xs) < 2, 0.01).otherwise(F.greatest(folded, F.lit(1e-6)))


def ewm_variance(df: DataFrame, by: list[str], order: str, col: str, window: int = 30, p: Params = DEFAULTS) -> DataFrame:
    """W-17 as a job: the variance at every row over its last ``window`` values."""
    with_list = df.select("*", last_n(by, order, F.col(col), window).alias("_xs"))
    return with_list.withColumn("ewm_var", ewm_variance_of(F.col("_xs"), None, p)).drop("_xs")


def chrono_split(df: DataFrame, by: list[str], order: str, fractions: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """W-18: train / validation / test by position in time, per key."""
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    a, b = F.floor(n * F.lit(fractions[0])), F.floor(n * F.lit(fractions[1]))
    return df.withColumn("split", F.when(pos < a, "train").when(pos < b, "val").otherwise("test"))


def walk_forward_blocks(df: DataFrame, by: list[str], order: str, test_days: int = 45, folds: int = 6) -> DataFrame:
    """W-18: fold number of the trailing test blocks; 0 marks rows used for training only."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    back = n - F.row_number().over(Window.partitionBy(*by).orderBy(order))
    fold = folds - F.floor(back / test_days)
    return df.withColumn("fold", F.when(fold >= 1, fold).otherwise(0).cast("int"))


def walk_forward_folds(
    df: DataFrame, by: list[str], date: str = "target_date", train: int = 60, test: int = 30, folds: int = 3
) -> DataFrame:
    """W-19: consecutive train+test periods from each key's first day; fewer when the data are short.
    Rows past the last full fold are dropped from evaluation by a NULL fold."""
    span = df.groupBy(*by).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    period = train + test
    fit = F.greatest(F.lit(1), F.least(F.lit(folds), F.floor(F.datediff("_b", "_a") / period)))
    day = F.datediff(date, "_a")
    k = F.floor(day / period)
    whole = F.date_add("_a", (k * period + (period - 1)).cast("int")) <= F.col("_b")
    return (
        df.join(span, by)
        .withColumn("fold", F.when((k < fit) & whole, k + 1).cast("int"))
        .withColumn("role", F.when(F.col("fold").isNotNull(), F.when(F.pmod(day, F.lit(period)) < train, "train").otherwise("test")))
        .drop("_a", "_b")
    )


def expanding_folds(
    df: DataFrame, by: list[str], date: str = "target_date", first: int = 90, test: int = 30, step: int = 30
) -> DataFrame:
    """W-19, expanding form: fold k trains on everything before its test block. A row belongs to at
    most one test block; its training folds are all later ones, so no row is copied."""
    span = df.groupBy(*by).agg(F.min(date).alias("_a"))
    past = F.datediff(date, "_a") - first
    k = F.floor(past / step)
    inside = (past >= 0) & (past - k * step < test)
    return df.join(span, by).withColumn("test_fold", F.when(inside, k + 1).cast("int")).drop("_a")
