"""Forecast bias tracking: an ordered scalar filter per key.

The filter is sequential in time, parallel over keys. Its input is reduced to one error per key and
calendar day first, so a key's array is bounded by its date range. Noise terms that do not depend on
the filter state are computed beforehand with windows; only the recursion itself is folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.functions.scalar import measurement_noise
from brierworks.operators.joins import asof_join
from brierworks.operators.series import ewm_variance_of
from brierworks.params import DEFAULTS, Params

BLOCK_DAYS = 64
HISTORY = ["b_k", "u_k", "q_k", "r_k", "k_k", "epsilon", "state_version"]


def daily_errors(errors: DataFrame, by: list[str], date: str = "target_date", innovation: str = "obs_minus_fcst") -> DataFrame:
    """One innovation per key and day: the mean over the sources in the key, signed as asked.

    ``obs_minus_fcst`` fits a bias that is added to the forecast; ``fcst_minus_obs`` is the raw error.
    """
    sign = -1.0 if innovation == "obs_minus_fcst" else 1.0
    return errors.groupBy(*by, date).agg((sign * F.avg("error_raw")).alias("epsilon"))


def with_measurement_noise(series: DataFrame, states: DataFrame, by: list[str], date: str = "target_date", p: Params = DEFAULTS) -> DataFrame:
    """KAL-01 for the filter: r_k of each day from that day's ensemble state (f_top, f_bar, s_unweighted);
    the default where there is none."""
    r = measurement_noise(F.col("f_top"), F.col("f_bar"), F.col("s_unweighted"), p)
    day = states.select(*by, date, r.alias("_r"))
    return series.join(day, [*by, date], "left").withColumn("r_k", F.coalesce("_r", F.lit(p.r_default))).drop("_r")


def with_noise(series: DataFrame, by: list[str], date: str = "target_date", window_days: int = 30, p: Params = DEFAULTS) -> DataFrame:
    """KAL-02, state-free part: last five innovations, base process noise known before the day (``q_next``: after it),
    measurement noise and the gap to the previous observed day."""
    day = F.unix_date(F.col(date))
    w = Window.partitionBy(*by).orderBy("_day")
    recent = F.collect_list("epsilon").over(w.rangeBetween(-window_days, 0))
    steps = F.zip_with(
        F.slice(F.col("_xs"), 2, F.greatest(F.size("_xs") - 1, F.lit(0))),
        F.slice(F.col("_xs"), 1, F.greatest(F.size("_xs") - 1, F.lit(0))),
        lambda a, b: a - b,
    )
    q_after = F.when(F.size("_xs") >= 2, ewm_variance_of(steps, None, p))
    carried = F.last(F.col("_q"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = (
        series.withColumn("_day", day)
        .withColumn("_xs", recent)
        .withColumn("_q", q_after)
        .withColumn("q_base", F.coalesce(carried, F.lit(0.0)))
        .withColumn("q_next", F.coalesce("_q", "q_base"))
        .withColumn("last5", F.slice("_xs", F.greatest(F.size("_xs") - 4, F.lit(1)), 5))
        .withColumn("gap_days", F.coalesce(F.greatest(F.col("_day") - F.lag("_day").over(w) - 1, F.lit(0)), F.lit(0)))
    )
    if "r_k" not in series.columns:
        out = out.withColumn("r_k", F.lit(p.r_default))
    return out.drop("_day", "_xs", "_q")


def process_noise(q_base: Column, last5: Column, b_prev: Column, p: Params = DEFAULTS) -> Column:
    """KAL-02: base noise plus a penalty on recent residuals, heavier for negative ones."""

    def penalty(acc: Column, x: Column) -> Column:
        d = x - b_prev
        return acc + d * d * F.when(d < 0, p.lambda_asym).otherwise(1.0)

    return q_base + p.gamma * F.aggregate(last5, F.lit(0.0), penalty)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def _state(day: Column, b: Column, u: Column, q: Column, r: Column, k: Column, e: Column, v: Column) -> Column:
    return F.struct(
        day.alias("target_date"), b.alias("b_k"), u.alias("u_k"), q.alias("q_k"), r.alias("r_k"),
        k.alias("k_k"), e.alias("epsilon"), v.alias("state_version"),
    )


def _next(state: Column, x: Column, p: Params) -> Column:
    """The state after one day."""

    def given_state(s: Column) -> Column:
        q = process_noise(x["q_base"], x["last5"], s["b_k"], p)
        prior = lambda q_: s["u_k"] + q_ * (1.0 + p.gap_inflate * x["gap_days"])
        gain = lambda u_: F.when(u_ + x["r_k"] == 0, 0.5).otherwise(u_ / (u_ + x["r_k"]))
        noise = F.struct(q.alias("q"))
        with_prior = lambda n: _let(F.struct(n["q"].alias("q"), prior(n["q"]).alias("u")), with_gain)
        with_gain = lambda n: _let(F.struct(n["q"].alias("q"), n["u"].alias("u"), gain(n["u"]).alias("k")), finish)
        finish = lambda n: _state(
            x["target_date"], s["b_k"] + n["k"] * (x["epsilon"] - s["b_k"]), (1.0 - n["k"]) * n["u"], n["q"], x["r_k"],
            n["k"], x["epsilon"], s["state_version"] + 1,
        )
        return _let(noise, with_prior)

    return _let(state, given_state)


def _handed_on(blocks: Column, first: Column, p: Params) -> Column:
    """The state at the start of each block. Only states are carried, one per block is kept."""
    last = lambda s, block: F.aggregate(block, s, lambda t, x: _next(t, x, p))
    return F.aggregate(F.slice(blocks, 1, F.size(blocks) - 1), F.array(first), lambda acc, block: F.concat(acc, F.array(last(F.element_at(acc, -1), block))))


def _block_history(block: Column, start: Column, p: Params) -> Column:
    """The states after each day of a block."""
    grow = lambda acc, x: F.concat(acc, F.array(_next(F.element_at(acc, -1), x, p)))
    return F.slice(F.aggregate(block, F.array(start), grow), 2, F.size(block))


def run_filter(prepared: DataFrame, by: list[str], date: str = "target_date", init: DataFrame | None = None, p: Params = DEFAULTS, block_days: int = BLOCK_DAYS) -> DataFrame:
    """KAL-03: fold prepared days into a history, optionally from given states per key.

    A key's days are cut into blocks of ``block_days``. A first fold hands the state from block to block and keeps nothing
    else; then every block, a row of its own, is folded again from its start and yields its days. So the work is linear in
    the days (a series of one block is folded once), and no array of a whole history is built.
    """
    step = F.struct(F.col(date).alias("target_date"), "epsilon", "r_k", "q_base", "last5", "gap_days")
    keyed = prepared.groupBy(*by).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    if init is None:
        b0, u0, v0 = F.lit(p.b_init), F.lit(p.u_init), F.lit(0)
    else:
        keyed = keyed.join(init.select(*by, F.col("b_k").alias("_b"), F.col("u_k").alias("_u"), F.col("state_version").alias("_v")), by, "left")
        b0, u0, v0 = F.coalesce("_b", F.lit(p.b_init)), F.coalesce("_u", F.lit(p.u_init)), F.coalesce("_v", F.lit(0))
    zero = F.lit(0.0)
    first = _state(F.lit(None).cast("date"), b0, u0, zero, zero, zero, zero, v0.cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_steps") - 1) / block_days).cast("int")), lambda i: F.slice("_steps", i * block_days + 1, block_days))
    blocks = keyed.select(*by, cut.alias("_blocks"), first.alias("_first"))
    starts = blocks.select(*by, F.explode(F.arrays_zip(F.col("_blocks").alias("days"), _handed_on(F.col("_blocks"), F.col("_first"), p).alias("start"))).alias("_b"))
    rows = starts.select(*by, F.explode(_block_history(F.col("_b.days"), F.col("_b.start"), p)).alias("h"))
    return rows.select(*by, F.col("h.target_date").alias(date), *[F.col(f"h.{c}").alias(c) for c in HISTORY])


def kalman_filter(series: DataFrame, by: list[str], date: str = "target_date", p: Params = DEFAULTS) -> DataFrame:
    """KAL-03: history of the filter over a daily innovation series."""
    return run_filter(with_noise(series, by, date, p=p), by, date, None, p)


def final_state(history: DataFrame, by: list[str], date: str = "target_date") -> DataFrame:
    """Latest state per key."""
    cols = [date, *HISTORY]
    best = history.groupBy(*by).agg(F.max_by(F.struct(*cols), F.col(date)).alias("_s"))
    return best.select(*by, *[F.col(f"_s.{c}").alias(c) for c in cols])


def kalman_replay(
    history: DataFrame, series: DataFrame, amendments: DataFrame, by: list[str], date: str = "target_date", p: Params = DEFAULTS
) -> DataFrame:
    """KAL-04: recompute from each amended key's first amended day; other rows stay as they are.

    ``series`` is the corrected innovation series, ``amendments`` has the key and amended days.
    """
    first = amendments.groupBy(*by).agg(F.min(date).alias("_from"))
    touched = series.join(first.select(*by), by, "left_semi")
    # noise looks back over untouched days too, so it is prepared before the cut
    suffix = with_noise(touched, by, date, p=p).join(first, by).filter(F.col(date) >= F.col("_from")).drop("_from")
    marked = history.join(first, by, "left")
    before = marked.filter(F.col("_from").isNull() | (F.col(date) < F.col("_from"))).drop("_from")
    seeds = final_state(before.join(first.select(*by), by, "left_semi"), by, date)
    redone = run_filter(suffix, by, date, seeds, p).withColumn("is_amendment", F.lit(True))
    return before.withColumn("is_amendment", F.lit(False)).unionByName(redone)


def apply_bias(fc: DataFrame, history: DataFrame, by: list[str], date: str = "target_date", f: str = "f_raw") -> DataFrame:
    """PRJ-20: forecast plus the last bias known strictly before the day. Both sides have a bounded
    number of rows per key and day (sources, and one state), so the key's series is bounded too."""
    states = history.select(*by, F.col(date).alias("_bias_date"), "b_k")
    out = asof_join(fc, states, by, date, "_bias_date", ["b_k"], bounded=True)
    return out.withColumn("b_k", F.coalesce("b_k", F.lit(0.0))).withColumn("f_adjusted", F.col(f) + F.col("b_k"))
