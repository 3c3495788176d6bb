"""Outcome-bin ladders and their probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.functions.normal import norm_cdf, skew_params, with_skew_cdf
from brierworks.operators.verification import GROUP
from brierworks.params import DEFAULTS, Params


def bin_ladder(df: DataFrame, mu: str = "mu", width: float = 2.0, n: int = 15, city: str | None = None, prefix: str = "KX") -> DataFrame:
    """PRJ-13: ``n`` half-degree-edged bins around the rounded mean, open at both ends, with tickers."""
    half = (n - 2) // 2
    centre = F.bround(F.col(mu) / width) * width
    i = F.col("bin_index")
    lo = F.col("_c") + i * width - 0.5
    day = F.upper(F.date_format("target_date", "yyMMMdd"))
    town = F.col(city) if city else F.col("station_id").cast("string")
    head = F.concat(F.lit(prefix), F.col("target_type"), town, F.lit("-"), day, F.lit("-"))
    first, last = -half - 1, half + 1
    as_text = lambda v: v.cast("bigint").cast("string")
    out = df.withColumn("_c", centre).withColumn("bin_index", F.explode(F.sequence(F.lit(first), F.lit(last))))
    label = (
        F.when(i == first, F.concat(F.lit("T"), as_text(lo + width + 0.5), F.lit("BELOW")))
        .when(i == last, F.concat(F.lit("T"), as_text(lo - 0.5), F.lit("ABOVE")))
        .otherwise(F.concat(F.lit("B"), as_text(lo + 0.5)))
    )
    return (
        out.withColumn("bin_lower", F.when(i > first, lo))
        .withColumn("bin_upper", F.when(i < last, lo + width))
        .withColumn("ticker", F.concat(head, label))
        .drop("_c")
    )


def skewnormal_params(df: DataFrame, mu: str = "mu", sigma: str = "sigma_eff", g1: str = "g1", p: Params = DEFAULTS) -> DataFrame:
    """DST-01 on a table of distributions."""
    cols = skew_params(F.col(mu), F.col(sigma), F.col(g1), p)
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def _mass(df: DataFrame, lower_cdf: str, upper_cdf: str, p: Params) -> Column:
    """Probability between two CDF values with NULL for open edges, floored."""
    lo = F.coalesce(F.col(lower_cdf), F.lit(0.0))
    hi = F.coalesce(F.col(upper_cdf), F.lit(1.0))
    return F.greatest(hi - lo, F.lit(p.p_floor))


def _edge_cdfs(df: DataFrame, by: list[str], cdf) -> DataFrame:
    """CDF at both edges of each bin. Where bins touch, the lower value is the neighbour's upper one;
    the CDF of a NULL is skipped, so each distinct edge is evaluated once."""
    w = Window.partitionBy(*by).orderBy(F.col("bin_lower").asc_nulls_first())
    up = cdf(df, "bin_upper", "_hi")
    touch = F.lag("bin_upper").over(w) == F.col("bin_lower")
    linked = up.withColumn("_prev", F.when(touch, F.lag("_hi").over(w))).withColumn(
        "_own", F.when(F.col("_prev").isNull(), F.col("bin_lower"))
    )
    return cdf(linked, "_own", "_low").withColumn("_lo", F.coalesce("_prev", "_low")).drop("_prev", "_own", "_low")


def _skew_cdf(df: DataFrame, edge: str, name: str) -> DataFrame:
    z = df.withColumn("_z", (F.col(edge) - F.col("xi")) / F.col("omega"))
    return with_skew_cdf(z, "_z", "alpha", name).drop("_z")


def price_bins(df: DataFrame, by: list[str] = GROUP, p: Params = DEFAULTS) -> DataFrame:
    """DST-02: skew-normal probability of every bin (columns xi, omega, alpha, bin_lower, bin_upper)."""
    out = _edge_cdfs(df, by, _skew_cdf)
    return out.withColumn("p_win", _mass(out, "_lo", "_hi", p)).drop("_lo", "_hi")


def _mixture_cdf(df: DataFrame, edge: str, name: str) -> DataFrame:
    s = F.greatest(F.col("sigma_eff"), F.lit(0.01))
    z = df.withColumn("_z1", (F.col(edge) - F.col("mu1")) / s).withColumn("_z2", (F.col(edge) - F.col("mu2")) / s)
    return z.withColumn(name, F.col("w1") * norm_cdf("_z1") + (1.0 - F.col("w1")) * norm_cdf("_z2")).drop("_z1", "_z2")


def price_bins_mixture(df: DataFrame, by: list[str] = GROUP, p: Params = DEFAULTS) -> DataFrame:
    """DST-03: two normals with one sigma (columns mu1, mu2, w1, sigma_eff and the bin edges)."""
    out = _edge_cdfs(df, by, _mixture_cdf)
    return out.withColumn("p_win", _mass(out, "_lo", "_hi", p)).drop("_lo", "_hi")


def normalize_probs(df: DataFrame, by: list[str] = GROUP, col: str = "p_win", p: Params = DEFAULTS) -> DataFrame:
    """W-06: scale a ladder to sum 1, floor, scale again; flag ladders that were far off."""
    w = Window.partitionBy(*by)
    total, n = F.sum(col).over(w), F.count(F.lit(1)).over(w)
    first = df.withColumn("_t", total).withColumn("_n", n)
    scaled = F.when(F.abs(F.col("_t") - 1.0) > p.norm_tolerance, F.col(col) / F.col("_t")).otherwise(F.col(col))
    dead = F.col("_t") <= 0
    floored = first.withColumn("_p", F.when(~dead, F.greatest(scaled, F.lit(p.p_floor)))).withColumn("_t2", F.sum("_p").over(w))
    again = F.when(F.abs(F.col("_t2") - 1.0) > p.norm_tolerance, F.col("_p") / F.col("_t2")).otherwise(F.col("_p"))
    return (
        floored.withColumn(col, F.when(dead, 1.0 / F.col("_n")).otherwise(again))
        .withColumn("norm_warning", F.abs(F.col("_t") - 1.0) > p.norm_warn)
        .drop("_t", "_n", "_p", "_t2")
    )


def fresh_extremes(extremes: DataFrame, asof: Column, p: Params = DEFAULTS) -> DataFrame:
    """Observed extremes whose last reading is recent enough to act on."""
    return extremes.filter(F.col("last_obs_at") >= asof - F.expr(f"interval {p.reading_stale_minutes} minutes"))


def truncate_probs(df: DataFrame, extremes: DataFrame, mode: str = "zero", by: list[str] = GROUP, p: Params = DEFAULTS) -> DataFrame:
    """DST-04: use what has been observed today.

    ``zero`` removes impossible bins and rescales; ``conditional`` re-integrates the distribution
    beyond the observed extreme (needs xi, omega, alpha). ``extremes`` holds station_id, target_date,
    t_max_f and t_min_f of fresh readings. A lead_hours column, where present, limits it to late hours.
    """
    joined = df.join(extremes.select("station_id", "target_date", "t_max_f", "t_min_f"), ["station_id", "target_date"], "left")
    high = F.col("target_type") == "HIGH"
    seen = F.when(high, F.col("t_max_f")).otherwise(F.col("t_min_f"))
    if "lead_hours" in df.columns:
        seen = F.when(F.col("lead_hours") <= p.truncation_lead_hours, seen)
    joined = joined.withColumn("_seen", seen)
    gone = F.when(high, F.col("bin_upper") <= F.col("_seen")).otherwise(F.col("bin_lower") >= F.col("_seen"))
    w = Window.partitionBy(*by)
    if mode == "zero":
        out = joined.withColumn("truncated", F.coalesce(gone, F.lit(False)))
        out = out.withColumn("_p", F.when(F.col("truncated"), 0.0).otherwise(F.col("p_win")))
    else:
        edge = joined.withColumn(
            "_from", F.when(high, F.greatest("bin_lower", "_seen")).otherwise(F.col("bin_lower"))
        ).withColumn("_to", F.when(high, F.col("bin_upper")).otherwise(F.least("bin_upper", "_seen")))
        for c, name in (("_from", "_cf"), ("_to", "_ct"), ("_seen", "_cs")):
            edge = _skew_cdf(edge, c, name)
        lo, hi = F.coalesce("_cf", F.lit(0.0)), F.coalesce("_ct", F.lit(1.0))
        mass = F.when(high, 1.0 - F.col("_cs")).otherwise(F.col("_cs"))
        cond = F.greatest(hi - lo, F.lit(0.0)) / F.when(mass > 0, mass)
        out = edge.withColumn("truncated", F.coalesce(gone, F.lit(False)))
        out = out.withColumn("_p", F.when(F.col("_seen").isNull(), F.col("p_win")).when(F.col("truncated"), 0.0).otherwise(F.coalesce(cond, F.col("p_win"))))
        out = out.drop("_cf", "_ct", "_cs", "_from", "_to")
    total = F.sum("_p").over(w)
    live = F.col("_seen").isNotNull() & (F.col("_t") > 0)
    scaled = out.withColumn("_t", total).withColumn("_q", F.when(F.col("_t") > 0, F.col("_p") / F.col("_t")))
    floored = scaled.withColumn("_q", F.when((F.col("_q") > 0) & (F.col("_q") < p.p_floor), p.p_floor).otherwise(F.col("_q")))
    final = floored.withColumn("_t2", F.sum("_q").over(w))
    value = F.when(live, F.col("_q") / F.col("_t2")).otherwise(F.col("_p"))
    return final.withColumn("p_win", value).drop("_seen", "_p", "_t", "_q", "_t2", "t_max_f", "t_min_f")


def price_book(state: DataFrame, extremes: DataFrame | None = None, bins: DataFrame | None = None, mode: str = "zero", p: Params = DEFAULTS) -> DataFrame:
    """DST-05: from ensemble states to a normalised, truncated probability ladder per group.

    Groups with a detected two-cluster regime are priced with the mixture, the others with the
    skew-normal. ``bins`` are listed ladders; without them one is generated around the mean.
    """
    dist = skewnormal_params(state, p=p)
    ladder = bin_ladder(dist) if bins is None else dist.join(bins, GROUP)
    priced = price_bins(ladder, GROUP, p)
    if "centroid_1" in state.columns:
        mixed = (
            priced.withColumn("mu1", F.col("centroid_1") + F.col("b_k"))
            .withColumn("mu2", F.col("centroid_2") + F.col("b_k"))
            .withColumn("w1", F.col("size_1") / (F.col("size_1") + F.col("size_2")))
            .withColumnRenamed("p_win", "_p_skew")
        )
        # NULL centroids leave the mixture unevaluated, so both models share one pass
        both = _edge_cdfs(mixed, GROUP, _mixture_cdf)
        mixture = F.when(F.col("w1").isNotNull(), _mass(both, "_lo", "_hi", p))
        priced = both.withColumn("p_win", F.coalesce(mixture, F.col("_p_skew"))).drop("_lo", "_hi", "_p_skew", "mu1", "mu2", "w1")
    book = normalize_probs(priced, GROUP, "p_win", p)
    if extremes is None:
        return book.withColumn("truncated", F.lit(False))
    return truncate_probs(book, extremes, mode, GROUP, p)
