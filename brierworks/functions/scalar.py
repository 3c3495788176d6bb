"""Row-level expressions: all built-in functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from brierworks.params import DEFAULTS, Params


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def lead_bracket(hours: Column, p: Params = DEFAULTS) -> Column:
    """PRJ-04: h1..h5 by upper bound; negative leads have no bracket."""
    return (
        F.when(hours < 0, F.lit(None).cast("string"))
        .when(hours < p.lead_h1_max, "h1")
        .when(hours < p.lead_h2_max, "h2")
        .when(hours < p.lead_h3_max, "h3")
        .when(hours < p.lead_h4_max, "h4")
        .when(hours.isNotNull(), "h5")
    )


def convert_units(value: Column, uom: Column, kind: str) -> Column:
    """PRJ-02: temperatures to F (Celsius when untagged), speeds to mph; NaN and infinities become NULL."""
    v = F.when(F.isnan(value) | (F.abs(value) == math.inf), None).otherwise(value)
    u = F.lower(F.coalesce(uom, F.lit("")))
    if kind == "temperature":
        return F.when(u.contains("degf") | u.contains("fahrenheit"), v).otherwise(v * 9.0 / 5.0 + 32.0)
    if kind == "speed":
        return (
            F.when(u.contains("km_h") | u.contains("km/h"), v * 0.621371)
            .when(u.contains("m_s") | u.contains("m/s"), v * 2.236936)
            .when(u.contains("kn"), v * 1.150779)
            .otherwise(v)
        )
    return v


def preferred_error(adjusted: Column, raw: Column) -> Column:
    """PRJ-05: the adjusted error where known, else the raw one."""
    return F.coalesce(adjusted, raw)


def trailing(df: DataFrame, date: str, asof: Column, n: int) -> DataFrame:
    """PRJ-07: rows of the last ``n`` days up to an explicit date."""
    return df.filter((F.col(date) >= F.date_sub(asof, n)) & (F.col(date) <= asof))


def market_price(ask: Column, last: Column, bid: Column) -> Column:
    """PRJ-06: ask, else last trade, else bid."""
    return F.coalesce(ask, last, bid)


def contract_fee(price: Column, rate: float | Column) -> Column:
    """Fee of one contract in whole cents."""
    return F.ceil(rate * price * (1.0 - price) * 100.0)


def order_fee(price: Column, qty: Column, rate: float | Column) -> Column:
    """PRJ-08: fee of one order in whole cents, rounded up once per order."""
    return F.ceil(rate * qty * price * (1.0 - price) * 100.0)


def net_ev(p: Column, price: Column, rate: float | Column) -> Column:
    """PRJ-08: expected cents per contract after the fee."""
    return (p - price) * 100.0 - contract_fee(price, rate)


def edge_buffer(n_bets: Column, base: float = DEFAULTS.edge_base) -> Column:
    """PRJ-11: base buffer, widened while few bets are on record."""
    return F.when(n_bets > 0, F.greatest(F.lit(base), 1.96 * F.sqrt(0.25 / n_bets))).otherwise(F.lit(base))


def skill_scale(bss: Column, p: Params = DEFAULTS) -> Column:
    """PRJ-15: stake multiplier from skill."""
    return clip(bss / p.phi_cap, p.phi_min, 1.0)


def drawdown_scale(mdd: Column, p: Params = DEFAULTS) -> Column:
    """PRJ-15: 1 below the safe drawdown, 0 from the halt level, linear between."""
    return clip(1.0 - (mdd - p.mdd_safe) / (p.mdd_halt - p.mdd_safe), 0.0, 1.0)


def cyclic_day(date: Column) -> tuple[Column, Column]:
    """PRJ-19: sine and cosine of the day of the year."""
    angle = 2.0 * math.pi * F.dayofyear(date) / 365.25
    return F.sin(angle), F.cos(angle)


def open_edge_to_null(edge: Column) -> Column:
    """PRJ-14: every spelling of an open bin edge becomes NULL."""
    return F.when(F.abs(edge) >= 999.0, None).otherwise(edge)


def open_edge_from_null(edge: Column, side: str, style: str) -> Column:
    """PRJ-14: NULL edges as infinities or as +/-999 for systems that need a number."""
    size = math.inf if style == "infinity" else 999.0
    return F.coalesce(edge, F.lit(-size if side == "lower" else size))


def in_bin(value: Column, lower: Column, upper: Column) -> Column:
    """Half-open membership with NULL as an open edge; used for outcomes everywhere."""
    return (lower.isNull() | (value >= lower)) & (upper.isNull() | (value < upper))


def brier(p: Column, outcome: Column) -> Column:
    """AGG-11: squared distance of a probability to its outcome."""
    return (p - outcome) * (p - outcome)


def bic(n: Column, rss: Column, k: int) -> Column:
    """AGG-22: n ln(RSS/n) + k ln n, infinite without data or residuals."""
    ok = (n > 0) & (rss > 0)
    safe_n, safe_rss = F.when(ok, n), F.when(ok, rss)
    return F.coalesce(safe_n * F.ln(safe_rss / safe_n) + k * F.ln(safe_n), F.lit(math.inf))


def measurement_noise(f_top: Column, f_bar: Column, spread: Column, p: Params = DEFAULTS) -> Column:
    """KAL-01: noise grows when the top source leaves the ensemble."""
    ratio = F.abs(f_top - f_bar) / F.when(spread > 0, spread)
    return F.coalesce(p.r_default * (1.0 + p.beta * F.greatest(F.lit(0.0), ratio - 1.0)), F.lit(p.r_default))


def sigma_eff(sigma: Column, spread: Column, mod: Column | float = 1.0, p: Params = DEFAULTS) -> Column:
    """AGG-10: error spread and ensemble spread combined, times the text modifier, floored."""
    return F.greatest(F.sqrt(sigma * sigma + p.k_spread * spread * spread) * mod, F.lit(p.sigma_floor))


def shrink(n: Column, own: Column, pooled: Column, p: Params = DEFAULTS) -> Column:
    """AGG-07: sample-size weighted pull of a cell's sigma to the pooled one."""
    return F.greatest((n * own + p.m_prior * pooled) / (n + p.m_prior), F.lit(p.sigma_floor))


def unbiased_skew(n: Column, g: Column, p: Params = DEFAULTS) -> Column:
    """AGG-03: small-sample correction, zero where not significant."""
    adj = F.when(n >= 3, F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2.0) * g).otherwise(0.0)
    return F.when(F.abs(adj) < p.skew_significance * F.sqrt(6.0 / n), 0.0).otherwise(adj)


def jitter(key: Column, seed: int, pct: float) -> Column:
    """A repeatable multiplier in [1-pct, 1+pct], the same on every retry."""
    unit = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000003)) / 1000002.0
    return 1.0 + pct * (2.0 * unit - 1.0)
