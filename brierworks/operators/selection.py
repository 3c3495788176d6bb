"""Gates, stakes, books and change signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.functions.scalar import drawdown_scale, edge_buffer, jitter, market_price, net_ev, skill_scale
from brierworks.operators.ordering import join_keys, latest_per_key, tail_n
from brierworks.operators.verification import GROUP
from brierworks.params import DEFAULTS, Params
from brierworks.session import cut_lineage

GATES = ("edge", "spread", "skill", "lead", "reserved")


def evaluate_gates(df: DataFrame, p: Params = DEFAULTS, basis: str = "price") -> DataFrame:
    """PRJ-10: five conviction gates as a flag map and their conjunction.

    Columns: p_win, price, n_bets, spread, bss, was_qualified, lead_hours (bankroll for that basis).
    Unknown skill passes: there is no history to judge yet.
    """
    price = F.col("price")
    edge = F.col("p_win") - price
    worth = p.ev_min_fraction * (price if basis == "price" else F.col("bankroll")) * 100.0
    level = F.when(F.col("was_qualified"), p.skill_exit).otherwise(p.skill_enter)
    checks = {
        "edge": (edge > edge_buffer(F.col("n_bets"), p.edge_base)) & (net_ev(F.col("p_win"), price, p.taker_rate) > worth),
        "spread": F.col("spread") <= p.spread_max,
        "skill": F.col("bss").isNull() | (F.col("bss") >= level),
        "lead": F.col("lead_hours") <= p.lead_ceiling_hours,
        "reserved": F.lit(True),
    }
    flags = F.create_map(*[x for g in GATES for x in (F.lit(g), checks[g])])
    out = df.withColumn("gate_flags", flags)
    return out.withColumn("all_pass", F.forall(F.map_values("gate_flags"), lambda v: F.coalesce(v, F.lit(False))))


def maker_taker(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """PRJ-09: rest an order only when it is likely to fill and still pays more than crossing."""
    fill = 1.0 - F.exp(-F.col("lead_hours") / p.fill_half_hours)
    taker = net_ev(F.col("p_win"), F.col("ask"), p.taker_rate)
    maker = fill * net_ev(F.col("p_win"), F.col("bid"), p.maker_rate)
    rest = (fill > p.maker_min_fill) & (maker > taker)
    return (
        df.withColumn("p_fill", fill)
        .withColumn("order_type", F.when(rest, "MAKER").otherwise("TAKER"))
        .withColumn("order_price", F.when(rest, F.col("bid")).otherwise(F.col("ask")))
        .withColumn("ev_net", F.when(rest, maker).otherwise(taker))
    )


def liquid(df: DataFrame, start_hour: int, end_hour: int, at: str = "snapshot_at") -> DataFrame:
    """PRJ-12: priced, with depth, and inside the trading hours."""
    h = F.hour(at)
    return df.filter((F.col("price") > 0) & (F.col("depth") > 0) & (h >= start_hour) & (h < end_hour))


def size_positions(df: DataFrame, p: Params = DEFAULTS, seed: int | None = None) -> DataFrame:
    """PRJ-16: from the raw fraction to whole contracts, with the reason where nothing is staked.

    Columns: f_star, bss, composite, gamma_scale, mdd, bankroll, capacity, price, ticker. The jitter
    is a hash of ticker and seed, off without a seed.
    """
    f = F.least(F.col("f_star"), F.lit(p.fraction_cap)) * skill_scale(F.col("bss"), p)
    f = F.least(f * F.col("composite") * F.col("gamma_scale"), F.col("capacity")) * drawdown_scale(F.col("mdd"), p)
    if seed is not None:
        f = f * jitter(F.col("ticker"), seed, p.jitter)
    out = df.withColumn("_f", f)
    whole = F.floor(F.col("_f") * F.col("bankroll") / F.greatest(F.col("price"), F.lit(0.01)))
    reason = F.when(F.col("_f") < p.min_bet_fraction, "below_minimum").when(whole < 1, "below_one_contract")
    return (
        out.withColumn("skip_reason", reason)
        .withColumn("f_final", F.when(reason.isNull(), F.col("_f")).otherwise(0.0))
        .withColumn("contracts", F.when(reason.isNull(), whole).otherwise(F.lit(0).cast("bigint")))
        .drop("_f")
    )


def kelly_exclusive(df: DataFrame, by: list[str] = GROUP, price: str = "price", prob: str = "p_win", tie: str = "ticker") -> DataFrame:
    """W-07: growth-optimal fractions when exactly one outcome of a group happens.

    By falling edge ratio, an outcome joins while its ratio beats the reserve rate of those before it.
    Up to the first refusal the sums over all candidates are the sums over the accepted ones, so a
    running minimum of the test is exact. Groups are ladders, hence small.
    """
    c, q = F.col(price), F.col(prob)
    cand = df.filter((c > 0) & (q > 0)).withColumn("edge_ratio", q / c).filter(F.col("edge_ratio") > 1.0)
    order = Window.partitionBy(*by).orderBy(F.col("edge_ratio").desc(), F.col(tie))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    room = 1.0 - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    rest = 1.0 - F.coalesce(F.sum(q).over(before), F.lit(0.0))
    test = F.coalesce((room > 0) & (F.col("edge_ratio") > rest / F.when(room > 0, room)), F.lit(False))
    ok = cand.withColumn("_ok", test.cast("int"))
    kept = ok.withColumn("_in", F.min("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_in") == 1)
    grp = Window.partitionBy(*by)
    ratio = (1.0 - F.sum(q).over(grp)) / F.greatest(1.0 - F.sum(c).over(grp), F.lit(1e-9))
    return kept.withColumn("f_star", F.greatest(F.lit(0.0), q - c * ratio)).drop("_ok", "_in")


def vwap(
    levels: DataFrame, need: Column, by: list[str], price: str = "price", qty: str = "quantity", decimals: int | None = 4
) -> DataFrame:
    """W-08: average price of filling ``need`` from the best level up, and what the depth allows.

    Levels of one price are merged first (sums before the shuffle), so a book has at most one row
    per cent whatever its raw size. ``need`` may refer to the key columns.
    """
    book = levels.groupBy(*by, price).agg(F.sum(qty).alias("_q"))
    before = Window.partitionBy(*by).orderBy(price).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_q").over(before), F.lit(0.0))
    take = F.greatest(F.least(F.col("_q"), need - ahead), F.lit(0.0))
    filled = book.withColumn("_take", take).groupBy(*by).agg(
        F.sum("_take").alias("filled"), F.sum(F.col(price) * F.col("_take")).alias("_cost"), F.min(price).alias("_best")
    )
    value = F.coalesce(F.col("_cost") / F.nullif(F.col("filled") * 100.0, F.lit(0.0)), F.lit(0.0))
    return filled.withColumn("vwap", value if decimals is None else F.bround(value, decimals)).withColumn("best", F.col("_best") / 100.0).drop("_cost", "_best")


def book_staleness(df: DataFrame, a: str = "vwap", b: str = "best", p: Params = DEFAULTS) -> DataFrame:
    """PRJ-17: alert beyond the tolerated gap, abort beyond twice of it."""
    delta = F.abs(F.col(a) - F.col(b))
    return df.withColumn("delta", delta).withColumn("alert", delta > p.stale_delta).withColumn("abort", delta > 2 * p.stale_delta)


def split_tranches(df: DataFrame, contracts: str = "contracts", p: Params = DEFAULTS) -> DataFrame:
    """PRJ-18: orders above the threshold become rows of at most one tranche."""
    c = F.col(contracts)
    size = F.when(c > p.tranche_threshold, F.lit(p.tranche_size)).otherwise(c)
    n = F.greatest(F.ceil(c / F.greatest(size, F.lit(1))), F.lit(1)).cast("int")
    rows = df.withColumn("_size", size).withColumn("tranche", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("tranche_contracts", F.least(F.col("_size"), c - F.col("tranche") * F.col("_size"))).drop("_size")


def fill_fees(fills: DataFrame, by: list[str], rate: float, price: str = "price", qty: str = "contracts") -> DataFrame:
    """PRJ-08: fees rounded up per fill, and what one order would have cost."""
    from brierworks.functions.scalar import order_fee

    each = order_fee(F.col(price), F.col(qty), rate)
    raw = F.sum(rate * F.col(qty) * F.col(price) * (1.0 - F.col(price)) * 100.0)
    return fills.groupBy(*by).agg(F.sum(each).alias("fill_fee_cents"), F.ceil(F.round(raw, 6)).alias("order_fee_cents"))


def convergence(df: DataFrame, by: list[str] = GROUP, price: str = "price", prob: str = "p_win", p: Params = DEFAULTS) -> DataFrame:
    """W-15: market price of the model's favourite against the best other price, and the stake scale."""
    top = tail_n(df, by, [F.col(prob).desc(), F.col("ticker")], 1).select(*by, F.col("ticker").alias("_top"), F.col(price).alias("_tp"))
    other = F.max(F.when((F.col("ticker") != F.col("_top")) & (F.col(price) > 0), F.col(price)))
    out = df.join(top, by).groupBy(*by).agg(F.max("_tp").alias("_tp"), other.alias("_other"))
    gamma = F.coalesce(F.col("_tp") / F.col("_other"), F.lit(1.0))
    scale = F.when(gamma < p.convergence_threshold, gamma / p.convergence_threshold).otherwise(1.0)
    return out.withColumn("gamma", gamma).withColumn("gamma_scale", scale).drop("_tp", "_other")


# ---------------------------------------------------------------- change signals

def bias_velocity(hist: DataFrame, by: list[str], date: str = "target_date", b: str = "b_k", p: Params = DEFAULTS) -> DataFrame:
    """W-12: how fast the bias moves against its own recent pace. Only the last rows per key are kept
    before they are put in an array, so its length is the window."""
    recent = tail_n(hist.select(*by, date, b), by, [F.col(date).desc()], p.kcv_window)
    xs = F.sort_array(F.collect_list(F.struct(date, b)), asc=False)
    arr = recent.groupBy(*by).agg(F.transform(xs, lambda x: F.coalesce(x[b], F.lit(0.0))).alias("_b"))
    v, n = F.col("_b"), F.size("_b")
    step = lambda i: F.least(F.lit(p.kcv_lookback), n - 1 - i)
    pace = F.transform(
        F.sequence(F.lit(0), n - 2), lambda i: F.abs(F.get(v, i) - F.get(v, i + step(i))) / step(i)
    )
    mean = F.aggregate(pace, F.lit(0.0), lambda a, x: a + x) / (n - 1)
    now = F.abs(F.get(v, F.lit(0)) - F.get(v, F.least(F.lit(p.kcv_lookback), n - 1))) / p.kcv_lookback
    norm = F.when(n >= 2, now / F.greatest(mean, F.lit(1e-6))).otherwise(0.0)
    out = arr.withColumn("kcv_norm", norm)
    mod = F.least(F.greatest(F.lit(0.5), 1.0 - 0.25 * (F.col("kcv_norm") - 1.0)), F.lit(1.25))
    return (
        out.withColumn("kcv_mod", F.when(n >= 2, mod).otherwise(1.0))
        .withColumn("kcv_veto", F.col("kcv_norm") > p.kcv_veto)
        .drop("_b")
    )


def divergence(df: DataFrame, by: list[str], order: list[str], prob: str = "p_win", price: str = "price", p: Params = DEFAULTS) -> DataFrame:
    """W-13: market move minus model move since the previous run. One row per ticker and run."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = (F.col(price) - F.lag(price).over(w)) - (F.col(prob) - F.lag(prob).over(w))
    out = df.withColumn("mpds", F.coalesce(d, F.lit(0.0)))
    m = F.col("mpds")
    mod = F.when(m >= 0, F.greatest(F.lit(0.5), 1.0 - m * p.divergence_pos)).otherwise(F.greatest(F.lit(0.3), 1.0 + m * p.divergence_neg))
    return out.withColumn("mpds_mod", mod).withColumn("mpds_veto", F.abs(m) > p.divergence_veto)


def spread_trend(df: DataFrame, by: list[str], order: list[str], spread: str = "spread", sigma: str = "sigma", lag: int = 1, p: Params = DEFAULTS) -> DataFrame:
    """W-13: growth of the ensemble spread in units of historical sigma."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = F.col(sigma)
    fct = (F.col(spread) - F.lag(spread, lag).over(w)) / F.when(s > 0, s)
    out = df.withColumn("fct", F.coalesce(fct, F.lit(0.0)))
    t = F.col("fct")
    mod = F.when(t < 0, F.least(F.lit(1.4), 1.0 - t * 0.4)).otherwise(F.greatest(F.lit(0.5), 1.0 - t * 0.6))
    return out.withColumn("fct_mod", mod).withColumn("fct_veto", t > p.trend_veto)


def seasonal_signal(b_seasonal: Column, b_now: Column, sigma: Column, p: Params = DEFAULTS) -> tuple[Column, Column]:
    """Distance of today's bias to its seasonal mean, and its stake modifier."""
    scas = F.coalesce(F.abs(F.coalesce(b_seasonal, F.lit(0.0)) - b_now) / F.when(sigma > 0, sigma), F.lit(0.0))
    return scas, F.greatest(F.lit(0.6), 1.0 - p.seasonal_scale * scas)


def signal_composite(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """FN-01: weighted geometric mean of the five modifiers, clipped, and the first veto that fires."""
    mods = ("kcv_mod", "mpds_mod", "hmas_mod", "fct_mod", "scas_mod")
    logs = [w * F.ln(F.greatest(F.col(m), F.lit(1e-6))) for m, w in zip(mods, p.composite_weights)]
    value = F.exp(reduce(lambda a, b: a + b, logs))
    reason = F.coalesce(F.when(F.col("kcv_veto"), "KCV"), F.when(F.col("mpds_veto"), "MPDS"), F.when(F.col("fct_veto"), "FCT"))
    return (
        df.withColumn("composite", F.greatest(F.lit(p.composite_low), F.least(F.lit(p.composite_high), value)))
        .withColumn("veto_reason", reason)
        .withColumn("veto", reason.isNotNull())
    )


# ---------------------------------------------------------------- exposure and reports

def remaining_capacity(cands: DataFrame, positions: DataFrame, bankroll: float, p: Params = DEFAULTS, open_states: tuple[str, ...] = ("OPEN", "PAPER_OPEN")) -> DataFrame:
    """AGG-16: least of the five exposure limits, as a share of the bankroll.

    Open stakes are summed once per station-day; the coarser sums start from those. The portfolio
    total is a scalar subquery.
    """
    live = positions.filter(F.col("status").isin(*open_states))
    stake = F.col("entry_price") * F.col("contracts")
    day = cut_lineage(live.groupBy("office", "station_id", "target_date").agg(F.sum(stake).alias("_s")))
    station_day = day.groupBy("station_id", "target_date").agg(F.sum("_s").alias("_day"))
    station = day.groupBy("station_id").agg(F.sum("_s").alias("_station"))
    office = day.groupBy("office").agg(F.sum("_s").alias("_office"))
    total = day.agg(F.coalesce(F.sum("_s"), F.lit(0.0)))
    left = lambda cap, used: F.greatest(F.lit(0.0), cap * bankroll - F.coalesce(used, F.lit(0.0))) / max(bankroll, 1.0)
    out = cands.join(station_day, ["station_id", "target_date"], "left")
    out = join_keys(join_keys(out, station, ["station_id"], "left"), office, ["office"], "left")
    out = out.withColumn("_total", total.scalar())
    least = F.least(
        F.lit(p.max_single), left(p.max_station_day, F.col("_day")), left(p.max_station, F.col("_station")),
        left(p.max_office, F.col("_office")), left(p.max_total, F.col("_total")),
    )
    return out.withColumn("capacity", least).drop("_day", "_station", "_office", "_total")


def funnel(bets: DataFrame) -> DataFrame:
    """AGG-19: how many candidates survive each stage, and where most are lost."""
    flag = lambda g: F.coalesce(F.col("gate_flags")[g], F.lit(False))
    everything = reduce(lambda a, b: a & b, [flag(g) for g in GATES])
    priced = F.col("vwap") > 0
    edge = F.when(priced, F.col("p_win") - F.coalesce("price", "vwap"))
    out = bets.agg(
        F.count(F.lit(1)).alias("n_candidates"),
        *[F.count_if(flag(g)).alias(f"n_{g}") for g in GATES[:4]],
        F.count_if(everything).alias("n_all_gates"),
        F.count_if(F.col("f_star") > 0).alias("n_kelly"),
        F.count_if(F.col("veto")).alias("n_vetoed"),
        F.count_if(F.col("selected")).alias("n_selected"),
        F.coalesce(F.avg(edge), F.lit(0.0)).alias("avg_edge"),
        F.coalesce(F.max(edge), F.lit(0.0)).alias("max_edge"),
        F.count(edge).alias("n_priced"),
    )
    lost = [F.struct((F.col("n_candidates") - F.col(f"n_{g}")).alias("n"), F.lit(-i).alias("o"), F.lit(g).alias("g")) for i, g in enumerate(GATES[:4])]
    worst = F.greatest(*lost)
    stage = (
        F.when((F.col("n_candidates") == 0) | (F.col("n_selected") > 0), None)
        .when(F.col("n_all_gates") == 0, F.concat(F.lit("gate_"), worst["g"], F.lit("_rejected_"), worst["n"].cast("string")))
        .when(F.col("n_kelly") == 0, "no_positive_fraction")
        .when(F.col("n_vetoed") > 0, F.concat(F.lit("vetoed_"), F.col("n_vetoed").cast("string")))
        .otherwise("sizing_below_minimum")
    )
    return out.withColumn("bottleneck", stage)


def best_bin(df: DataFrame, by: list[str] = GROUP, min_p: float = 0.20, stake: float = 0.01, bankroll: float = 1000.0) -> DataFrame:
    """TOP-03: the likeliest priced bin of each group with a small fixed stake."""
    price = market_price(F.col("yes_ask"), F.col("last_price"), F.col("yes_bid"))
    priced = df.withColumn("price", price).filter((F.col("p_win") > min_p) & F.col("price").isNotNull())
    best = latest_per_key(priced, by, [F.col("p_win").desc(), F.col("ticker")])
    contracts = F.greatest(F.lit(1), F.floor(stake * bankroll / F.greatest(F.col("price"), F.lit(0.01))))
    return best.withColumn("contracts", contracts).withColumn("ev_net", (F.col("p_win") - F.col("price")) * 100.0)


def depth_coverage(snaps: DataFrame, by: list[str]) -> DataFrame:
    """AGG-30."""
    return snaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        F.count_if(F.col("depth") > 0).alias("n_with_depth"),
        F.count_if(F.col("depth") <= 0).alias("n_empty"),
    )
