"""Gates, stakes, books, settlement, walk-forward and monitoring queries on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brierworks.functions import scalar as S
from brierworks.operators import monitoring as M, ordering as O, portfolio as PF, selection as X, verification as V, walkforward as WF
from brierworks.params import DEFAULTS
from brierworks.plans import bindings as B
from brierworks.plans.bindings import with_tables as T
from brierworks.plans.registry import R, query, r6, rounded

# ------------------------------------------------------------------ candidates

CAND_SQL = """cand AS (SELECT *, o_orderkey % 200 AS n_bets, (o_orderkey % 60) / 10.0::DOUBLE AS spread,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 13) / 100.0::DOUBLE END AS bss, o_orderkey % 2 = 0 AS was_qualified,
  o_orderkey % 100 * 1.0::DOUBLE AS lead_hours, 'T' || o_orderkey::VARCHAR AS ticker FROM graded)"""


def candidates(spark, sf):
    return B.graded(spark, sf).selectExpr(
        "*", "p AS p_win", "o_orderkey % 200 AS n_bets", "(o_orderkey % 60) / 10.0D AS spread",
        "CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 13) / 100.0D END AS bss", "o_orderkey % 2 = 0 AS was_qualified",
        "o_orderkey % 100 * 1.0D AS lead_hours", "concat('T', cast(o_orderkey as string)) AS ticker")


GATE_SQL = """gate AS (SELECT *, p - price > CASE WHEN n_bets > 0 THEN greatest(0.03::DOUBLE, 1.96::DOUBLE * sqrt(0.25 / n_bets)) ELSE 0.03 END
   AND (p - price) * 100.0 - ceil(0.07::DOUBLE * price * (1.0 - price) * 100.0) > 0.025::DOUBLE * price * 100.0 AS edge,
  spread <= 4.0 AS spread_ok, bss IS NULL OR bss >= CASE WHEN was_qualified THEN 0.03 ELSE 0.07 END AS skill, lead_hours <= 72 AS lead FROM cand)"""


@query("prj10_conviction_gates", T("graded", extra=CAND_SQL + "," + GATE_SQL) + """SELECT o_orderkey, edge, spread_ok AS spread_gate, skill, lead, edge AND spread_ok AND skill AND lead AS all_pass FROM gate""")
def _(spark, sf):
    g = X.evaluate_gates(candidates(spark, sf))
    flag = lambda k: F.col("gate_flags")[k]
    return g.select("o_orderkey", flag("edge").alias("edge"), flag("spread").alias("spread_gate"), flag("skill").alias("skill"), flag("lead").alias("lead"), "all_pass")


@query("prj11_edge_buffer", T("graded", extra=CAND_SQL) + f"SELECT o_orderkey, {R('CASE WHEN n_bets > 0 THEN greatest(0.03::DOUBLE, 1.96::DOUBLE * sqrt(0.25 / n_bets)) ELSE 0.03 END', 'epsilon')} FROM cand")
def _(spark, sf):
    return candidates(spark, sf).select("o_orderkey", r6(S.edge_buffer(F.col("n_bets")), "epsilon"))


MT_SQL = """mt AS (SELECT *, 1.0 - exp(-lead_hours / 24.0::DOUBLE) AS pf, (p - price) * 100.0 - ceil(0.07::DOUBLE * price * (1.0 - price) * 100.0) AS tk,
  (1.0 - exp(-lead_hours / 24.0::DOUBLE)) * ((p - bid) * 100.0 - ceil(0.0175::DOUBLE * bid * (1.0 - bid) * 100.0)) AS mk FROM (SELECT *, price - 0.03::DOUBLE AS bid FROM cand))"""


@query("prj09_maker_taker", T("graded", extra=CAND_SQL + "," + MT_SQL) + f"""SELECT o_orderkey, {R('pf', 'p_fill')}, CASE WHEN pf > 0.8 AND mk > tk THEN 'MAKER' ELSE 'TAKER' END AS order_type,
 {R('CASE WHEN pf > 0.8 AND mk > tk THEN bid ELSE price END', 'order_price')}, {R('CASE WHEN pf > 0.8 AND mk > tk THEN mk ELSE tk END', 'ev_net')} FROM mt""")
def _(spark, sf):
    c = candidates(spark, sf).withColumn("ask", F.col("price")).withColumn("bid", F.col("price") - 0.03)
    return rounded(X.maker_taker(c).select("o_orderkey", "p_fill", "order_type", "order_price", "ev_net"))


@query("prj12_liquid", "SELECT event_id, value FROM events WHERE value > 0 AND event_id % 3 > 0 AND hour(ts) >= 14 AND hour(ts) < 23")
def _(spark, sf):
    q = B.events(spark, sf).selectExpr("event_id", "value", "value AS price", "event_id % 3 AS depth", "ts AS snapshot_at")
    return X.liquid(q, 14, 23).select("event_id", "value")


@query("prj15_scales", T("graded") + f"""SELECT o_orderkey, {R('greatest(0.1, least(1.0, (p - 0.5) / 0.25::DOUBLE))', 'phi')}, {R('greatest(0.0, least(1.0, 1.0 - (price - 0.1::DOUBLE) / 0.1::DOUBLE))', 'd_scale')} FROM graded""")
def _(spark, sf):
    return B.graded(spark, sf).select("o_orderkey", r6(S.skill_scale(F.col("p") - 0.5), "phi"), r6(S.drawdown_scale(F.col("price")), "d_scale"))


SIZE_SQL = """sz AS (SELECT *, least(least(p, 0.10::DOUBLE) * greatest(0.1, least(1.0, coalesce(bss, 0) * 3 / 0.25::DOUBLE)) * (0.7::DOUBLE + price / 2) * 0.9::DOUBLE, 0.08::DOUBLE)
   * greatest(0.0, least(1.0, 1.0 - (spread / 30 - 0.1::DOUBLE) / 0.1::DOUBLE)) AS f FROM cand),
 s2 AS (SELECT *, floor(f * 1000.0 / greatest(price, 0.01)) AS w FROM sz)"""


@query("prj16_size_positions", T("graded", extra=CAND_SQL + "," + SIZE_SQL) + f"""SELECT o_orderkey, CASE WHEN f < 0.025 THEN 'below_minimum' WHEN w < 1 THEN 'below_one_contract' END AS skip_reason,
 {R('CASE WHEN f < 0.025 OR w < 1 THEN 0 ELSE f END', 'f_final')}, CAST(CASE WHEN f < 0.025 OR w < 1 THEN 0 ELSE w END AS BIGINT) AS contracts FROM s2""")
def _(spark, sf):
    c = candidates(spark, sf).selectExpr(
        "o_orderkey", "ticker", "p AS f_star", "coalesce(bss, 0) * 3 AS bss", "0.7D + price / 2 AS composite", "0.9D AS gamma_scale", "spread / 30 AS mdd",
        "1000.0D AS bankroll", "0.08D AS capacity", "price")
    return rounded(X.size_positions(c).select("o_orderkey", "skip_reason", "f_final", "contracts"))


@query("prj17_book_staleness", T("snap") + f"SELECT ticker, snapshot_id, {R('abs(price - depth / 500.0)', 'delta')}, abs(price - depth / 500.0) > 0.05::DOUBLE AS alert, abs(price - depth / 500.0) > 0.1::DOUBLE AS abort FROM snap")
def _(spark, sf):
    s = B.snapshots(spark, sf).withColumn("vwap", F.col("price")).withColumn("best", F.col("depth") / 500.0)
    return rounded(X.book_staleness(s).select("ticker", "snapshot_id", "delta", "alert", "abort"))


TR_SQL = """tr AS (SELECT position_id, contracts * 5 AS c FROM pos),
 tx AS (SELECT position_id, c, unnest(CASE WHEN c > 50 THEN range(0, CAST(ceil(c / 25.0) AS BIGINT)) ELSE [0] END) AS i FROM tr)"""


@query("prj18_split_tranches", T("pos", extra=TR_SQL) + "SELECT position_id, CAST(i AS INT) AS tranche, CASE WHEN c > 50 THEN least(25, c - i * 25) ELSE c END AS tranche_contracts FROM tx")
def _(spark, sf):
    p = B.positions(spark, sf).select("position_id", (F.col("contracts") * 5).alias("contracts"))
    return X.split_tranches(p).select("position_id", "tranche", F.col("tranche_contracts").cast("bigint").alias("tranche_contracts"))


@query("prj08_fill_fees", "WITH f AS (SELECT l_orderkey, l_discount + 0.3::DOUBLE AS price, l_quantity AS contracts FROM lineitem)" + """
SELECT l_orderkey, CAST(sum(ceil(0.07::DOUBLE * contracts * price * (1.0 - price) * 100.0)) AS BIGINT) AS fill_fee_cents,
 CAST(ceil(round(sum(0.07::DOUBLE * contracts * price * (1.0 - price) * 100.0), 6)) AS BIGINT) AS order_fee_cents FROM f GROUP BY 1""")
def _(spark, sf):
    f = B.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_discount + 0.3D AS price", "l_quantity AS contracts")
    return X.fill_fees(f, ["l_orderkey"], DEFAULTS.taker_rate)


# ------------------------------------------------------------------ exclusive stakes and books

KELLY_SQL = """kg AS (SELECT o_orderkey // 5 AS g, 'T' || o_orderkey::VARCHAR AS ticker, ((o_orderkey * 37) % 1000) / 5000.0::DOUBLE AS p_win, ((o_orderkey * 53) % 90 + 5) / 600.0::DOUBLE AS price FROM orders),
 kc AS (SELECT *, p_win / price AS er FROM kg WHERE p_win > 0 AND price > 0 AND p_win / price > 1.0),
 ks AS (SELECT *, 1 - coalesce(sum(price) OVER w, 0) AS room, 1 - coalesce(sum(p_win) OVER w, 0) AS rest FROM kc WINDOW w AS (PARTITION BY g ORDER BY er DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 ko AS (SELECT *, min(CASE WHEN room > 0 AND er > rest / room THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY er DESC, ticker ROWS UNBOUNDED PRECEDING) AS ok FROM ks),
 kf AS (SELECT *, (1 - sum(p_win) OVER (PARTITION BY g)) / greatest(1 - sum(price) OVER (PARTITION BY g), 1e-9) AS ratio FROM ko WHERE ok = 1)"""


@query("w07_kelly_exclusive", "WITH " + KELLY_SQL + f" SELECT g, ticker, {R('er', 'edge_ratio')}, {R('greatest(0.0, p_win - price * ratio)', 'f_star')} FROM kf")
def _(spark, sf):
    # five mutually exclusive outcomes per group
    k = B.table(spark, sf, "orders").selectExpr(
        "o_orderkey div 5 AS g", "concat('T', cast(o_orderkey as string)) AS ticker", "((o_orderkey * 37) % 1000) / 5000.0D AS p_win", "((o_orderkey * 53) % 90 + 5) / 600.0D AS price")
    return rounded(X.kelly_exclusive(k, ["g"]).select("g", "ticker", "edge_ratio", "f_star"))


@query("w08_vwap", T("lv", extra="""
o AS (SELECT *, sum(quantity) OVER (PARTITION BY ticker ORDER BY price, quantity, rowid_ ROWS UNBOUNDED PRECEDING) - quantity AS ahead FROM (SELECT *, row_number() OVER () AS rowid_ FROM lv)),
f AS (SELECT *, greatest(least(quantity, (ticker % 300 + 50) - ahead), 0) AS take FROM o)""") + f"""
SELECT ticker, {R('sum(take)', 'filled')}, {R('CASE WHEN sum(take) = 0 THEN 0 ELSE round_even(sum(price * take) / (sum(take) * 100.0::DOUBLE), 4) END', 'vwap')}, {R('min(price) / 100.0', 'best')} FROM f GROUP BY 1""")
def _(spark, sf):
    need = (F.col("ticker") % 300 + 50).cast("double")
    return rounded(X.vwap(B.book_levels(spark, sf), need, ["ticker"]))


CONV_SQL = """cv AS (SELECT o_orderkey // 5 AS g, 'T' || o_orderkey::VARCHAR AS ticker, ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE AS p_win, ((o_orderkey * 53) % 90 + 5) / 100.0::DOUBLE AS price FROM orders),
 ct AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p_win DESC, ticker) AS rn FROM cv),
 cg AS (SELECT g, coalesce(max(CASE WHEN rn = 1 THEN price END) / max(CASE WHEN rn > 1 AND price > 0 THEN price END), 1.0) AS gamma FROM ct GROUP BY 1)"""


@query("w15_convergence", "WITH " + CONV_SQL + f" SELECT g, {R('gamma', 'gamma')}, {R('CASE WHEN gamma < 0.75 THEN gamma / 0.75::DOUBLE ELSE 1 END', 'gamma_scale')} FROM cg")
def _(spark, sf):
    k = B.table(spark, sf, "orders").selectExpr(
        "o_orderkey div 5 AS g", "concat('T', cast(o_orderkey as string)) AS ticker", "((o_orderkey * 37) % 1000) / 1000.0D AS p_win", "((o_orderkey * 53) % 90 + 5) / 100.0D AS price")
    return rounded(X.convergence(k, ["g"]))


@query("w16_rank_in_group", T("graded") + "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderkey // 20 ORDER BY p - price DESC) AS INT) AS rank FROM graded")
def _(spark, sf):
    # twenty candidates per group
    g = B.graded(spark, sf).withColumn("g", F.expr("o_orderkey div 20"))
    return O.rank_in_group(g, ["g"], [(F.col("p") - F.col("price")).desc()]).select("o_orderkey", "rank")


# ------------------------------------------------------------------ signals

HIST_SQL = """hb AS (SELECT o_custkey % 20 AS station_id, CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS target_type, CAST(o_orderdate AS DATE) AS target_date,
  avg(((o_orderkey * 37) % 1000) / 100.0::DOUBLE) AS b_k FROM orders GROUP BY 1, 2, 3)"""


def bias_days(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.groupBy(
        F.expr("o_custkey % 20").alias("station_id"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END").alias("target_type"), F.to_date("o_orderdate").alias("target_date")
    ).agg(F.avg(F.expr("((o_orderkey * 37) % 1000) / 100.0D")).alias("b_k"))


KCV_SQL = HIST_SQL + """, hr AS (SELECT *, row_number() OVER w - 1 AS i FROM hb WINDOW w AS (PARTITION BY station_id, target_type ORDER BY target_date DESC)),
 h9 AS (SELECT *, count(*) OVER (PARTITION BY station_id, target_type) AS n FROM hr WHERE i < 90),
 hp AS (SELECT a.*, least(7, a.n - 1 - a.i) AS step, b.b_k AS b2 FROM h9 a LEFT JOIN h9 b ON a.station_id = b.station_id AND a.target_type = b.target_type AND b.i = a.i + least(7, a.n - 1 - a.i)),
 hk AS (SELECT station_id, target_type, any_value(n) AS n, max(CASE WHEN i = 0 THEN abs(b_k - b2) / 7.0 END) / greatest(avg(CASE WHEN step > 0 THEN abs(b_k - b2) / step END), 1e-6) AS norm FROM hp GROUP BY 1, 2)"""


@query("w12_bias_velocity", "WITH " + KCV_SQL + f""" SELECT station_id, target_type, {R('CASE WHEN n >= 2 THEN norm ELSE 0 END', 'kcv_norm')}, {R('CASE WHEN n >= 2 THEN least(greatest(0.5, 1 - 0.25 * (norm - 1)), 1.25) ELSE 1 END', 'kcv_mod')},
 n >= 2 AND norm > 4 AS kcv_veto FROM hk""")
def _(spark, sf):
    return rounded(X.bias_velocity(bias_days(spark, sf), ["station_id", "target_type"]))


RUN_SQL = """rn AS (SELECT l_partkey AS ticker, CAST(l_shipdate AS DATE) AS run_date, avg(l_discount * 5) AS p_win, avg(l_tax * 6) AS price, avg(l_quantity / 10) AS spread, 3.0::DOUBLE AS sigma FROM lineitem GROUP BY 1, 2)"""


def run_rows(spark, sf):
    """One row per ticker and run date."""
    li = B.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("run_date")).agg(
        F.avg(F.col("l_discount") * 5).alias("p_win"), F.avg(F.col("l_tax") * 6).alias("price"), F.avg(F.col("l_quantity") / 10).alias("spread"), F.lit(3.0).alias("sigma"))


@query("w13_divergence", "WITH " + RUN_SQL + f""", d AS (SELECT *, coalesce((price - lag(price) OVER w) - (p_win - lag(p_win) OVER w), 0.0) AS m FROM rn WINDOW w AS (PARTITION BY ticker ORDER BY run_date))
 SELECT ticker, run_date, {R('m', 'mpds')}, {R('CASE WHEN m >= 0 THEN greatest(0.5, 1 - m * 5) ELSE greatest(0.3, 1 + m * 8) END', 'mpds_mod')} FROM d""")
def _(spark, sf):
    return rounded(X.divergence(run_rows(spark, sf), ["ticker"], ["run_date"]).select("ticker", "run_date", "mpds", "mpds_mod"))


@query("w13_spread_trend", "WITH " + RUN_SQL + f""", d AS (SELECT *, coalesce((spread - lag(spread) OVER w) / sigma, 0.0) AS t FROM rn WINDOW w AS (PARTITION BY ticker ORDER BY run_date))
 SELECT ticker, run_date, {R('t', 'fct')}, {R('CASE WHEN t < 0 THEN least(1.4, 1 - t * 0.4::DOUBLE) ELSE greatest(0.5, 1 - t * 0.6::DOUBLE) END', 'fct_mod')} FROM d""")
def _(spark, sf):
    return rounded(X.spread_trend(run_rows(spark, sf), ["ticker"], ["run_date"]).select("ticker", "run_date", "fct", "fct_mod"))


@query("fn01_signal_composite", T("graded", extra="""
m AS (SELECT o_orderkey, 0.5::DOUBLE + p * 0.75 AS a, 0.3::DOUBLE + price * 0.7 AS b, 0.7::DOUBLE + 0.6 * p AS c, 1.4::DOUBLE - price * 0.9 AS d, 0.6::DOUBLE + 0.4 * price AS e, p > 0.95 AS v1, price > 0.9 AS v2, p < 0.05 AS v3 FROM graded)""") + f"""
SELECT o_orderkey, {R('greatest(0.25, least(1.5, exp(0.25::DOUBLE * ln(a) + 0.35::DOUBLE * ln(b) + 0.15::DOUBLE * ln(c) + 0.15::DOUBLE * ln(d) + 0.10::DOUBLE * ln(e))))', 'composite')},
 CASE WHEN v1 THEN 'KCV' WHEN v2 THEN 'MPDS' WHEN v3 THEN 'FCT' END AS veto_reason, v1 OR v2 OR v3 AS veto FROM m""")
def _(spark, sf):
    m = B.graded(spark, sf).selectExpr(
        "o_orderkey", "0.5D + p * 0.75 AS kcv_mod", "0.3D + price * 0.7 AS mpds_mod", "0.7D + 0.6 * p AS hmas_mod", "1.4D - price * 0.9 AS fct_mod", "0.6D + 0.4 * price AS scas_mod",
        "p > 0.95 AS kcv_veto", "price > 0.9 AS mpds_veto", "p < 0.05 AS fct_veto")
    return rounded(X.signal_composite(m).select("o_orderkey", "composite", "veto_reason", "veto"))


# ------------------------------------------------------------------ positions

OBS_SQL = """po AS (SELECT o_custkey % 20 AS station_id, CAST(o_orderdate AS DATE) AS target_date, max((o_orderkey * 29) % 450 + 0.5::DOUBLE) AS hi, min((o_orderkey * 29) % 450 + 0.5::DOUBLE) AS lo FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
 sd AS (SELECT pos.*, CASE WHEN target_type = 'HIGH' THEN hi ELSE lo END AS observed FROM pos JOIN po USING (station_id, target_date)),
 se AS (SELECT *, CASE WHEN observed >= bin_lower AND observed < bin_upper THEN 1 ELSE 0 END AS outcome FROM sd),
 sg AS (SELECT *, CASE WHEN outcome = 1 THEN (1.0 - entry_price) * contracts * 100.0 ELSE -entry_price * contracts * 100.0 END AS pnl_gross FROM se),
 sn AS (SELECT *, pnl_gross - abs(pnl_gross) * 0.07::DOUBLE AS pnl_net FROM sg)"""


def settled(spark, sf):
    return PF.grade_positions(*positions_and_days(spark, sf))


def positions_and_days(spark, sf):
    o = B.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    v = F.expr("(o_orderkey * 29) % 450 + 0.5D")
    obs = o.groupBy(F.expr("o_custkey % 20").alias("station_id"), F.to_date("o_orderdate").alias("target_date")).agg(
        F.max(v).alias("observed_high_f"), F.min(v).alias("observed_low_f"))
    return B.positions(spark, sf), obs


@query("j12_settle", T("pos", extra=OBS_SQL) + f"SELECT position_id, outcome, {R('pnl_gross', 'pnl_gross')}, {R('pnl_net', 'pnl_net')}, 'SETTLED' AS status FROM sn WHERE status = 'OPEN' AND target_date < DATE '1998-01-01' AND position_id % 9 <> 0")
def _(spark, sf):
    positions, days = positions_and_days(spark, sf)
    positions = positions.withColumn("is_paper", F.expr("CASE WHEN position_id % 9 = 0 THEN 1 ELSE 0 END"))
    return rounded(PF.settle(positions, days, F.lit("1998-01-01").cast("date")).select("position_id", "outcome", "pnl_gross", "pnl_net", "status"))


@query("agg15_adverse_selection", T("pos", extra=OBS_SQL + """, q AS (SELECT office, count(*) FILTER (WHERE order_type = 'MAKER') AS n_maker, count(*) FILTER (WHERE order_type = 'TAKER') AS n_taker,
  avg(CASE WHEN order_type = 'MAKER' THEN pnl_net / (contracts * 100.0) END) AS m, avg(CASE WHEN order_type = 'TAKER' THEN pnl_net / (contracts * 100.0) END) AS t FROM sn WHERE status IN ('FILLED', 'SETTLED') AND target_date BETWEEN DATE '2002-01-01' - 4000 AND DATE '2002-01-01' GROUP BY 1)""") + f"""
SELECT office, n_maker, n_taker, {R('m', 'maker_quality')}, {R('t', 'taker_quality')}, {R('m - t', 'delta')}, CASE WHEN m - t < -0.05 THEN 'CRITICAL' WHEN m - t < -0.02 THEN 'WARNING' ELSE 'OK' END AS level FROM q""")
def _(spark, sf):
    return rounded(PF.adverse_selection(settled(spark, sf), F.lit("2002-01-01").cast("date"), 4000, ["office"]))


@query("agg16_remaining_capacity", T("pos", extra="""
lv AS (SELECT *, entry_price * contracts AS s FROM pos WHERE status IN ('OPEN', 'PAPER_OPEN')),
a AS (SELECT station_id, target_date, sum(s) AS v FROM lv GROUP BY 1, 2), b AS (SELECT station_id, sum(s) AS v FROM lv GROUP BY 1), c AS (SELECT office, sum(s) AS v FROM lv GROUP BY 1), d AS (SELECT sum(s) AS v FROM lv)""") + f"""
SELECT position_id, {R('''least(0.1, greatest(0, 0.1::DOUBLE * 200000.0 - coalesce(a.v, 0)) / 200000, greatest(0, 0.25::DOUBLE * 200000 - coalesce(b.v, 0)) / 200000, greatest(0, 0.4::DOUBLE * 200000 - coalesce(c.v, 0)) / 200000, greatest(0, 0.8::DOUBLE * 200000 - coalesce(d.v, 0)) / 200000)''', 'capacity')}
FROM pos LEFT JOIN a ON a.station_id = pos.station_id AND a.target_date = pos.target_date LEFT JOIN b ON b.station_id = pos.station_id LEFT JOIN c ON c.office = pos.office CROSS JOIN d""")
def _(spark, sf):
    p = B.positions(spark, sf)
    return rounded(X.remaining_capacity(p.select("position_id", "station_id", "target_date", "office"), p, 200000.0).select("position_id", "capacity"))


@query("agg17_portfolio_metrics", T("pos", extra=OBS_SQL + """, dy AS (SELECT office, target_date, sum(pnl_net) AS p, count(*) AS n, count(*) FILTER (WHERE pnl_net > 0) AS w, sum(greatest(pnl_gross, 0)) AS g,
  sum(ceil(0.07::DOUBLE * contracts * entry_price * (1.0 - entry_price) * 100.0)) AS f, sum(contracts) AS c, sum(contracts + position_id % 7) AS o FROM sn GROUP BY 1, 2)""") + f"""
SELECT office, CAST(sum(n) AS BIGINT) AS n_bets, CAST(sum(w) AS BIGINT) AS n_won, CAST(sum(n) - sum(w) AS BIGINT) AS n_lost, {R('sum(p)', 'net_profit')}, {R('sum(g)', 'gross_profit')}, CAST(sum(f) AS BIGINT) AS total_fees,
 {R('sum(w) / sum(n)', 'hit_rate')}, {R('avg(p) / nullif(stddev_samp(p), 0)', 'sharpe')}, {R('sum(c) / nullif(sum(o), 0)', 'edge_utilisation')}, {R('sum(f) / nullif(sum(g), 0)', 'fee_drag')} FROM dy GROUP BY 1""")
def _(spark, sf):
    s = settled(spark, sf).withColumn("offered", F.expr("contracts + position_id % 7"))
    return rounded(PF.portfolio_metrics(s, ["office"]))


@query("agg17_rolling_sharpe", T("pos", extra=OBS_SQL + ", dy AS (SELECT office, target_date, sum(pnl_net) AS p FROM sn GROUP BY 1, 2)") + f"""
SELECT office, target_date, {R('p', 'daily_pnl')}, {R('avg(p) OVER w / nullif(stddev_samp(p) OVER w, 0)', 'sharpe_30')} FROM dy WINDOW w AS (PARTITION BY office ORDER BY target_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return rounded(PF.rolling_sharpe(settled(spark, sf), ["office"]))


@query("agg18_settlement_stats", T("pos", extra=OBS_SQL) + f"""SELECT office, count(*) AS n_total, count(*) FILTER (WHERE outcome = 1) AS n_won, count(*) FILTER (WHERE outcome = 0) AS n_lost, count(*) FILTER (WHERE status = 'OPEN') AS n_open,
 {R('sum(pnl_net)', 'cumulative_pnl')}, {R("sum(CASE WHEN target_date = DATE '1998-06-01' THEN pnl_net ELSE 0 END)", 'daily_pnl')} FROM sn GROUP BY 1""")
def _(spark, sf):
    return rounded(PF.settlement_stats(settled(spark, sf), F.lit("1998-06-01").cast("date"), ["office"]))


EQ_SQL = """dy AS (SELECT office, target_date, sum(pnl_net) AS daily_pnl, count(*) AS n_bets, count(*) FILTER (WHERE outcome = 1) AS n_won FROM sn GROUP BY 1, 2),
 cu AS (SELECT *, sum(daily_pnl) OVER (PARTITION BY office ORDER BY target_date ROWS UNBOUNDED PRECEDING) AS cumulative_pnl FROM dy),
 pk AS (SELECT *, cumulative_pnl + 5000000.0::DOUBLE AS v, greatest(max(cumulative_pnl + 5000000.0::DOUBLE) OVER (PARTITION BY office ORDER BY target_date ROWS UNBOUNDED PRECEDING), 5000000) AS peak FROM cu),
 dd AS (SELECT *, (peak - v) / peak AS drawdown FROM pk)"""


@query("w09_equity_curve", T("pos", extra=OBS_SQL + "," + EQ_SQL) + f"""SELECT office, target_date, n_bets, n_won, {R('daily_pnl', 'daily_pnl')}, {R('cumulative_pnl', 'cumulative_pnl')}, {R('v', 'portfolio_value')}, {R('n_won / n_bets', 'win_rate')}, {R('drawdown', 'drawdown')},
 {R('max(drawdown) OVER (PARTITION BY office ORDER BY target_date ROWS UNBOUNDED PRECEDING)', 'mdd_all')},
 {R('max(drawdown) OVER (PARTITION BY office ORDER BY target_date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW)', 'mdd_90')} FROM dd""")
def _(spark, sf):
    return rounded(PF.equity_curve(settled(spark, sf), ["office"], 5000000.0))


BETS_SQL = CAND_SQL + "," + GATE_SQL + """, bt AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE price END AS vwap, greatest(p - price, 0) AS f_star, p > 0.99 AS veto, edge AND spread_ok AND skill AND lead AND p < 0.5 AS selected FROM gate)"""


@query("agg19_funnel", T("graded", extra=BETS_SQL) + f"""SELECT count(*) AS n_candidates, count(*) FILTER (WHERE edge) AS n_edge, count(*) FILTER (WHERE spread_ok) AS n_spread, count(*) FILTER (WHERE skill) AS n_skill, count(*) FILTER (WHERE lead) AS n_lead,
 count(*) FILTER (WHERE edge AND spread_ok AND skill AND lead) AS n_all_gates, count(*) FILTER (WHERE f_star > 0) AS n_kelly, count(*) FILTER (WHERE veto) AS n_vetoed, count(*) FILTER (WHERE selected) AS n_selected,
 {R('avg(CASE WHEN vwap > 0 THEN p - price END)', 'avg_edge')}, {R('max(CASE WHEN vwap > 0 THEN p - price END)', 'max_edge')}, count(*) FILTER (WHERE vwap > 0) AS n_priced,
 CASE WHEN count(*) FILTER (WHERE selected) > 0 THEN NULL ELSE 'lost' END AS bottleneck FROM bt""")
def _(spark, sf):
    g = X.evaluate_gates(candidates(spark, sf)).selectExpr(
        "*", "CASE WHEN o_orderkey % 4 <> 0 THEN price END AS vwap", "greatest(p - price, 0) AS f_star", "p > 0.99 AS veto", "all_pass AND p < 0.5 AS selected")
    return rounded(X.funnel(g))


@query("top01_first", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 1")
def _(spark, sf):
    return O.first_by(B.events(spark, sf).select("event_id", "value"), [F.col("value").desc(), F.col("event_id")])


@query("top02_top_n_edges", T("graded") + f"SELECT o_orderkey, {R('p - price', 'edge')} FROM graded ORDER BY p - price DESC, o_orderkey LIMIT 5")
def _(spark, sf):
    g = B.graded(spark, sf).withColumn("edge", F.col("p") - F.col("price"))
    return rounded(O.top_n(g, 5, [F.col("edge").desc(), F.col("o_orderkey")]).select("o_orderkey", "edge"))


@query("top03_best_bin", T("graded", extra="""
b AS (SELECT *, 'T' || o_orderkey::VARCHAR AS ticker, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN price END, CASE WHEN o_orderkey % 3 = 0 THEN price + 0.01::DOUBLE END, CASE WHEN o_orderkey % 5 = 0 THEN price - 0.01::DOUBLE END) AS c FROM graded),
r AS (SELECT * FROM b WHERE p > 0.2 AND c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station_id, target_date, target_type ORDER BY p DESC, ticker) = 1)""") + f"""
SELECT ticker, station_id, target_date, target_type, {R('c', 'price')}, CAST(greatest(1, floor(0.01::DOUBLE * 1000 / greatest(c, 0.01))) AS BIGINT) AS contracts, {R('(p - c) * 100', 'ev_net')} FROM r""")
def _(spark, sf):
    c = candidates(spark, sf).drop("price", "target_type").join(B.graded(spark, sf).select("o_orderkey", "price", "target_type"), "o_orderkey")
    c = c.selectExpr("ticker", "station_id", "target_date", "target_type", "p_win", "CASE WHEN o_orderkey % 2 = 0 THEN price END AS yes_ask",
                     "CASE WHEN o_orderkey % 3 = 0 THEN price + 0.01D END AS last_price", "CASE WHEN o_orderkey % 5 = 0 THEN price - 0.01D END AS yes_bid")
    return rounded(X.best_bin(c).select("ticker", *V.GROUP, "price", "contracts", "ev_net"))


ALERT_SQL = """al AS (SELECT event_id AS alert_id, event_type AS alert_type, user_id % 20 AS station_id, value / 500.0 AS severity, ts AS alert_ts, event_id % 3 = 0 AS is_resolved FROM events)"""


def alerts(spark, sf):
    return B.events(spark, sf).selectExpr(
        "event_id AS alert_id", "event_type AS alert_type", "user_id % 20 AS station_id", "value / 500.0D AS severity", "ts AS alert_ts", "event_id % 3 = 0 AS is_resolved",
        "CASE WHEN event_id % 3 = 0 THEN ts END AS resolved_ts")


@query("top04_open_alerts", f"WITH {ALERT_SQL} SELECT alert_id, alert_type, {R('severity', 'severity')}, alert_ts FROM al WHERE NOT is_resolved AND severity >= 0.2 ORDER BY alert_ts DESC, alert_id DESC LIMIT 20")
def _(spark, sf):
    return rounded(M.open_alerts(alerts(spark, sf), 20, 0.2).select("alert_id", "alert_type", "severity", "alert_ts"))


@query("top05_nulls_first", f"SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END ASC NULLS FIRST, event_id) AS INT) AS pos FROM events")
def _(spark, sf):
    # positions by block-wise counts: one user may own much of the table
    e = B.events(spark, sf).select("event_id", "user_id", F.expr("CASE WHEN event_id % 4 <> 0 THEN value END").alias("edge"))
    return O.positions(e, ["user_id"], "edge", ["event_id"], nulls="first").select("event_id", F.col("pos").cast("int").alias("pos"))


@query("top06_tail_n", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 90")
def _(spark, sf):
    return O.tail_n(B.events(spark, sf), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 90).select("event_id", "user_id")


@query("set01_union_all", "SELECT c_custkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier UNION ALL SELECT p_partkey, 'p' FROM part")
def _(spark, sf):
    t = lambda n, k, s: B.table(spark, sf, n).select(F.col(k).alias("k"), F.lit(s).alias("src"))
    return O.concat(t("customer", "c_custkey", "c"), t("supplier", "s_suppkey", "s"), t("part", "p_partkey", "p"))


@query("set02_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(spark, sf):
    return O.distinct_keys(B.table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("set03_keep_last", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1")
def _(spark, sf):
    return O.keep_last(B.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderdate"], [F.col("o_orderkey").desc()])


@query("set04_minus_keys", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0 AND l_discount = 0)")
def _(spark, sf):
    empty = B.table(spark, sf, "lineitem").filter("l_tax = 0 AND l_discount = 0").withColumnRenamed("l_partkey", "p_partkey")
    return O.minus_keys(B.table(spark, sf, "part").select("p_partkey"), empty, ["p_partkey"])


# ------------------------------------------------------------------ walk-forward and sweeps

WF_SQL = """wd AS (SELECT DISTINCT o_custkey % 20 AS station_id, CAST(o_orderdate AS DATE) AS target_date FROM orders),
 wv AS (SELECT o_custkey % 20 AS station_id, CAST(o_orderdate AS DATE) AS target_date, max((o_orderkey * 29) % 450 + 0.5::DOUBLE) AS v FROM orders GROUP BY 1, 2),
 wb AS (SELECT station_id, target_date, b.i, CASE WHEN b.i > 0 THEN b.i * 30.0::DOUBLE END AS bl, CASE WHEN b.i < 14 THEN (b.i + 1) * 30.0::DOUBLE END AS bu,
   ((station_id * 31 + b.i * 17 + dayofyear(target_date)) % 97 + 1) / 980.0::DOUBLE AS p FROM wd CROSS JOIN range(15) b(i)),
 wg AS (SELECT *, CASE WHEN (bl IS NULL OR v >= bl) AND (bu IS NULL OR v < bu) THEN 1 ELSE 0 END AS o FROM wb JOIN wv USING (station_id, target_date)),
 dd AS (SELECT station_id, target_date, avg((p - o) * (p - o)) AS brier, arg_max({'p': p, 'o': o}, (p, -i)) AS f FROM wg GROUP BY 1, 2),
 dr AS (SELECT *, f.o = 1 AS won, CASE WHEN f.o = 1 THEN (1 - 0.9::DOUBLE * f.p) / (0.9::DOUBLE * f.p) * least((f.p - 0.9::DOUBLE * f.p) / (1 - 0.9::DOUBLE * f.p), 0.1) * 0.93::DOUBLE ELSE -least((f.p - 0.9::DOUBLE * f.p) / (1 - 0.9::DOUBLE * f.p), 0.1) END AS rate FROM dd),
 sp AS (SELECT station_id, min(target_date) AS a, max(target_date) AS b FROM dd GROUP BY 1),
 fo AS (SELECT dr.*, (target_date - a) // 90 + 1 AS fold FROM dr JOIN sp USING (station_id) WHERE (target_date - a) // 90 < greatest(1, least(3, (b - a) // 90)) AND a + CAST((target_date - a) // 90 * 90 + 89 AS INT) <= b AND (target_date - a) % 90 >= 60),
 fr AS (SELECT station_id, CAST(fold AS INT) AS fold, count(*) AS n_days, avg(brier) AS mean_brier, avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) AS win_rate, 1 - avg(brier) / 0.25 AS bss, 1000 * exp(sum(ln(1 + rate))) AS fb,
   list_reduce(list_concat([1000.0::DOUBLE], list(rate ORDER BY target_date)), lambda b, r: b + round_even(b * r, 2)) AS fc FROM fo GROUP BY 1, 2)"""


def ladder_grades(spark, sf):
    o = B.table(spark, sf, "orders")
    key = [F.expr("o_custkey % 20").alias("station_id"), F.to_date("o_orderdate").alias("target_date")]
    v = o.groupBy(*key).agg(F.max(F.expr("(o_orderkey * 29) % 450 + 0.5D")).alias("v"))
    bins = v.select("station_id", "target_date", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i")).selectExpr(
        "station_id", "target_date", "CASE WHEN i > 0 THEN i * 30.0D END AS bin_lower", "CASE WHEN i < 14 THEN (i + 1) * 30.0D END AS bin_upper",
        "((station_id * 31 + i * 17 + dayofyear(target_date)) % 97 + 1) / 980.0D AS p_win")
    return WF.grade_bins(bins, v, ["station_id", "target_date"], "v")


@query("kal06_walk_forward", "WITH " + WF_SQL + f" SELECT station_id, fold, n_days, {R('mean_brier', 'mean_brier')}, {R('win_rate', 'win_rate')}, {R('bss', 'bss')}, {R('fb', 'final_bankroll')}, {R('fb - 1000', 'pnl')} FROM fr")
def _(spark, sf):
    return rounded(WF.walk_forward(ladder_grades(spark, sf), ["station_id"]))


@query("kal06_walk_forward_all", "WITH " + WF_SQL.replace("least(3,", "least(100,") + f" SELECT station_id, fold, n_days, {R('mean_brier', 'mean_brier')}, {R('fb', 'final_bankroll')} FROM fr")
def _(spark, sf):
    """As many folds as the history has, not only its first three."""
    return rounded(WF.walk_forward(ladder_grades(spark, sf), ["station_id"], folds=100).select("station_id", "fold", "n_days", "mean_brier", "final_bankroll"))


@query("kal06_walk_forward_cents", "WITH " + WF_SQL + f" SELECT station_id, fold, {R('fc', 'final_bankroll')} FROM fr")
def _(spark, sf):
    return rounded(WF.walk_forward(ladder_grades(spark, sf), ["station_id"], cents=True).select("station_id", "fold", "final_bankroll"))


@query("kal06_acceptance", "WITH " + WF_SQL + f""" SELECT station_id, count(*) AS n_folds, {R('avg(bss)', 'avg_bss')}, {R('avg(mean_brier)', 'avg_brier')}, {R('sum(fb - 1000)', 'total_pnl')},
 CASE WHEN avg(bss) >= 0.05 AND avg(mean_brier) <= 0.22 AND sum(fb - 1000) >= 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM fr GROUP BY 1""")
def _(spark, sf):
    return rounded(WF.acceptance(WF.walk_forward(ladder_grades(spark, sf), ["station_id"]), ["station_id"]))


SWEEP_VALUES = WF.grid_around(0.4)


@query("kal07_param_sweep", T("graded", extra=f"""
gv AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in sorted({*SWEEP_VALUES, 0.4}))}]) AS w),
l AS (SELECT station_id, w, avg((w * p + (1 - w) * price - outcome) * (w * p + (1 - w) * price - outcome)) AS m, count(*) AS n FROM graded CROSS JOIN gv GROUP BY 1, 2),
b AS (SELECT *, n * ln(greatest(m, 1e-9) / n) + ln(n) AS bic FROM l),
r AS (SELECT station_id, any_value(n) AS n, arg_min(w, (bic, w)) AS best_value, min(bic) AS best_bic, max(CASE WHEN w = 0.4::DOUBLE THEN bic END) AS current_bic, max(CASE WHEN w = 0.4::DOUBLE THEN m END) AS current_metric, min(m) AS best_metric FROM b GROUP BY 1)""") + f"""
SELECT station_id, n, {R('best_value', 'best_value')}, {R('best_bic', 'best_bic')}, {R('current_bic', 'current_bic')}, {R('current_metric', 'current_metric')}, {R('best_metric', 'best_metric')},
 best_value <> 0.4::DOUBLE AND best_bic < current_bic AS accepted, {R('CASE WHEN best_value <> 0.4::DOUBLE AND best_bic < current_bic THEN best_value ELSE 0.4 END', 'new_value')} FROM r""")
def _(spark, sf):
    # udf01: the loss is the caller's function of the parameter column
    def loss(w):
        return S.brier(w * F.col("p") + (1 - w) * F.col("price"), F.col("outcome"))

    return rounded(WF.param_sweep(B.graded(spark, sf), ["station_id"], 0.4, loss))


@query("udf01_pluggable_metric", T("graded", extra="""
gv AS (SELECT unnest([0.25, 0.3, 0.5, 0.75, 0.9]::DOUBLE[]) AS w),
l AS (SELECT target_type, w, sum(abs(w * p - outcome)) AS s FROM graded CROSS JOIN gv GROUP BY 1, 2)""") + f"SELECT target_type, {R('arg_min(w, (s, w))', 'w')}, {R('min(s)', 'objective')} FROM l GROUP BY 1")
def _(spark, sf):
    from brierworks.operators.joins import sweep, sweep_best

    by = ["target_type"]
    out = sweep(B.graded(spark, sf), by, [0.25, 0.3, 0.5, 0.75, 0.9], lambda w: F.abs(w * F.col("p") - F.col("outcome")), "w")
    return rounded(sweep_best(out, by, "w"))


# ------------------------------------------------------------------ monitoring

METRIC_SQL = EQ_SQL.replace("office, ", "").replace("PARTITION BY office ", "").replace("GROUP BY 1, 2", "GROUP BY 1").replace("5000000", "20000000") + """,
 fm AS (SELECT target_date AS metric_date, v AS bankroll, max(drawdown) OVER (ORDER BY target_date ROWS UNBOUNDED PRECEDING) AS mdd_all, row_number() OVER (ORDER BY target_date) AS rn,
  count(*) FILTER (WHERE n_bets >= 3) OVER (ORDER BY target_date ROWS UNBOUNDED PRECEDING) AS healthy_days FROM dd)"""


def metrics(spark, sf):
    from pyspark.sql import Window

    curve = PF.equity_curve(settled(spark, sf), [], 20000000.0)
    # one row per calendar day
    run = Window.orderBy("target_date").rowsBetween(Window.unboundedPreceding, 0)
    return curve.select(
        F.col("target_date").alias("metric_date"), F.col("portfolio_value").alias("bankroll"), "mdd_all",
        F.sum(F.when(F.col("n_bets") >= 3, 1).otherwise(0)).over(run).alias("healthy_days"))


@query("mon01_drawdown_status", T("pos", extra=OBS_SQL + "," + METRIC_SQL) + f"""SELECT metric_date, {R('mdd_all', 'mdd_all')}, CASE WHEN mdd_all >= 0.2 THEN 'HALT' WHEN mdd_all >= 0.1 THEN 'WARNING' ELSE 'OK' END AS status FROM fm ORDER BY metric_date DESC LIMIT 1""")
def _(spark, sf):
    return rounded(M.drawdown_status(metrics(spark, sf)).select("metric_date", "mdd_all", "status"))


@query("mon02_risk_off", T("pos", extra=OBS_SQL + "," + METRIC_SQL + """, rs AS (SELECT *, concat_ws(' | ', CASE WHEN mdd_all >= 0.2 THEN 'drawdown' END, CASE WHEN bankroll <= 5 THEN 'bankroll' END, CASE WHEN healthy_days < 30 THEN 'warmup' END) AS r FROM fm),
 rf AS (SELECT *, r <> '' AS off FROM rs)""") + """SELECT metric_date, CASE WHEN r = '' THEN 'NOMINAL' ELSE r END AS reason, off AS offline,
 CASE WHEN off AND NOT lag(off, 1, false) OVER (ORDER BY metric_date) THEN 'SYSTEM_OFFLINE' WHEN NOT off AND lag(off, 1, false) OVER (ORDER BY metric_date) THEN 'SYSTEM_RECOVERY' END AS alert_type FROM rf""")
def _(spark, sf):
    return M.risk_off(metrics(spark, sf)).select("metric_date", "reason", "offline", "alert_type")


@query("mon03_build_alerts", f"""WITH {ALERT_SQL} SELECT alert_id, alert_type, '{{"station_id":' || station_id::VARCHAR || ',"alert_type":"' || alert_type || '"}}' AS details FROM al a
 WHERE is_resolved AND NOT EXISTS (SELECT 1 FROM al o WHERE NOT o.is_resolved AND o.severity >= 0.3 AND o.station_id = a.station_id AND o.alert_type = a.alert_type)""")
def _(spark, sf):
    a = alerts(spark, sf)
    live = a.filter(~F.col("is_resolved") & (F.col("severity") >= 0.3))
    return M.build_alerts(a.filter("is_resolved"), ["station_id", "alert_type"], live, ["station_id", "alert_type"]).select("alert_id", "alert_type", "details")


@query("mon04_collection_status", f"""WITH c AS (SELECT event_id % 12 AS feed, count(*) FILTER (WHERE event_id % 8 IN (3, 4, 5, 7)) AS n_good, count(*) FILTER (WHERE event_id % 8 NOT IN (3, 4, 5, 7)) AS n_bad FROM events GROUP BY 1)
 SELECT feed, n_good, n_bad, {R('n_bad / nullif(n_good + n_bad, 0)', 'failure_rate')}, CASE WHEN n_good = 0 THEN 'ERROR' WHEN n_bad / nullif(n_good + n_bad, 0) >= 0.5 THEN 'PARTIAL' ELSE 'OK' END AS status FROM c""")
def _(spark, sf):
    from brierworks.plans.source_queries import payload_docs
    from brierworks.sources import payloads as PL

    good, bad = PL.ingest_payloads(payload_docs(spark, sf))
    seen = good.select("event_id", F.lit(1).alias("ok")).unionByName(bad.select("event_id", F.lit(0).alias("ok"))).distinct()
    c = seen.groupBy(F.expr("event_id % 12").alias("feed")).agg(F.sum("ok").alias("n_good"), F.sum(1 - F.col("ok")).alias("n_bad"))
    return rounded(M.collection_status(c, ["feed"]))


@query("mon05_health_report", T("st", "rd", "pos", extra=OBS_SQL + "," + METRIC_SQL + "," + ALERT_SQL + """,
hs AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events), sp AS (SELECT min(h) AS a, max(h) AS b FROM hs),
mr AS (SELECT count(*) AS n FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS h FROM sp) e WHERE h NOT IN (SELECT h FROM hs)),
ss AS (SELECT count(*) AS n FROM (SELECT station_id FROM st LEFT JOIN rd USING (station_id) GROUP BY 1 HAVING max(ts) IS NULL OR max(ts) < TIMESTAMP '2024-01-30 22:00:00')),
oa AS (SELECT count(*) AS n FROM al WHERE NOT is_resolved AND severity >= 0.7),
hl AS (SELECT count(*) AS n FROM (SELECT mdd_all FROM fm ORDER BY metric_date DESC LIMIT 1) WHERE mdd_all >= 0.2),
ck AS (SELECT 'missed_runs' AS "check", n AS n_found, n < 1 AS ok, true AS decides FROM mr UNION ALL SELECT 'stale_stations', n, n < 5, false FROM ss UNION ALL SELECT 'drawdown_halt', n, n < 1, true FROM hl UNION ALL SELECT 'open_alerts', n, n < 5, true FROM oa)""") + 'SELECT "check", n_found, ok, (SELECT bool_and(ok OR NOT decides) FROM ck) AS healthy FROM ck')
def _(spark, sf):
    from brierworks.operators import joins as J

    hours = B.events(spark, sf).select(F.date_trunc("hour", "ts").alias("h"))
    span = hours.agg(F.sequence(F.min("h"), F.max("h"), F.expr("interval 1 hour")).alias("hs"))
    missed = J.missed_runs(span.select(F.explode("hs").alias("h")), hours, ["h"])
    stale = J.stale_keys(B.stations(spark, sf), B.readings(spark, sf), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 120)
    severe = alerts(spark, sf).filter(~F.col("is_resolved") & (F.col("severity") >= 0.7))
    halted = M.drawdown_status(metrics(spark, sf)).filter("status = 'HALT'")
    return M.health_report(("missed_runs", missed, 1, True), ("stale_stations", stale, 5, False), ("drawdown_halt", halted, 1, True), ("open_alerts", severe, 5, True))
