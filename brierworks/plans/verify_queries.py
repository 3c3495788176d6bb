"""Projections, joins, aggregates and skill queries on the bound tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from brierworks.functions import scalar as S
from brierworks.operators import joins as J, ordering as O, series as W, verification as V
from brierworks.params import DEFAULTS
from brierworks.plans import bindings as B
from brierworks.plans.bindings import with_tables as T
from brierworks.plans.registry import R, query, r6, rounded

def asof():
    return F.lit("2024-01-31").cast("date")


def asof_orders():
    return F.lit("2002-01-01").cast("date")


# the orders span seven years; the window covers all of them
WHOLE = replace(DEFAULTS, skill_window_days=4000)


def errors(spark, sf):
    return V.forecast_errors(B.forecasts(spark, sf), B.runs(spark, sf), B.observations(spark, sf))


# ------------------------------------------------------------------ projections

@query("prj01_unpivot_targets", T("obs") + f"""
SELECT station_id, target_date, 'HIGH' AS target_type, {R('observed_high_f', 'observed')} FROM obs WHERE observed_high_f IS NOT NULL
UNION ALL SELECT station_id, target_date, 'LOW', {R('observed_low_f')} FROM obs WHERE observed_low_f IS NOT NULL""")
def _(spark, sf):
    return rounded(V.unpivot_targets(B.observations(spark, sf), ["station_id", "target_date"], "observed_high_f", "observed_low_f", "observed"))


@query("prj02_convert_units", f"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'wmoUnit:degC' WHEN 1 THEN 'unit:fahrenheit' ELSE NULL END AS t_uom,
  {R("CASE WHEN event_id % 3 = 1 THEN value ELSE value * 9.0::DOUBLE / 5.0 + 32.0 END", 'temp_f')},
  {R("CASE event_id % 4 WHEN 0 THEN value * 0.621371::DOUBLE WHEN 1 THEN value * 2.236936::DOUBLE WHEN 2 THEN value * 1.150779::DOUBLE ELSE value END", 'mph')}
FROM events""")
def _(spark, sf):
    t_uom = F.expr("CASE event_id % 3 WHEN 0 THEN 'wmoUnit:degC' WHEN 1 THEN 'unit:fahrenheit' END")
    s_uom = F.expr("CASE event_id % 4 WHEN 0 THEN 'wmoUnit:km_h-1' WHEN 1 THEN 'm/s' WHEN 2 THEN 'Knots' ELSE 'mph' END")
    return B.events(spark, sf).select(
        "event_id", t_uom.alias("t_uom"),
        r6(S.convert_units(F.col("value"), t_uom, "temperature"), "temp_f"),
        r6(S.convert_units(F.col("value"), s_uom, "speed"), "mph"),
    )


@query("prj03_lead_hours", T("fc", "rd", "st", extra="""
pk AS (SELECT s.station_id, s.tz, CAST(timezone(s.tz, timezone('UTC', r.ts)) AS DATE) AS local_date,
  arg_max(r.ts, (r.temp_f, -epoch_us(r.ts))) AS hi_at, arg_min(r.ts, (r.temp_f, epoch_us(r.ts))) AS lo_at
  FROM rd r JOIN st s USING (station_id) GROUP BY 1, 2, 3)""") + f"""
SELECT fc.run_id, fc.station_id, fc.target_date, tt.target_type,
 {R('''(epoch_us(coalesce(CASE WHEN tt.target_type = 'HIGH' THEN pk.hi_at ELSE pk.lo_at END,
   timezone('UTC', timezone(st.tz, CAST(fc.target_date AS TIMESTAMP) + (CASE WHEN tt.target_type = 'HIGH' THEN INTERVAL 15 HOUR ELSE INTERVAL 7 HOUR END)))))
   - epoch_us(fc.issued_at)) / 3600000000.0''', 'lead_hours')}
FROM fc JOIN st USING (station_id) CROSS JOIN (VALUES ('HIGH'), ('LOW')) tt(target_type)
LEFT JOIN pk ON pk.station_id = fc.station_id AND pk.local_date = fc.target_date""")
def _(spark, sf):
    from brierworks.sources.axis import lead_hours

    daily = J.attach_issue(B.forecasts(spark, sf), B.runs(spark, sf)).select("run_id", "station_id", "target_date", "issued_at")
    return rounded(lead_hours(daily, B.readings(spark, sf), B.stations(spark, sf)))


@query("prj04_lead_bracket", """SELECT event_id, (event_id * 7) % 120 - 5 AS hours, CASE WHEN (event_id * 7) % 120 - 5 < 0 THEN NULL
 WHEN (event_id * 7) % 120 - 5 < 12 THEN 'h1' WHEN (event_id * 7) % 120 - 5 < 24 THEN 'h2' WHEN (event_id * 7) % 120 - 5 < 48 THEN 'h3'
 WHEN (event_id * 7) % 120 - 5 < 72 THEN 'h4' ELSE 'h5' END AS bracket FROM events""")
def _(spark, sf):
    h = F.expr("(event_id * 7) % 120 - 5")
    return B.events(spark, sf).select("event_id", h.alias("hours"), S.lead_bracket(h).alias("bracket"))


@query("prj05_preferred_error", T("errb") + f"""SELECT station_id, source_id, target_date, target_type,
 {R("CASE WHEN lead_hours % 3 = 0 THEN e - 1.5 WHEN lead_hours % 3 = 1 THEN e ELSE NULL END", 'e')} FROM errb WHERE lead_hours % 3 <> 2""")
def _(spark, sf):
    fc, o = V.latest_forecasts(B.forecasts(spark, sf), B.runs(spark, sf)), B.observations(spark, sf)
    ids = ["station_id", "source_id", "target_date", "lead_hours"]
    f = V.unpivot_targets(fc, ids, "high_f", "low_f", "f")
    ob = V.unpivot_targets(o, ["station_id", "target_date"], "observed_high_f", "observed_low_f", "o")
    e = F.col("f") - F.col("o")
    # a third of the rows has an adjusted error, a third only the raw one, a third neither
    third = F.col("lead_hours") % 3
    table = f.join(ob, V.GROUP).withColumn("error_adjusted", F.when(third == 0, e - 1.5)).withColumn("error_raw", F.when(third <= 1, e))
    return rounded(V.used_errors(table).select("station_id", "source_id", "target_date", "target_type", "e"))


PRICES = "CASE WHEN event_id % 2 = 0 THEN value END AS yes_ask, CASE WHEN event_id % 3 = 0 THEN value + 1 END AS last_price, CASE WHEN event_id % 5 = 0 THEN value + 2 END AS yes_bid"


@query("prj06_market_price", f"""WITH q AS (SELECT event_id, {PRICES} FROM events)
SELECT event_id, {R('coalesce(yes_ask, last_price, yes_bid)', 'price')} FROM q WHERE coalesce(yes_ask, last_price, yes_bid) IS NOT NULL""")
def _(spark, sf):
    q = B.events(spark, sf).selectExpr("event_id", *[c.strip() for c in PRICES.split(", ")])
    price = S.market_price(F.col("yes_ask"), F.col("last_price"), F.col("yes_bid"))
    return q.select("event_id", r6(price, "price")).filter(F.col("price").isNotNull())


@query("prj07_trailing_window", T("rd") + f"""SELECT station_id, count(*) AS n, {R('avg(temp_f)', 'mean_f')} FROM rd
 WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 90 AND CAST(ts AS DATE) <= DATE '2024-01-31' GROUP BY station_id""")
def _(spark, sf):
    rd = B.readings(spark, sf).withColumn("d", F.to_date("ts"))
    return rounded(S.trailing(rd, "d", asof(), 90).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.avg("temp_f").alias("mean_f")))


@query("prj08_fees_and_ev", T("graded") + f"""SELECT o_orderkey, CAST(ceil(0.07::DOUBLE * price * (1.0 - price) * 100.0) AS BIGINT) AS fee_cents,
 CAST(ceil(0.0175::DOUBLE * (o_orderkey % 40 + 1) * price * (1.0 - price) * 100.0) AS BIGINT) AS order_fee_cents,
 {R('(p - price) * 100.0 - ceil(0.07::DOUBLE * price * (1.0 - price) * 100.0)', 'ev_net')} FROM graded""")
def _(spark, sf):
    g, price = B.graded(spark, sf), F.col("price")
    return g.select(
        "o_orderkey",
        S.contract_fee(price, DEFAULTS.taker_rate).alias("fee_cents"),
        S.order_fee(price, F.expr("o_orderkey % 40 + 1"), DEFAULTS.maker_rate).alias("order_fee_cents"),
        r6(S.net_ev(F.col("p"), price, DEFAULTS.taker_rate), "ev_net"),
    )


@query("prj19_cyclic_day", f"""SELECT o_orderkey, {R('sin(2.0::DOUBLE * pi() * dayofyear(o_orderdate) / 365.25)', 'day_sin')},
 {R('cos(2.0::DOUBLE * pi() * dayofyear(o_orderdate) / 365.25)', 'day_cos')} FROM orders""")
def _(spark, sf):
    s, c = S.cyclic_day(F.col("o_orderdate"))
    return B.table(spark, sf, "orders").select("o_orderkey", r6(s, "day_sin"), r6(c, "day_cos"))


# ------------------------------------------------------------------ joins

@query("j01_attach_issue", T("fc") + f"SELECT run_id, station_id, source_id, target_date, {R('high_f', 'high_f')}, {R('low_f', 'low_f')}, lead_hours, issued_at FROM fc")
def _(spark, sf):
    return rounded(J.attach_issue(B.forecasts(spark, sf), B.runs(spark, sf)))


@query("j02_forecast_errors", T("errb") + f"""SELECT station_id, source_id, target_date, target_type, lead_bracket,
 {R('f_raw', 'f_raw')}, {R('observed', 'observed')}, {R('e', 'error_raw')} FROM errb""")
def _(spark, sf):
    return rounded(errors(spark, sf).drop("error_adjusted"))


GRID_SQL = T("latest", "obs", extra="""
pred AS (SELECT station_id, target_date, b.i AS bin, CASE WHEN b.i = 0 THEN NULL ELSE b.i * 30.0::DOUBLE END AS bin_lower,
  CASE WHEN b.i = 14 THEN NULL ELSE (b.i + 1) * 30.0::DOUBLE END AS bin_upper, tt.target_type,
  ((station_id * 31 + b.i * 17) % 90 + 5) / 100.0::DOUBLE AS p_win
  FROM (SELECT DISTINCT station_id, target_date FROM latest) CROSS JOIN range(15) b(i) CROSS JOIN (VALUES ('HIGH'), ('LOW')) tt(target_type)),
ot AS (SELECT station_id, target_date, 'HIGH' AS target_type, observed_high_f AS observed FROM obs
  UNION ALL SELECT station_id, target_date, 'LOW', observed_low_f FROM obs),
gr AS (SELECT pred.*, observed, CASE WHEN (bin_lower IS NULL OR observed >= bin_lower) AND (bin_upper IS NULL OR observed < bin_upper) THEN 1 ELSE 0 END AS outcome
  FROM pred JOIN ot USING (station_id, target_date, target_type))""")


def bin_predictions(spark, sf):
    """Fifteen bins per forecast station-day and type, with a formula probability."""
    days = B.forecasts(spark, sf).select("station_id", "target_date").distinct()
    bins = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("bin"), F.lit(1).alias("_"))
    both = bins.select("*", F.explode(F.array(F.lit("HIGH"), F.lit("LOW"))).alias("target_type"))
    return both.select(
        "station_id", "target_date", "target_type", "bin",
        F.expr("CASE WHEN bin > 0 THEN bin * 30.0D END").alias("bin_lower"),
        F.expr("CASE WHEN bin < 14 THEN (bin + 1) * 30.0D END").alias("bin_upper"),
        F.expr("((station_id * 31 + bin * 17) % 90 + 5) / 100.0D").alias("p_win"),
    )


@query("j03_grade_predictions", GRID_SQL + f"""SELECT station_id, target_date, target_type, bin, outcome,
 {R('(p_win - outcome) * (p_win - outcome)', 'brier')} FROM gr""")
def _(spark, sf):
    g = V.grade(bin_predictions(spark, sf), B.observations(spark, sf))
    return g.select("station_id", "target_date", "target_type", "bin", "outcome", r6("brier", "brier"))


@query("j04_locate_bin", T("rd", extra="""
bins AS (SELECT DISTINCT station_id, b.i AS bin, CASE WHEN b.i = 0 THEN NULL ELSE b.i * 20.0::DOUBLE + station_id END AS bin_lower,
 CASE WHEN b.i = 9 THEN NULL ELSE (b.i + 1) * 20.0::DOUBLE + station_id END AS bin_upper FROM rd CROSS JOIN range(10) b(i))""") + """
SELECT reading_id, rd.station_id, bin FROM rd JOIN bins ON rd.station_id = bins.station_id
 AND (bin_lower IS NULL OR temp_f >= bin_lower) AND (bin_upper IS NULL OR temp_f < bin_upper)""")
def _(spark, sf):
    rd = B.readings(spark, sf)
    bins = rd.select("station_id").distinct().select("station_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin")).selectExpr(
        "station_id", "bin", "CASE WHEN bin > 0 THEN bin * 20.0D + station_id END AS bin_lower",
        "CASE WHEN bin < 9 THEN (bin + 1) * 20.0D + station_id END AS bin_upper")
    return J.locate_bin(rd, bins, ["station_id"], "temp_f", 20.0, salt=8).select("reading_id", "station_id", F.col("bin").cast("bigint").alias("bin"))


@query("j05_attach_bracket", GRID_SQL.rstrip() + ",\n" + ", ".join([
    B.SQL["err"], B.SQL["errb"], """br AS (SELECT station_id, target_date, target_type, min(lead_bracket) AS lead_bracket FROM errb GROUP BY 1, 2, 3)"""]) + """
SELECT station_id, target_date, target_type, bin, outcome, coalesce(lead_bracket, 'h3') AS lead_bracket FROM gr LEFT JOIN br USING (station_id, target_date, target_type)""")
def _(spark, sf):
    g = V.grade(bin_predictions(spark, sf), B.observations(spark, sf))
    return J.attach_bracket(g, errors(spark, sf)).select("station_id", "target_date", "target_type", "bin", "outcome", "lead_bracket")


@query("j06_attach_latest_snapshot", T("snap") + f"""SELECT p_partkey AS ticker, snapshot_id, snapshot_at, {R('price', 'price')}, {R('depth', 'depth')}
 FROM part LEFT JOIN (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY snapshot_at DESC, snapshot_id DESC) = 1) s ON s.ticker = p_partkey""")
def _(spark, sf):
    preds = B.table(spark, sf, "part").select(F.col("p_partkey").alias("ticker"))
    return rounded(J.attach_latest(preds, B.snapshots(spark, sf).withColumn("depth", F.col("depth").cast("double"))))


@query("j07_asof_state", T("fc", "rd") + f"""SELECT run_id, station_id, issued_at, {R('temp_f', 'last_temp_f')}, reading_id FROM
 (SELECT fc.run_id, fc.station_id, fc.issued_at, rd.temp_f, rd.reading_id FROM fc ASOF LEFT JOIN rd ON fc.station_id = rd.station_id AND fc.issued_at > rd.ts)""")
def _(spark, sf):
    left = J.attach_issue(B.forecasts(spark, sf), B.runs(spark, sf)).select("run_id", "station_id", "issued_at")
    right = B.readings(spark, sf)
    out = J.asof_join(left, right, ["station_id"], "issued_at", "ts", ["temp_f", "reading_id"])
    return rounded(out.withColumnRenamed("temp_f", "last_temp_f"))


@query("j08_in_run", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, sf):
    live = B.table(spark, sf, "orders").filter("o_orderstatus = 'O'").withColumnRenamed("o_orderkey", "l_orderkey")
    return J.in_run(B.table(spark, sf, "lineitem"), live, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("j09_not_held", T("pos") + "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(spark, sf):
    held = B.table(spark, sf, "orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return J.not_held(B.table(spark, sf, "customer").select("c_custkey"), held, "c_custkey")


@query("j10_stale_stations", T("st", "rd") + """SELECT st.station_id, max(ts) AS last_at FROM st LEFT JOIN rd USING (station_id)
 GROUP BY st.station_id HAVING max(ts) IS NULL OR max(ts) < TIMESTAMP '2024-01-30 22:00:00'""")
def _(spark, sf):
    asof = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return J.stale_keys(B.stations(spark, sf), B.readings(spark, sf), asof, 120).select("station_id", "last_at")


@query("j11_attach_dims", T("rd", "st") + f"""SELECT reading_id, {R('temp_f', 'temp_f')}, tz, office, n_name FROM rd LEFT JOIN st USING (station_id)
 LEFT JOIN nation ON n_nationkey = office""")
def _(spark, sf):
    nation = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("office"), "n_name")
    st = B.stations(spark, sf).select("station_id", "tz", "office")
    out = J.attach_dims(B.readings(spark, sf), (st, ["station_id"]), (nation, ["office"]))
    return rounded(out.select("reading_id", "temp_f", "tz", "office", "n_name"))


@query("j13_seasonal_mean", f"""WITH d AS (SELECT o_custkey % 20 AS station_id, dayofyear(o_orderdate) AS d, o_totalprice AS v FROM orders),
 days AS (SELECT i AS doy FROM range(1, 367) t(i))
 SELECT station_id, CAST(doy AS INT) AS doy, {R('avg(v)', 'seasonal_mean')}, count(v) AS n FROM d JOIN days ON abs(doy - d) <= 7 OR abs(doy - d) >= 358 GROUP BY 1, 2""")
def _(spark, sf):
    hist = B.table(spark, sf, "orders").withColumn("station_id", F.expr("o_custkey % 20"))
    return rounded(J.seasonal_mean(hist, ["station_id"], "o_orderdate", "o_totalprice"))


BLEND_GRID = [i / 20 for i in range(21)]


@query("j14_sweep", T("graded") + f"""SELECT station_id, {R('w', 'w')}, {R('sum((w * p + (1 - w) * price - outcome) * (w * p + (1 - w) * price - outcome))', 'objective')}
 FROM graded CROSS JOIN (SELECT i / 20.0::DOUBLE AS w FROM range(21) t(i)) GROUP BY station_id, w""")
def _(spark, sf):
    def loss(w):
        return S.brier(w * F.col("p") + (1 - w) * F.col("price"), F.col("outcome"))

    return rounded(J.sweep(B.graded(spark, sf), ["station_id"], BLEND_GRID, loss, "w"))


@query("j15_align_actuals", T("latest", "obs") + f"""SELECT l.station_id, source_id, l.target_date, {R('high_f', 'high_f')}, {R('observed_high_f', 'observed_high_f')}
 FROM latest l LEFT JOIN obs o ON l.station_id = o.station_id AND l.target_date = o.target_date""")
def _(spark, sf):
    fc = V.latest_forecasts(B.forecasts(spark, sf), B.runs(spark, sf))
    return rounded(J.align_actuals(fc, B.observations(spark, sf), "left").select("station_id", "source_id", "target_date", "high_f", "observed_high_f"))


@query("j16_exposure_by_office", T("pos", "st") + f"""SELECT st.office, {R('sum(entry_price * contracts)', 'exposure')} FROM pos JOIN st USING (station_id) GROUP BY 1""")
def _(spark, sf):
    return rounded(J.exposure_by_office(B.positions(spark, sf), B.stations(spark, sf).select("station_id", "office")))


SKILL_SQL = T("errb", extra="""
mse AS (SELECT station_id, target_type, source_id, avg(e * e) AS mse FROM errb GROUP BY 1, 2, 3 HAVING count(*) >= 5),
mx AS (SELECT *, count(*) OVER g AS k, max(mse) OVER g AS worst FROM mse WINDOW g AS (PARTITION BY station_id, target_type)),
skill AS (SELECT station_id, target_type, source_id, CASE WHEN k = 1 THEN 1.0 WHEN worst <= 0 THEN 0.0 ELSE greatest(0.0, 1.0 - mse / worst) END AS skill FROM mx)""")


@query("j17_consensus", SKILL_SQL.rstrip() + """,
lf AS (SELECT station_id, target_date, source_id, 'HIGH' AS target_type, high_f AS f FROM latest UNION ALL SELECT station_id, target_date, source_id, 'LOW', low_f FROM latest),
q AS (SELECT lf.*, avg(f) OVER (PARTITION BY station_id, target_date, target_type) AS f_bar FROM lf
  WHERE EXISTS (SELECT 1 FROM skill s WHERE s.station_id = lf.station_id AND s.target_type = lf.target_type AND s.source_id = lf.source_id AND s.skill > 0.03))
""" + f"""SELECT station_id, target_date, target_type, count(*) AS n_qualified, {R('avg(CASE WHEN abs(f - f_bar) <= 25 THEN 1.0 ELSE 0.0 END)', 'hmas')},
 {R('0.7 + 0.6 * avg(CASE WHEN abs(f - f_bar) <= 25 THEN 1.0 ELSE 0.0 END)', 'hmas_mod')} FROM q GROUP BY 1, 2, 3""")
def _(spark, sf):
    from brierworks.operators.ensemble import source_skill

    fc = V.unpivot_targets(V.latest_forecasts(B.forecasts(spark, sf), B.runs(spark, sf)), ["station_id", "target_date", "source_id"], "high_f", "low_f", "f")
    skill = source_skill(errors(spark, sf), by=["station_id", "target_type"])
    return rounded(J.consensus(fc, skill, DEFAULTS.skill_exit, 25.0))


@query("j18_missed_runs", """WITH runs AS (SELECT DISTINCT event_type AS run_type, date_trunc('hour', ts) AS h FROM events),
 span AS (SELECT min(date_trunc('hour', ts)) AS a, max(date_trunc('hour', ts)) AS b FROM events),
 exp AS (SELECT run_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS h FROM (SELECT DISTINCT run_type FROM runs) CROSS JOIN span)
 SELECT run_type, h FROM exp WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_type = exp.run_type AND r.h = exp.h)""")
def _(spark, sf):
    hours = B.events(spark, sf).select(F.col("event_type").alias("run_type"), F.date_trunc("hour", "ts").alias("h"))
    span = hours.agg(F.sequence(F.min("h"), F.max("h"), F.expr("interval 1 hour")).alias("hs"))
    expected = hours.select("run_type").distinct().withColumn("h", F.explode(span.scalar()))
    return J.missed_runs(expected, hours, ["run_type", "h"]).withColumn("h", F.col("h").cast("timestamp_ntz"))


# ------------------------------------------------------------------ aggregates

WINDOWS = (2, 3, 7, 14, 30, 90)


@query("agg01_dashboard", T("errb", extra="""
w AS (SELECT errb.*, win.window_days FROM errb JOIN (VALUES (2), (3), (7), (14), (30), (90)) win(window_days)
  ON target_date >= DATE '2024-01-31' - window_days AND target_date <= DATE '2024-01-31'),
m AS (SELECT station_id, source_id, target_type, lead_bracket, window_days, count(e) AS n, avg(e) AS mu FROM w GROUP BY 1, 2, 3, 4, 5),
mm AS (SELECT w.station_id, w.source_id, w.target_type, w.lead_bracket, w.window_days, any_value(n) AS n,
  CASE WHEN any_value(n) < 3 OR avg(pow(e - mu, 2)) < 1e-18 THEN 0 ELSE avg(pow(e - mu, 3)) / pow(avg(pow(e - mu, 2)), 1.5) END AS g
  FROM w JOIN m USING (station_id, source_id, target_type, lead_bracket, window_days) GROUP BY 1, 2, 3, 4, 5)""") + f"""
SELECT station_id, source_id, target_type, lead_bracket, window_days, count(e) AS n, {R('avg(e)', 'bias')}, {R('avg(abs(e))', 'mae')}, {R('sqrt(avg(e * e))', 'rmse')},
 {', '.join(R(f'quantile_cont(e, {q / 100})', f'p{q}') for q in (10, 25, 50, 75, 90))},
 {R('avg(CASE WHEN abs(e) <= 0.5 THEN 1.0 ELSE 0 END)', 'pct_within_05')}, {R('avg(CASE WHEN abs(e) <= 1 THEN 1.0 ELSE 0 END)', 'pct_within_1')},
 {R('avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END)', 'pct_over')}, {R('avg(CASE WHEN e < 0 THEN 1.0 ELSE 0 END)', 'pct_under')},
 {R('any_value(mm.g)', 'skew_biased')},
 {R('''CASE WHEN any_value(mm.n) < 3 THEN 0 WHEN abs(sqrt(any_value(mm.n) * (any_value(mm.n) - 1.0::DOUBLE)) / (any_value(mm.n) - 2) * any_value(mm.g)) < 2 * sqrt(6.0::DOUBLE / any_value(mm.n)) THEN 0
   ELSE sqrt(any_value(mm.n) * (any_value(mm.n) - 1.0::DOUBLE)) / (any_value(mm.n) - 2) * any_value(mm.g) END''', 'skew_unbiased')}
FROM w JOIN mm USING (station_id, source_id, target_type, lead_bracket, window_days) GROUP BY 1, 2, 3, 4, 5""")
def error_dashboard(spark, sf):
    first = F.date_sub(asof(), max(WINDOWS))
    used = V.forecast_errors(B.forecasts(spark, sf), B.runs(spark, sf), B.observations(spark, sf), since=first, until=asof(), max_lead_days=16)
    return rounded(V.dashboard(used, asof(), WINDOWS))


MOMENTS = """
m AS (SELECT {by}, count(*) AS n, avg({v}) AS mu FROM {t} GROUP BY {by}),
mm AS (SELECT {by}, any_value(n) AS n, CASE WHEN any_value(n) < 3 OR avg(pow({v} - mu, 2)) = 0 THEN 0 ELSE avg(pow({v} - mu, 3)) / pow(avg(pow({v} - mu, 2)), 1.5) END AS g
  FROM {t} JOIN m USING ({by}) GROUP BY {by})"""


@query("agg02_skew", "WITH " + MOMENTS.format(by="l_suppkey", v="l_extendedprice", t="lineitem").strip() + f" SELECT l_suppkey, n, {R('g', 'g')} FROM mm")
def _(spark, sf):
    return rounded(V.skew(B.table(spark, sf, "lineitem"), "l_extendedprice", ["l_suppkey"]))


@query("agg03_robust_skew", "WITH " + MOMENTS.format(by="l_partkey", v="l_extendedprice", t="lineitem").strip() + f""" SELECT l_partkey, n, {R('g', 'g')},
 {R('CASE WHEN n < 3 THEN 0 WHEN abs(sqrt(n * (n - 1.0::DOUBLE)) / (n - 2) * g) < 2 * sqrt(6.0::DOUBLE / n) THEN 0 ELSE sqrt(n * (n - 1.0::DOUBLE)) / (n - 2) * g END', 'g1')} FROM mm""")
def _(spark, sf):
    return rounded(V.robust_skew(B.table(spark, sf, "lineitem"), "l_extendedprice", ["l_partkey"]))


@query("agg04_rmse_by_source", T("errb") + f"SELECT station_id, source_id, target_type, lead_bracket, {R('sqrt(avg(e * e))', 'rmse')}, count(*) AS n FROM errb GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return rounded(V.rmse_by(errors(spark, sf), ["station_id", "source_id", "target_type", "lead_bracket"]))


@query("agg05_pooled_rmse", T("errb") + f"SELECT target_type, lead_bracket, {R('sqrt(avg(e * e))', 'rmse')}, count(*) AS n FROM errb GROUP BY 1, 2")
def _(spark, sf):
    return rounded(V.pooled_rmse(errors(spark, sf)))


@query("agg06_robust_sigma", T("errb", extra="""
s AS (SELECT station_id, target_type, target_date, sqrt(avg(e * e)) AS sigma FROM errb GROUP BY 1, 2, 3),
k AS (SELECT * FROM s QUALIFY sigma <= 2.0 * avg(sigma) OVER (PARTITION BY station_id, target_type ORDER BY target_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""") + f"""
SELECT target_type, {R('quantile_cont(sigma, 0.5)', 'sigma_median')}, {R('avg(sigma)', 'sigma_mean')}, count(*) AS n FROM k GROUP BY 1""")
def _(spark, sf):
    daily = V.rmse_by(errors(spark, sf), ["station_id", "target_type", "target_date"]).withColumnRenamed("rmse", "sigma").drop("n")
    return rounded(V.robust_sigma(daily, ["station_id", "target_type"], ["target_type"]))


@query("agg07_shrink_sigma", T("errb", extra="""
c AS (SELECT station_id, target_type, lead_bracket, sqrt(avg(e * e)) AS rmse, count(*) AS n FROM errb GROUP BY 1, 2, 3),
pl AS (SELECT target_type, lead_bracket, sqrt(avg(e * e)) AS pooled FROM errb GROUP BY 1, 2)""") + f"""
SELECT station_id, target_type, lead_bracket, n, {R('rmse', 'rmse')}, {R('pooled', 'pooled')}, {R('greatest((n * rmse + 20.0::DOUBLE * pooled) / (n + 20.0::DOUBLE), 0.1)', 'sigma_adj')}
FROM c JOIN pl USING (target_type, lead_bracket)""")
def _(spark, sf):
    return rounded(V.shrink_sigma(errors(spark, sf)))


@query("agg07_shrink_sigma_asof", T("errb", extra="""
er AS (SELECT * FROM errb WHERE target_date >= DATE '2024-01-20' - 90 AND target_date < DATE '2024-01-20'),
c AS (SELECT station_id, target_type, lead_bracket, sqrt(avg(e * e)) AS rmse, count(*) AS n FROM er GROUP BY 1, 2, 3),
pl AS (SELECT target_type, lead_bracket, sqrt(avg(e * e)) AS pooled FROM er GROUP BY 1, 2)""") + f"""
SELECT station_id, target_type, lead_bracket, n, {R('greatest((n * rmse + 20.0::DOUBLE * pooled) / (n + 20.0::DOUBLE), 0.1)', 'sigma_adj')} FROM c JOIN pl USING (target_type, lead_bracket)""")
def _(spark, sf):
    out = V.shrink_sigma(errors(spark, sf), asof=F.lit("2024-01-20").cast("date"))
    return rounded(out.select("station_id", "target_type", "lead_bracket", "n", "sigma_adj"))


@query("agg11_brier_by_day", T("graded") + f"SELECT target_date, target_type, count(*) AS n, {R('avg((p - outcome) * (p - outcome))', 'brier')} FROM graded GROUP BY 1, 2")
def _(spark, sf):
    score = F.avg(S.brier(F.col("p"), F.col("outcome"))).alias("brier")
    return rounded(B.graded(spark, sf).groupBy("target_date", "target_type").agg(F.count(F.lit(1)).alias("n"), score))


MATRIX_SQL = T("graded", extra="""
mx AS (SELECT station_id, target_type, lead_bracket, count(*) AS n, avg((p - outcome) * (p - outcome)) AS bs_model,
  avg((1.0::DOUBLE / 15 - outcome) * (1.0::DOUBLE / 15 - outcome)) AS bs_clim FROM graded GROUP BY 1, 2, 3 HAVING count(*) >= 10),
m AS (SELECT *, CASE WHEN bs_clim > 0 THEN 1.0 - bs_model / bs_clim END AS bss FROM mx)""")


@query("agg12_skill_matrix", MATRIX_SQL + f"SELECT station_id, target_type, lead_bracket, n, {R('bs_model', 'bs_model')}, {R('bs_clim', 'bs_clim')}, {R('bss', 'bss')} FROM m")
def _(spark, sf):
    return rounded(V.skill_matrix(B.graded(spark, sf), asof_orders(), WHOLE))


@query("agg13_market_skill", T("graded") + f"""SELECT station_id, target_type, count(*) AS n, {R('avg((p - outcome) * (p - outcome))', 'bs_model')},
 {R('avg((price - outcome) * (price - outcome))', 'bs_market')},
 {R('CASE WHEN avg((price - outcome) * (price - outcome)) > 0 THEN 1.0 - avg((p - outcome) * (p - outcome)) / avg((price - outcome) * (price - outcome)) END', 'bss_market')} FROM graded GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(V.market_skill(B.graded(spark, sf), ["station_id", "target_type"]))


@query("agg14_calibration", T("graded", extra="""
b AS (SELECT target_type, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(outcome) AS fr FROM graded GROUP BY 1, 2)""") + f"""
SELECT target_type, CAST(sum(n) AS BIGINT) AS n, {R('CASE WHEN sum(n) >= 10 THEN avg(abs(mp - fr)) END', 'calibration_error')} FROM b GROUP BY 1""")
def _(spark, sf):
    return rounded(V.calibration(B.graded(spark, sf), "p", "outcome", ["target_type"]))


@query("agg14_calibration_market", T("graded") + f"""SELECT CAST(least(floor(price * 10), 9) AS INT) AS bucket, count(*) AS n, {R('avg(price)', 'mean_p')}, {R('avg(outcome)', 'freq')} FROM graded GROUP BY 1""")
def _(spark, sf):
    return rounded(V.calibration_bins(B.graded(spark, sf), "price", "outcome"))


DAYS_SQL = """d AS (SELECT station_id, CAST(ts AS DATE) AS local_date, max(temp_f) AS t_max_f, min(temp_f) AS t_min_f, count(temp_f) AS n_valid FROM rd GROUP BY 1, 2 HAVING count(temp_f) >= 3)"""


@query("agg20_daily_extremes", T("rd", extra=DAYS_SQL) + f"SELECT station_id, local_date, {R('t_max_f', 't_max_f')}, {R('t_min_f', 't_min_f')}, n_valid FROM d")
def _(spark, sf):
    rd = B.readings(spark, sf).withColumn("local_date", F.to_date("ts"))
    return rounded(V.daily_extremes(rd, 3))


@query("agg21_day_completeness", T("fc", "obs", extra="""
f AS (SELECT target_date, count(DISTINCT station_id) AS n_forecast FROM fc GROUP BY 1), s AS (SELECT target_date, count(DISTINCT station_id) AS n_scored FROM obs GROUP BY 1)""") + """
SELECT target_date, n_forecast, coalesce(n_scored, 0) AS n_scored, n_forecast > 0 AND coalesce(n_scored, 0) > 0 AS healthy FROM f LEFT JOIN s USING (target_date)""")
def _(spark, sf):
    return V.day_completeness(B.forecasts(spark, sf), B.observations(spark, sf))


@query("agg22_bic", T("errb") + f"""SELECT station_id, target_type, {R('count(*) * ln(sum(e * e) / count(*)) + 1 * ln(count(*))', 'bic')} FROM errb GROUP BY 1, 2""")
def _(spark, sf):
    e = V.used_errors(errors(spark, sf)).groupBy("station_id", "target_type").agg(F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("rss"))
    return rounded(e.select("station_id", "target_type", S.bic(F.col("n"), F.col("rss"), 1).alias("bic")))


@query("agg23_skill_alerts", MATRIX_SQL.rstrip() + """,
wt AS (SELECT station_id, target_type, lead_bracket, CASE WHEN outcome = 1 THEN 'A' ELSE 'B' END AS source_id, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY station_id, target_type, lead_bracket) AS weight, max(target_date) AS computed_at
  FROM graded GROUP BY 1, 2, 3, 4),
top AS (SELECT * FROM wt WHERE computed_at BETWEEN DATE '2001-12-25' - 7 AND DATE '2001-12-25' QUALIFY row_number() OVER (PARTITION BY station_id, target_type, lead_bracket ORDER BY weight DESC, source_id) = 1),
st AS (SELECT *, lag(bss) OVER (PARTITION BY station_id, target_type ORDER BY lead_bracket) AS pb FROM m WHERE bss IS NOT NULL),
dg AS (SELECT station_id, count(*) AS n, bool_and(pb IS NULL OR bss <= pb) AS mono, (arg_max(bss, lead_bracket) - arg_min(bss, lead_bracket)) / nullif(count(*) - 1, 0) AS slope FROM st GROUP BY station_id, target_type)
""" + f"""SELECT 'SKILL_ROW' AS alert_type, {R('0.6', 'severity')}, station_id, NULL::VARCHAR AS lead_bracket, NULL::VARCHAR AS source_id, {R('avg(bss)', 'metric')} FROM m GROUP BY station_id HAVING count(*) >= 3 AND avg(bss) < 0.03
UNION ALL SELECT 'SKILL_COLUMN', {R('0.7')}, NULL, lead_bracket, NULL, {R('avg(bss)')} FROM m GROUP BY lead_bracket HAVING count(*) >= 5 AND avg(bss) < 0.03
UNION ALL SELECT 'SKILL_DIAGONAL', {R('0.4')}, station_id, NULL, NULL, {R('slope')} FROM dg WHERE n >= 3 AND mono AND slope < -0.05
UNION ALL SELECT 'WEIGHT_CONVERGENCE', {R('0.3')}, station_id, lead_bracket, source_id, {R('weight')} FROM top WHERE weight > 0.60""")
def _(spark, sf):
    g = B.graded(spark, sf)
    # weights per cell: share of each outcome class
    share = g.groupBy(*V.CELL, F.expr("CASE WHEN outcome = 1 THEN 'A' ELSE 'B' END").alias("source_id")).agg(F.count(F.lit(1)).alias("c"), F.max("target_date").alias("computed_at"))
    total = share.groupBy(*V.CELL).agg(F.sum("c").alias("t"))
    weights = share.join(total, V.CELL).withColumn("weight", F.col("c") / F.col("t"))
    return rounded(V.skill_alerts(V.skill_matrix(g, asof_orders(), WHOLE), weights, asof=F.lit("2001-12-25").cast("date")))


@query("agg25_forecast_metrics", T("errb") + f"""SELECT source_id, target_type, count(*) AS n, {R('avg(abs(e))', 'mae_raw')}, {R('sqrt(avg(e * e))', 'rmse_raw')}, {R('avg(e)', 'bias_raw')},
 {', '.join(R(f'avg(CASE WHEN abs(e) <= {k} THEN 1.0 ELSE 0 END) * 100', f'within_{k}_raw') for k in (1, 2, 3))},
 {R('avg(abs(e + 5))', 'mae_blend')}, {R('sqrt(avg((e + 5) * (e + 5)))', 'rmse_blend')}, {R('avg(e + 5)', 'bias_blend')},
 {', '.join(R(f'avg(CASE WHEN abs(e + 5) <= {k} THEN 1.0 ELSE 0 END) * 100', f'within_{k}_blend') for k in (1, 2, 3))},
 {R('(avg(abs(e)) - avg(abs(e + 5))) / avg(abs(e)) * 100', 'improvement_blend')} FROM errb GROUP BY 1, 2""")
def _(spark, sf):
    e = errors(spark, sf).withColumn("f_blend", F.col("f_raw") + 5.0)
    return rounded(V.forecast_metrics(e, {"raw": "f_raw", "blend": "f_blend"}, "observed", ["source_id", "target_type"]))


@query("agg26_bias_diagnostics", T("errb", extra="""
q AS (SELECT target_type, quantile_cont(observed, 0.33) AS c, quantile_cont(observed, 0.66) AS h FROM errb GROUP BY 1),
r AS (SELECT errb.*, 'M' || lpad(month(target_date)::VARCHAR, 2, '0') AS m, CASE WHEN observed <= c THEN 'Cold' WHEN observed <= h THEN 'Normal' ELSE 'Hot' END AS t FROM errb JOIN q USING (target_type))""") + f"""
SELECT target_type, m AS segment, count(*) AS n, {R('avg(e)', 'bias')}, {R('avg(abs(e))', 'mae')} FROM r GROUP BY 1, 2
UNION ALL SELECT target_type, t, count(*), {R('avg(e)')}, {R('avg(abs(e))')} FROM r GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(V.bias_diagnostics(errors(spark, sf), "f_raw", "observed", "target_date", ["target_type"]))


@query("agg27_missingness_bias", T("obs", extra="""
r AS (SELECT a.station_id, a.target_date, a.observed_high_f AS v, b.observed_high_f AS lag1 FROM obs a LEFT JOIN obs b ON a.station_id = b.station_id AND b.target_date = a.target_date - 1),
q AS (SELECT station_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM r GROUP BY 1)""") + f"""
SELECT station_id, count(*) FILTER (WHERE v <= lo OR v >= hi) AS n_extreme, {R('avg(CASE WHEN lag1 IS NULL THEN 1.0 ELSE 0 END) FILTER (WHERE v <= lo OR v >= hi)', 'extreme_rate')},
 {R('avg(CASE WHEN lag1 IS NULL THEN 1.0 ELSE 0 END) FILTER (WHERE NOT (v <= lo OR v >= hi))', 'normal_rate')},
 avg(CASE WHEN lag1 IS NULL THEN 1.0 ELSE 0 END) FILTER (WHERE v <= lo OR v >= hi) > 1.5 * avg(CASE WHEN lag1 IS NULL THEN 1.0 ELSE 0 END) FILTER (WHERE NOT (v <= lo OR v >= hi)) AS biased
FROM r JOIN q USING (station_id) GROUP BY 1""")
def _(spark, sf):
    lags = W.calendar_lags(B.observations(spark, sf), ["station_id"], "target_date", "observed_high_f", [1])
    return rounded(V.missingness_bias(lags, "observed_high_f", "observed_high_f_lag1", ["station_id"]))


@query("agg28_trial_diagnostics", f"""WITH t AS (SELECT l_suppkey % 20 AS station_id, CASE WHEN l_linenumber % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS target_type, l_shipmode_ AS model,
  l_orderkey * 10 + l_linenumber AS trial_id, l_discount * 100 + l_tax AS value, CASE WHEN l_returnflag = 'R' THEN 'PRUNED' ELSE 'COMPLETE' END AS state,
  greatest(l_quantity, l_linenumber * 9.0::DOUBLE) AS rhi, least(l_quantity, l_linenumber * 9.0::DOUBLE) AS rlo, greatest(1 + l_tax, 1 + l_discount) AS mhi, least(1 + l_tax, 1 + l_discount) AS mlo
  FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem)),
 b AS (SELECT * FROM t WHERE state = 'COMPLETE' QUALIFY row_number() OVER (PARTITION BY station_id, target_type, model ORDER BY value, trial_id) = 1),
 c AS (SELECT station_id, target_type, model, count(*) AS n_trials, count(*) FILTER (WHERE state = 'COMPLETE') AS n_complete FROM t GROUP BY 1, 2, 3)
 SELECT station_id, target_type, model, n_trials, n_complete, trial_id AS best_trial, {R('value', 'best_value')},
  coalesce(rhi - rlo > (rhi + rlo) / 2, false) OR coalesce(mhi - mlo > 0.4::DOUBLE * (mhi + mlo) / 2, false) AS unstable FROM c LEFT JOIN b USING (station_id, target_type, model)""")
def _(spark, sf):
    t = B.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey % 20 AS station_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS target_type", "l_linestatus AS model",
        "l_orderkey * 10 + l_linenumber AS trial_id", "l_discount * 100 + l_tax AS value",
        "CASE WHEN l_returnflag = 'R' THEN 'PRUNED' ELSE 'COMPLETE' END AS state",
        "array(l_quantity, l_linenumber * 9.0D) AS fold_rounds", "array(1 + l_tax, 1 + l_discount) AS fold_mae")
    return rounded(V.trial_diagnostics(t))


@query("agg29_summary_comparison", T("errb", extra="""
c AS (SELECT station_id, source_id, target_type, avg(e) AS bias_raw, avg(e + 5) AS bias_blend, (avg(abs(e)) - avg(abs(e + 5))) / avg(abs(e)) * 100 AS improvement, avg(lead_hours) / 120.0 AS weight FROM errb GROUP BY 1, 2, 3)""") + f"""
SELECT target_type, count(*) AS n_cells, {R('avg(improvement)', 'mean_improvement')}, count(*) FILTER (WHERE improvement < -1e-9) AS n_regressions,
 count(*) FILTER (WHERE weight < 0.05 OR weight > 0.95) AS n_extreme_blend, count(*) FILTER (WHERE abs(bias_blend) > abs(bias_raw)) AS n_bias_growth FROM c GROUP BY 1""")
def _(spark, sf):
    fc = V.unpivot_targets(V.latest_forecasts(B.forecasts(spark, sf), B.runs(spark, sf)), ["station_id", "source_id", "target_date", "lead_hours"], "high_f", "low_f", "f_raw")
    ob = V.unpivot_targets(B.observations(spark, sf), ["station_id", "target_date"], "observed_high_f", "observed_low_f", "observed")
    e = fc.join(ob, V.GROUP).withColumn("f_blend", F.col("f_raw") + 5.0)
    by = ["station_id", "source_id", "target_type"]
    cells = V.forecast_metrics(e, {"raw": "f_raw", "blend": "f_blend"}, "observed", by).withColumnRenamed("improvement_blend", "improvement")
    weights = e.groupBy(*by).agg((F.avg("lead_hours") / 120.0).alias("weight"))
    return rounded(V.summary_comparison(cells.join(weights, by), ["target_type"]))


@query("agg30_depth_coverage", T("snap") + "SELECT ticker, count(*) AS n_snapshots, count(*) FILTER (WHERE depth > 0) AS n_with_depth, count(*) FILTER (WHERE depth <= 0) AS n_empty FROM snap GROUP BY 1")
def _(spark, sf):
    from brierworks.operators.selection import depth_coverage

    return depth_coverage(B.snapshots(spark, sf), ["ticker"])


@query("agg31_group_coverage", T("graded") + """SELECT count(*) AS n_groups, count(*) FILTER (WHERE hit) AS n_surviving FROM
 (SELECT station_id, target_date, target_type, bool_or(p > 0.2) AS hit FROM graded GROUP BY 1, 2, 3)""")
def _(spark, sf):
    return V.group_coverage(B.graded(spark, sf), V.GROUP, F.col("p") > 0.2)


# ------------------------------------------------------------------ windows on skill

@query("w01_latest_per_key", T("latest") + f"SELECT station_id, source_id, target_date, run_id, issued_at, {R('high_f', 'high_f')} FROM latest")
def _(spark, sf):
    return rounded(V.latest_forecasts(B.forecasts(spark, sf), B.runs(spark, sf)).select("station_id", "source_id", "target_date", "run_id", "issued_at", "high_f"))


HYST_SQL = T("graded", extra="""
d AS (SELECT station_id, target_type, target_date, CASE WHEN count(*) % 7 = 6 THEN NULL ELSE avg(p - price) END AS bss FROM graded GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN bss >= 0.07 THEN 1 WHEN bss IS NULL OR bss < 0.03 THEN 0 END AS sig FROM d),
q AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY station_id, target_type ORDER BY target_date ROWS UNBOUNDED PRECEDING), 0) AS q FROM s)""")


@query("w10_hysteresis", HYST_SQL + f"""SELECT station_id, target_type, target_date, {R('bss', 'bss')}, q = 1 AS qualified,
 q = 1 AND lag(q, 1, 0) OVER w = 0 AS entered, q = 0 AND lag(q, 1, 0) OVER w = 1 AS exited FROM q WINDOW w AS (PARTITION BY station_id, target_type ORDER BY target_date)""")
def _(spark, sf):
    daily = B.graded(spark, sf).groupBy("station_id", "target_type", "target_date").agg(
        F.when(F.count(F.lit(1)) % 7 != 6, F.avg(F.col("p") - F.col("price"))).alias("bss"))
    return rounded(V.hysteresis(daily, ["station_id", "target_type"], "target_date"))


@query("w11_lead_ceiling", MATRIX_SQL + "SELECT station_id, target_type, max(CASE WHEN bss >= -0.4 THEN CAST(substr(lead_bracket, 2, 1) AS INT) END) AS h_star FROM m GROUP BY 1, 2")
def _(spark, sf):
    m = V.skill_matrix(B.graded(spark, sf), asof_orders(), WHOLE).withColumn("qualified", F.col("bss") >= -0.4)
    return V.lead_ceiling(m)


@query("w14_monotone_decay", T("graded", extra="""
m AS (SELECT o_orderkey // 5 % 300 AS station_id, target_type, lead_bracket, avg(p - price) AS bss FROM graded GROUP BY 1, 2, 3),
st AS (SELECT *, lag(bss) OVER (PARTITION BY station_id, target_type ORDER BY lead_bracket) AS pb FROM m),
dg AS (SELECT station_id, target_type, count(*) AS n_cells, bool_and(pb IS NULL OR bss <= pb) AS monotone, (arg_max(bss, lead_bracket) - arg_min(bss, lead_bracket)) / nullif(count(*) - 1, 0) AS slope FROM st GROUP BY 1, 2)""") + f"""
SELECT station_id, target_type, n_cells, monotone, {R('slope', 'slope')} FROM dg WHERE n_cells >= 3 AND monotone AND slope < -0.05""")
def _(spark, sf):
    cells = B.graded(spark, sf).withColumn("station_id", F.expr("(o_orderkey div 5) % 300")).groupBy("station_id", "target_type", "lead_bracket").agg(F.avg(F.col("p") - F.col("price")).alias("bss"))
    return rounded(V.monotone_decay(cells))
