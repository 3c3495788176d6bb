"""Series, ensemble, bias and pricing queries on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brierworks.functions import normal, scalar as S
from brierworks.operators import bias as K, ensemble as E, joins as J, pricing as P, series as W, verification as V
from brierworks.params import DEFAULTS
from brierworks.plans import bindings as B
from brierworks.plans.bindings import with_tables as T
from brierworks.sources import tables as TB
from brierworks.plans.registry import R, query, r6, rounded
from brierworks.plans.verify_queries import SKILL_SQL, errors
from brierworks.session import cut_lineage


def latest_rows(spark, sf):
    """Latest forecast per source as group rows, aged against the end of the target day."""
    fc = V.latest_forecasts(B.forecasts(spark, sf), B.runs(spark, sf))
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.col("target_date")).cast("double") * 6.0
    rows = fc.withColumn("age_hours", age).withColumn("lead_bracket", S.lead_bracket(F.col("lead_hours")))
    return V.unpivot_targets(rows, ["station_id", "target_date", "source_id", "lead_bracket", "age_hours"], "high_f", "low_f", "f")


ROWS_SQL = """
lr AS (SELECT station_id, target_date, source_id, tt.target_type, CASE WHEN tt.target_type = 'HIGH' THEN high_f ELSE low_f END AS f,
  CASE WHEN lead_hours < 12 THEN 'h1' WHEN lead_hours < 24 THEN 'h2' WHEN lead_hours < 48 THEN 'h3' WHEN lead_hours < 72 THEN 'h4' ELSE 'h5' END AS lead_bracket,
  date_diff('day', target_date, DATE '2024-01-31') * 6.0::DOUBLE AS age_hours
  FROM latest CROSS JOIN (VALUES ('HIGH'), ('LOW')) tt(target_type))"""


# ------------------------------------------------------------------ series

SERIES_SQL = T("obs", extra="""
sp AS (SELECT station_id, min(target_date) AS a, max(target_date) AS b FROM obs GROUP BY 1),
dd AS (SELECT station_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS target_date FROM sp),
ds AS (SELECT dd.station_id, dd.target_date, observed_high_f AS v FROM dd LEFT JOIN obs USING (station_id, target_date))""")


def daily_values(spark, sf):
    """Observed highs per station and day; sparse stations have gaps."""
    return B.observations(spark, sf).select("station_id", "target_date", F.col("observed_high_f").alias("v"))


@query("w03_calendar_lags", SERIES_SQL + f"""SELECT station_id, target_date, {R('v', 'v')}, {R('lag(v, 1) OVER w', 'v_lag1')}, {R('lag(v, 2) OVER w', 'v_lag2')}
 FROM ds WINDOW w AS (PARTITION BY station_id ORDER BY target_date)""")
def _(spark, sf):
    return rounded(W.calendar_lags(daily_values(spark, sf), ["station_id"], "target_date", "v", [1, 2]))


GAPS_SQL = T("rd", extra="""
hr AS (SELECT station_id, date_trunc('hour', ts) AS h, max(temp_f) AS v FROM rd GROUP BY 1, 2),
sp AS (SELECT station_id, min(h) AS a, max(h) AS b FROM hr GROUP BY 1),
ax AS (SELECT station_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS h FROM sp),
ds AS (SELECT ax.station_id, ax.h, v FROM ax LEFT JOIN hr USING (station_id, h))""")


def hourly_values(spark, sf):
    hr = B.readings(spark, sf).groupBy("station_id", F.date_trunc("hour", "ts").alias("h")).agg(F.max("temp_f").alias("v"))
    span = hr.groupBy("station_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    axis = span.select("station_id", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("h"))
    return axis.join(hr, ["station_id", "h"], "left").withColumn("h", F.col("h").cast("timestamp_ntz"))


@query("w04_bounded_ffill", GAPS_SQL + f"""SELECT station_id, h, {R('last_value(v IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'filled')} FROM ds""")
def _(spark, sf):
    df = hourly_values(spark, sf)
    return df.select("station_id", "h", r6(W.ffill(F.col("v"), ["station_id"], "h", 2), "filled"))


@query("w05_rolling_stats", GAPS_SQL + f"""SELECT station_id, h, {R('CASE WHEN count(v) OVER w7 >= 4 THEN avg(v) OVER w7 END', 'm7')}, {R('CASE WHEN count(v) OVER w14 >= 7 THEN avg(v) OVER w14 END', 'm14')},
 {R('CASE WHEN count(v) OVER w7 >= 4 THEN stddev_samp(v) OVER w7 END', 's7')} FROM ds
 WINDOW w7 AS (PARTITION BY station_id ORDER BY h ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY station_id ORDER BY h ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    cols = W.rolling_stats(["station_id"], "h", F.col("v"), {"m7": ("mean", 7, 4), "m14": ("mean", 14, 7), "s7": ("std", 7, 4)})
    return rounded(hourly_values(spark, sf).select("station_id", "h", *cols))



@query("w17_ewm_variance", T("obs", extra="""
s AS (SELECT station_id, target_date, list(observed_high_f) OVER (PARTITION BY station_id ORDER BY target_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS xs FROM obs),
v AS (SELECT *, len(xs) AS n, list_var_pop(xs) AS va, list_var_pop(xs[greatest(1, len(xs) - 19):]) AS vr FROM s),
sp AS (SELECT *, CASE WHEN n < 20 OR va <= 0 THEN 90 WHEN vr / va > 2 THEN 20 ELSE floor(90 - least(vr / va / 2, 1) * 70) END AS span FROM v),
f AS (SELECT *, list_reduce(xs[2:], lambda s, x: {'m': s.m + 2.0::DOUBLE / (span + 1) * (x.m - s.m), 'v': (1 - 2.0::DOUBLE / (span + 1)) * (s.v + 2.0::DOUBLE / (span + 1) * (x.m - s.m) * (x.m - s.m))}, {'m': xs[1].m, 'v': 0.0::DOUBLE}) AS z
  FROM (SELECT station_id, target_date, n, span, list_transform(xs, lambda x: {'m': x, 'v': 0.0::DOUBLE}) AS xs FROM sp))""") + f"""
SELECT station_id, target_date, {R('CASE WHEN n < 2 THEN 0.01 ELSE greatest(z.v, 1e-6) END', 'ewm_var')} FROM f""")
def _(spark, sf):
    return rounded(W.ewm_variance(daily_values(spark, sf), ["station_id"], "target_date", "v").drop("v"))


@query("w18_chrono_split", T("obs", extra="""
r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY target_date) - 1 AS i, count(*) OVER (PARTITION BY station_id) AS n FROM obs)""") + """
SELECT station_id, target_date, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def _(spark, sf):
    return W.chrono_split(daily_values(spark, sf), ["station_id"], "target_date").drop("v")


ORDER_DAYS = """od AS (SELECT o_custkey % 20 AS station_id, CAST(o_orderdate AS DATE) AS target_date, count(*) AS n FROM orders GROUP BY 1, 2)"""


def order_days(spark, sf):
    """Order counts per station and day over seven years."""
    o = B.table(spark, sf, "orders")
    return o.groupBy(F.expr("o_custkey % 20").alias("station_id"), F.to_date("o_orderdate").alias("target_date")).agg(F.count(F.lit(1)).alias("n"))


@query("w18_walk_forward_blocks", f"""WITH {ORDER_DAYS}, r AS (SELECT *, count(*) OVER (PARTITION BY station_id) - row_number() OVER (PARTITION BY station_id ORDER BY target_date) AS back FROM od)
SELECT station_id, target_date, n, CAST(CASE WHEN 6 - back // 45 >= 1 THEN 6 - back // 45 ELSE 0 END AS INT) AS fold FROM r""")
def _(spark, sf):
    return W.walk_forward_blocks(order_days(spark, sf), ["station_id"], "target_date")


@query("w19_walk_forward_folds", f"""WITH {ORDER_DAYS}, s AS (SELECT station_id, min(target_date) AS a, max(target_date) AS b FROM od GROUP BY 1),
 k AS (SELECT od.*, (target_date - a) // 90 AS k, (target_date - a) % 90 AS off, greatest(1, least(3, (b - a) // 90)) AS fit, a + CAST((target_date - a) // 90 * 90 + 89 AS INT) <= b AS whole FROM od JOIN s USING (station_id))
SELECT station_id, target_date, n, CAST(CASE WHEN k < fit AND whole THEN k + 1 END AS INT) AS fold, CASE WHEN k < fit AND whole THEN CASE WHEN off < 60 THEN 'train' ELSE 'test' END END AS role FROM k""")
def _(spark, sf):
    return W.walk_forward_folds(order_days(spark, sf), ["station_id"])


@query("w19_expanding_folds", f"""WITH {ORDER_DAYS}, s AS (SELECT station_id, min(target_date) AS a FROM od GROUP BY 1)
SELECT station_id, target_date, n, CAST(CASE WHEN target_date - a >= 90 THEN (target_date - a - 90) // 30 + 1 END AS INT) AS test_fold FROM od JOIN s USING (station_id)""")
def _(spark, sf):
    return W.expanding_folds(order_days(spark, sf), ["station_id"])


@query("w20_last_five", T("obs") + f"""SELECT station_id, target_date, {R("list_sum(list(observed_high_f) OVER w)", 'sum5')}, CAST(len(list(observed_high_f) OVER w) AS INT) AS n5
 FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY target_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    xs = daily_values(spark, sf).select("station_id", "target_date", W.last_n(["station_id"], "target_date", F.col("v"), 5).alias("xs"))
    return xs.select("station_id", "target_date", r6(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x), "sum5"), F.size("xs").alias("n5"))


# ------------------------------------------------------------------ ensemble

@query("agg08_source_skill", SKILL_SQL.replace("skill AS (", "skill0 AS (").rstrip() + f""" SELECT station_id, target_type, source_id, {R('skill', 'skill')} FROM skill0""")
def _(spark, sf):
    return rounded(E.source_skill(errors(spark, sf), ["station_id", "target_type"]).select("station_id", "target_type", "source_id", "skill"))


SK = T("errb", extra=ROWS_SQL.strip() + """,
mse AS (SELECT station_id, target_type, source_id, avg(e * e) AS mse FROM errb GROUP BY 1, 2, 3 HAVING count(*) >= 5),
mx AS (SELECT *, count(*) OVER g AS k, max(mse) OVER g AS worst FROM mse WINDOW g AS (PARTITION BY station_id, target_type)),
sk AS (SELECT station_id, target_type, source_id, CASE WHEN k = 1 THEN 1.0 WHEN worst <= 0 THEN 0.0 ELSE greatest(0.0, 1.0 - mse / worst) END AS skill FROM mx),
rs AS (SELECT lr.*, coalesce(skill, 0.0)::DOUBLE AS skill FROM lr LEFT JOIN sk USING (station_id, target_type, source_id)),
w1 AS (SELECT *, count(*) OVER g AS m, max(skill) OVER g AS best, exp((skill - max(skill) OVER g) / 0.1::DOUBLE) AS ex,
  row_number() OVER (PARTITION BY station_id, target_date, target_type ORDER BY skill DESC, source_id) AS k FROM rs WINDOW g AS (PARTITION BY station_id, target_date, target_type)),
w2 AS (SELECT *, sum(ex) OVER (PARTITION BY station_id, target_date, target_type ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum FROM w1),
w3 AS (SELECT *, max(CASE WHEN (1 - (m - k) * 0.05::DOUBLE / m) * ex / cum >= 0.05::DOUBLE / m THEN k END) OVER (PARTITION BY station_id, target_date, target_type) AS kk FROM w2),
w4 AS (SELECT *, max(CASE WHEN k = kk THEN cum END) OVER (PARTITION BY station_id, target_date, target_type) AS ss FROM w3),
wt AS (SELECT station_id, target_date, target_type, source_id, f, lead_bracket, age_hours, skill, CASE WHEN best <= 0 OR m = 1 THEN 1.0::DOUBLE / m WHEN k <= kk THEN (1 - (m - kk) * 0.05::DOUBLE / m) * ex / ss ELSE 0.05::DOUBLE / m END AS weight FROM w4),
dc AS (SELECT *, CASE WHEN age_hours > 0 THEN exp(-age_hours / 72.0) ELSE 1.0 END AS fac FROM wt),
dw AS (SELECT station_id, target_date, target_type, source_id, f, lead_bracket, skill, weight * fac / sum(weight * fac) OVER (PARTITION BY station_id, target_date, target_type) AS weight, fac < 0.5 AS is_stale FROM dc)""")


def skilled_rows(spark, sf):
    skill = E.source_skill(errors(spark, sf), ["station_id", "target_type"]).select("station_id", "target_type", "source_id", "skill")
    rows = latest_rows(spark, sf).join(skill, ["station_id", "target_type", "source_id"], "left")
    return rows.withColumn("skill", F.coalesce("skill", F.lit(0.0)))


@query("agg33_entropy_weights", SK + f"SELECT station_id, target_date, target_type, source_id, {R('weight', 'weight')} FROM wt")
def _(spark, sf):
    return rounded(E.entropy_weights(skilled_rows(spark, sf), V.GROUP).select(*V.GROUP, "source_id", "weight"))


@query("agg32_decay_weights", SK + f"SELECT station_id, target_date, target_type, source_id, {R('weight', 'weight')}, is_stale FROM dw")
def _(spark, sf):
    w = E.entropy_weights(skilled_rows(spark, sf), V.GROUP)
    return rounded(E.decay_weights(w, V.GROUP, "age_hours").select(*V.GROUP, "source_id", "weight", "is_stale"))


SPREAD_SQL = SK.rstrip() + """,
sb AS (SELECT *, sum(weight * f) OVER (PARTITION BY station_id, target_date, target_type) AS bar FROM dw),
spr AS (SELECT station_id, target_date, target_type, count(*) AS m_k, max(bar) AS f_bar, CASE WHEN count(*) <= 1 THEN 0 ELSE stddev_samp(f) END AS s_unweighted,
  CASE WHEN count(*) <= 1 THEN 0 ELSE sqrt(sum(weight * (f - bar) * (f - bar))) END AS s_weighted FROM sb GROUP BY 1, 2, 3)
"""


@query("agg09_ensemble_spread", SPREAD_SQL + f"SELECT station_id, target_date, target_type, m_k, {R('f_bar', 'f_bar')}, {R('s_unweighted', 's_unweighted')}, {R('s_weighted', 's_weighted')} FROM spr")
def _(spark, sf):
    w = E.decay_weights(E.entropy_weights(skilled_rows(spark, sf), V.GROUP), V.GROUP, "age_hours")
    return rounded(E.ensemble_spread(w, V.GROUP))


@query("agg10_sigma_eff", SPREAD_SQL + f"SELECT station_id, target_date, target_type, {R('greatest(sqrt(m_k * m_k + 0.5::DOUBLE * s_weighted * s_weighted) * 1.15::DOUBLE, 0.1)', 'sigma_eff')} FROM spr")
def _(spark, sf):
    w = E.decay_weights(E.entropy_weights(skilled_rows(spark, sf), V.GROUP), V.GROUP, "age_hours")
    s = E.ensemble_spread(w, V.GROUP)
    return s.select(*V.GROUP, r6(S.sigma_eff(F.col("m_k").cast("double"), F.col("s_weighted"), 1.15), "sigma_eff"))


@query("w02_top_source", SK + f"""SELECT station_id, target_date, target_type, source_id, {R('f', 'f')}, {R('skill', 'skill')} FROM rs
 QUALIFY row_number() OVER (PARTITION BY station_id, target_date, target_type ORDER BY skill DESC, source_id) = 1""")
def _(spark, sf):
    return rounded(E.top_source(skilled_rows(spark, sf), V.GROUP).select(*V.GROUP, "source_id", "f", "skill"))


BIMODAL_SQL = """
gv AS (SELECT {keys}, list_sort(list({f})) AS v, max(s) AS s FROM {t} GROUP BY {keys}),
bi AS (SELECT *, len(v) AS n, CASE WHEN len(v) >= 4 AND s > 0 THEN (v[3 * len(v) // 4 + 1] - v[len(v) // 4 + 1]) / s END AS ratio FROM gv),
it AS (SELECT *, list_reduce(list_transform(range(51), lambda i: {{'a': v[len(v) // 4 + 1], 'b': v[3 * len(v) // 4 + 1]}}),
  lambda c, i: CASE WHEN len(list_filter(v, lambda x: abs(x - c.a) <= abs(x - c.b))) > 0 AND len(list_filter(v, lambda x: abs(x - c.a) > abs(x - c.b))) > 0
   THEN {{'a': list_avg(list_filter(v, lambda x: abs(x - c.a) <= abs(x - c.b))), 'b': list_avg(list_filter(v, lambda x: abs(x - c.a) > abs(x - c.b)))}} ELSE c END) AS c
  FROM bi WHERE ratio > 1.35),
sz AS (SELECT *, len(list_filter(v, lambda x: abs(x - c.a) <= abs(x - c.b))) AS n1 FROM it),
bm AS (SELECT {keys}, least(c.a, c.b) AS centroid_1, greatest(c.a, c.b) AS centroid_2, CAST(CASE WHEN c.a <= c.b THEN n1 ELSE n - n1 END AS INT) AS size_1,
  CAST(CASE WHEN c.a <= c.b THEN n - n1 ELSE n1 END AS INT) AS size_2, ratio AS iqr_ratio FROM sz WHERE abs(c.b - c.a) >= 1.5 * s AND least(n1, n - n1) * 1.0 / n >= 0.15)
"""


@query("agg24_detect_bimodal", T("latest", extra=ROWS_SQL.strip() + """,
gs AS (SELECT *, stddev_samp(f) OVER (PARTITION BY station_id, target_date, target_type) AS s FROM lr),""" + BIMODAL_SQL.format(keys="station_id, target_date, target_type", f="f", t="gs").rstrip()) + f"""
SELECT station_id, target_date, target_type, {R('centroid_1', 'centroid_1')}, {R('centroid_2', 'centroid_2')}, size_1, size_2, {R('iqr_ratio', 'iqr_ratio')} FROM bm""")
def _(spark, sf):
    rows = latest_rows(spark, sf)
    s = rows.groupBy(*V.GROUP).agg(F.stddev_samp("f").alias("s"))
    return rounded(E.detect_bimodal(rows.join(s, V.GROUP), V.GROUP))


# ------------------------------------------------------------------ bias filter

def bias_series(spark, sf):
    return K.daily_errors(errors(spark, sf), ["station_id", "target_type"])


KAL_PREP = T("errb", extra="""
se AS (SELECT station_id, target_type, target_date, -avg(e) AS eps FROM errb GROUP BY 1, 2, 3),
x1 AS (SELECT *, list(eps) OVER (PARTITION BY station_id, target_type ORDER BY target_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS xs,
  row_number() OVER (PARTITION BY station_id, target_type ORDER BY target_date) AS k,
  coalesce(target_date - lag(target_date) OVER (PARTITION BY station_id, target_type ORDER BY target_date) - 1, 0) AS gap FROM se),
x2 AS (SELECT *, CASE WHEN len(xs) >= 2 THEN list_transform(range(1, len(xs)), lambda i: xs[i + 1] - xs[i]) ELSE []::DOUBLE[] END AS ds FROM x1),
x3 AS (SELECT *, len(ds) AS nd, CASE WHEN len(ds) > 0 THEN list_var_pop(ds) ELSE 0 END AS va, CASE WHEN len(ds) > 0 THEN list_var_pop(ds[greatest(1, len(ds) - 19):]) ELSE 0 END AS vr FROM x2),
x4 AS (SELECT *, CASE WHEN nd < 20 OR va <= 0 THEN 90 WHEN vr / va > 2 THEN 20 ELSE floor(90 - least(vr / va / 2, 1) * 70) END AS span,
  list_transform(ds, lambda x: {'m': x, 'v': 0.0::DOUBLE}) AS dm FROM x3),
x5 AS (SELECT *, CASE WHEN nd >= 2 THEN list_reduce(dm[2:], lambda s, x: {'m': s.m + 2.0::DOUBLE / (span + 1) * (x.m - s.m), 'v': (1 - 2.0::DOUBLE / (span + 1)) * (s.v + 2.0::DOUBLE / (span + 1) * (x.m - s.m) * (x.m - s.m))}, {'m': dm[1].m, 'v': 0.0::DOUBLE}).v END AS ev FROM x4),
x6 AS (SELECT *, CASE WHEN len(xs) < 2 THEN NULL WHEN nd < 2 THEN 0.01 ELSE greatest(ev, 1e-6) END AS qa FROM x5),
pr AS (SELECT *, coalesce(last_value(qa IGNORE NULLS) OVER (PARTITION BY station_id, target_type ORDER BY target_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS q_base,
  xs[greatest(1, len(xs) - 4):] AS last5 FROM x6)""").replace("WITH ", "WITH RECURSIVE ", 1)

KAL_SQL = KAL_PREP.rstrip() + """,
kf AS (SELECT station_id, target_type, 0::BIGINT AS k, NULL::DATE AS target_date, 0.0::DOUBLE AS b, 4.0::DOUBLE AS u, 0.0::DOUBLE AS q, 0.0::DOUBLE AS g, 0.0::DOUBLE AS eps FROM (SELECT DISTINCT station_id, target_type FROM pr)
 UNION ALL
 SELECT station_id, target_type, k, target_date, b + up / (up + 0.25) * (eps - b), (1 - up / (up + 0.25)) * up, q, up / (up + 0.25), eps FROM (
  SELECT *, u + q * (1 + 2.0 * gap) AS up FROM (
   SELECT pr.station_id, pr.target_type, pr.k, pr.target_date, pr.eps, pr.gap, kf.b, kf.u,
    pr.q_base + 0.1::DOUBLE * list_sum(list_transform(pr.last5, lambda x: (x - kf.b) * (x - kf.b) * CASE WHEN x < kf.b THEN 1.5 ELSE 1.0 END)) AS q
   FROM kf JOIN pr ON pr.station_id = kf.station_id AND pr.target_type = kf.target_type AND pr.k = kf.k + 1)))
"""


@query("kal01_measurement_noise", T("graded") + f"""SELECT o_orderkey, {R('CASE WHEN price - 0.1 > 0 THEN 0.25::DOUBLE * (1 + 2.0 * greatest(0.0, abs(p - 0.5) / (price - 0.1) - 1)) ELSE 0.25 END', 'r_k')} FROM graded""")
def _(spark, sf):
    return B.graded(spark, sf).select("o_orderkey", r6(S.measurement_noise(F.col("p"), F.lit(0.5), F.col("price") - 0.1), "r_k"))


@query("kal02_process_noise", KAL_PREP.rstrip() + f""" SELECT station_id, target_type, target_date, {R('q_base', 'q_base')}, {R('q_base + 0.1::DOUBLE * list_sum(list_transform(last5, lambda x: (x - 1.0) * (x - 1.0) * CASE WHEN x < 1.0 THEN 1.5 ELSE 1.0 END))', 'q_k')}, CAST(gap AS INT) AS gap_days FROM pr""")
def _(spark, sf):
    prep = K.with_noise(bias_series(spark, sf), ["station_id", "target_type"])
    q = K.process_noise(F.col("q_base"), F.col("last5"), F.lit(1.0))
    return prep.select("station_id", "target_type", "target_date", r6("q_base", "q_base"), r6(q, "q_k"), F.col("gap_days").cast("int").alias("gap_days"))


@query("kal03_kalman_filter", KAL_SQL + f"""SELECT station_id, target_type, target_date, CAST(k AS INT) AS state_version, {R('b', 'b_k')}, {R('u', 'u_k')}, {R('q', 'q_k')}, {R('g', 'k_k')}, {R('eps', 'epsilon')} FROM kf WHERE k > 0""")
def _(spark, sf):
    return rounded(K.kalman_filter(bias_series(spark, sf), ["station_id", "target_type"]).drop("r_k"))


@query("kal04_kalman_replay", KAL_SQL.replace("-avg(e) AS eps", "-avg(e) + CASE WHEN station_id % 4 = 0 AND target_date >= DATE '2024-01-12' AND target_date < DATE '2024-01-14' THEN 7.5 ELSE 0 END AS eps") + f"""
SELECT station_id, target_type, target_date, CAST(k AS INT) AS state_version, {R('b', 'b_k')}, {R('u', 'u_k')}, coalesce(station_id % 4 = 0 AND target_date >= (SELECT min(target_date) FROM pr q WHERE q.station_id = kf.station_id AND q.target_type = kf.target_type AND q.target_date >= DATE '2024-01-12' AND q.target_date < DATE '2024-01-14'), false) AS is_amendment FROM kf WHERE k > 0""")
def _(spark, sf):
    by = ["station_id", "target_type"]
    # the stored tables of a running system: series and history are written once
    series = cut_lineage(bias_series(spark, sf))
    history = cut_lineage(K.kalman_filter(series, by))
    amended = F.expr("station_id % 4 = 0 AND target_date >= DATE '2024-01-12' AND target_date < DATE '2024-01-14'")
    corrected = series.withColumn("epsilon", F.when(amended, F.col("epsilon") + 7.5).otherwise(F.col("epsilon")))
    out = K.kalman_replay(history, corrected, series.filter(amended).select(*by, "target_date"), by)
    return rounded(out.select(*by, "target_date", "state_version", "b_k", "u_k", "is_amendment"))


@query("prj20_apply_bias", KAL_SQL.rstrip() + f""", hs AS (SELECT station_id, target_type, target_date, b FROM kf WHERE k > 0)
SELECT e.station_id, e.source_id, e.target_date, e.target_type, {R('coalesce(hs.b, 0)', 'b_k')}, {R('f_raw + coalesce(hs.b, 0)', 'f_adjusted')}, {R('f_raw + coalesce(hs.b, 0) - observed', 'error_adjusted')}
FROM errb e ASOF LEFT JOIN hs ON e.station_id = hs.station_id AND e.target_type = hs.target_type AND e.target_date > hs.target_date""")
def _(spark, sf):
    by = ["station_id", "target_type"]
    hist = K.kalman_filter(bias_series(spark, sf), by)
    out = K.apply_bias(errors(spark, sf).drop("error_adjusted"), hist, by)
    out = out.withColumn("error_adjusted", F.col("f_adjusted") - F.col("observed"))
    return rounded(out.select("station_id", "source_id", "target_date", "target_type", "b_k", "f_adjusted", "error_adjusted"))


# ------------------------------------------------------------------ ensemble state

STATE_SQL = (
    T("errb", extra=ROWS_SQL.strip() + """,
es AS (SELECT station_id, target_type, lead_bracket, source_id, count(*) AS n, sum(e * e) AS ssq, avg(e * e) AS mse, avg(e) AS mu FROM errb GROUP BY 1, 2, 3, 4),
eg AS (SELECT b.station_id, b.target_type, b.lead_bracket, b.source_id, any_value(n) AS n,
  CASE WHEN any_value(n) < 3 OR avg(pow(e - mu, 2)) < 1e-18 THEN 0 ELSE avg(pow(e - mu, 3)) / pow(avg(pow(e - mu, 2)), 1.5) END AS g
  FROM errb b JOIN es USING (station_id, target_type, lead_bracket, source_id) GROUP BY 1, 2, 3, 4),
mx AS (SELECT *, count(*) OVER g AS k, max(mse) OVER g AS worst FROM es WHERE n >= 5 WINDOW g AS (PARTITION BY station_id, target_type, lead_bracket)),
sk AS (SELECT station_id, target_type, lead_bracket, source_id, CASE WHEN k = 1 THEN 1.0 WHEN worst <= 0 THEN 0.0 ELSE greatest(0.0, 1.0 - mse / worst) END AS skill FROM mx),
rs AS (SELECT lr.*, coalesce(skill, 0.0)::DOUBLE AS skill FROM lr LEFT JOIN sk USING (station_id, target_type, lead_bracket, source_id))""").rstrip()
    + ",\n" + SPREAD_SQL[SPREAD_SQL.index("w1 AS"):].rstrip() + """,
tp AS (SELECT station_id, target_date, target_type, source_id AS top_source, f AS f_top, lead_bracket FROM dw
  QUALIFY row_number() OVER (PARTITION BY station_id, target_date, target_type ORDER BY skill DESC, source_id) = 1),
ow AS (SELECT d.station_id, d.target_date, d.target_type, sum(n) AS n, sqrt(sum(ssq) / sum(n)) AS rmse FROM dw d JOIN tp USING (station_id, target_date, target_type)
  JOIN es ON es.station_id = d.station_id AND es.target_type = d.target_type AND es.source_id = d.source_id AND es.lead_bracket = tp.lead_bracket GROUP BY 1, 2, 3),
pl AS (SELECT target_type, lead_bracket, sqrt(sum(ssq) / sum(n)) AS pooled FROM es GROUP BY 1, 2),
stt AS (SELECT spr.*, top_source, f_top, tp.lead_bracket,
  coalesce(greatest((ow.n * ow.rmse + 20.0::DOUBLE * coalesce(pooled, 2.0)) / (ow.n + 20.0::DOUBLE), 0.1), 2.0)::DOUBLE AS sigma_adj,
  coalesce(CASE WHEN eg.n < 3 THEN 0 WHEN abs(sqrt(eg.n * (eg.n - 1.0::DOUBLE)) / (eg.n - 2) * eg.g) < 2 * sqrt(6.0::DOUBLE / eg.n) THEN 0 ELSE sqrt(eg.n * (eg.n - 1.0::DOUBLE)) / (eg.n - 2) * eg.g END, 0)::DOUBLE AS g1
  FROM spr JOIN tp USING (station_id, target_date, target_type) LEFT JOIN ow USING (station_id, target_date, target_type)
  LEFT JOIN pl ON pl.target_type = spr.target_type AND pl.lead_bracket = tp.lead_bracket
  LEFT JOIN eg ON eg.station_id = spr.station_id AND eg.target_type = spr.target_type AND eg.lead_bracket = tp.lead_bracket AND eg.source_id = tp.top_source),
sst AS (SELECT *, greatest(sqrt(sigma_adj * sigma_adj + 0.5::DOUBLE * s_weighted * s_weighted), 0.1) AS sigma_eff FROM stt)
"""
)


def state(spark, sf, regime):
    return E.ensemble_state(latest_rows(spark, sf), errors(spark, sf), regime=regime)


@query("kal05_ensemble_state", STATE_SQL + f"""SELECT station_id, target_date, target_type, top_source, lead_bracket, m_k, {R('f_top', 'f_top')}, {R('f_bar', 'f_bar')}, {R('s_unweighted', 's_unweighted')},
 {R('s_weighted', 's_weighted')}, {R('sigma_adj', 'sigma_adj')}, {R('sigma_eff', 'sigma_eff')}, {R('g1', 'g1')} FROM sst""")
def _(spark, sf):
    return rounded(state(spark, sf, False)[0].drop("b_k", "mu"))


ASOF = "DATE '2024-01-20'"
ASOF_SQL = STATE_SQL.replace("FROM errb b JOIN", f"FROM (SELECT * FROM errb WHERE target_date >= {ASOF} - 90 AND target_date < {ASOF}) b JOIN").replace("FROM errb GROUP BY 1, 2, 3, 4),", f"FROM errb WHERE target_date >= {ASOF} - 90 AND target_date < {ASOF} GROUP BY 1, 2, 3, 4),").replace("skill FROM lr LEFT JOIN", f"skill FROM (SELECT * FROM lr WHERE target_date >= {ASOF}) lr LEFT JOIN").replace(
    "ORDER BY skill DESC, source_id) = 1)", "ORDER BY skill DESC, source_id <> CASE WHEN station_id % 2 = 0 THEN 'purchase' ELSE 'error' END, source_id) = 1)")


@query("agg08_source_skill_asof", T("errb", extra=f"""
ms AS (SELECT station_id, target_type, source_id, avg(e * e) AS mse FROM errb WHERE target_date >= {ASOF} - 90 AND target_date < {ASOF} GROUP BY 1, 2, 3 HAVING count(*) >= 5),
mw AS (SELECT *, count(*) OVER g AS k, max(mse) OVER g AS worst FROM ms WINDOW g AS (PARTITION BY station_id, target_type))""") + f"""
SELECT station_id, target_type, source_id, {R('CASE WHEN k = 1 THEN 1.0 WHEN worst <= 0 THEN 0.0 ELSE greatest(0.0, 1.0 - mse / worst) END', 'skill')} FROM mw""")
def _(spark, sf):
    out = E.source_skill(errors(spark, sf), ["station_id", "target_type"], asof=F.lit("2024-01-20").cast("date"))
    return rounded(out.select("station_id", "target_type", "source_id", "skill"))


@query("kal05_ensemble_asof", ASOF_SQL.rstrip() + f""",
md AS (SELECT *, station_id % 3 - 1.0::DOUBLE AS b_k, 1.0 + (station_id % 4) * 0.25::DOUBLE AS mult FROM sst)
SELECT station_id, target_date, target_type, top_source, {R('f_top', 'f_top')}, {R('b_k', 'b_k')}, {R('f_top + b_k', 'mu')}, {R('sigma_adj', 'sigma_adj')},
 {R('greatest(sqrt(sigma_adj * sigma_adj + 0.5::DOUBLE * s_weighted * s_weighted) * mult, 0.1)', 'sigma_eff')} FROM md""")
def _(spark, sf):
    """Nothing looks ahead; stored sources break ties, the bias moves the centre, texts widen it."""
    keys = latest_rows(spark, sf).select("station_id", "target_type").distinct()
    stored = F.when(F.col("station_id") % 2 == 0, "purchase").otherwise("error")
    bias = keys.select("station_id", "target_type", (F.col("station_id") % 3 - 1.0).alias("b_k"), stored.alias("top_source"))
    mods = keys.select("station_id", (1.0 + (F.col("station_id") % 4) * 0.25).alias("sigma_mult")).distinct()
    out = E.ensemble_state(latest_rows(spark, sf), errors(spark, sf), bias, mods, False, asof=F.lit("2024-01-20").cast("date"))[0]
    return rounded(out.select(*V.GROUP, "top_source", "f_top", "b_k", "mu", "sigma_adj", "sigma_eff"))


@query("kal05_weight_rows", STATE_SQL + f"SELECT station_id, target_date, target_type, source_id, lead_bracket, {R('weight', 'weight')}, {R('skill', 'skill')}, is_stale FROM dw")
def _(spark, sf):
    return rounded(state(spark, sf, False)[1])


NOISE = "prr AS (SELECT pr.*, coalesce(CASE WHEN s_unweighted > 0 THEN 0.25::DOUBLE * (1 + 2.0 * greatest(0.0, abs(f_top - f_bar) / s_unweighted - 1)) END, 0.25)::DOUBLE AS r FROM pr LEFT JOIN sst USING (station_id, target_date, target_type)),\nkf AS ("
NOISE_SQL = STATE_SQL.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + KAL_SQL[KAL_SQL.index("se AS"):].replace("kf AS (", NOISE, 1).replace("up / (up + 0.25)", "up / (up + r)").replace("pr.eps, pr.gap, kf.b", "pr.eps, pr.gap, pr.r, kf.b").replace("FROM kf JOIN pr ON", "FROM kf JOIN prr pr ON")


@query("kal03_ensemble_noise", NOISE_SQL + f"""SELECT station_id, target_type, target_date, CAST(k AS INT) AS state_version, {R('b', 'b_k')}, {R('u', 'u_k')}, {R('g', 'k_k')} FROM kf WHERE k > 0""")
def _(spark, sf):
    by = ["station_id", "target_type"]
    series = K.with_measurement_noise(bias_series(spark, sf), state(spark, sf, False)[0], by)
    return rounded(K.kalman_filter(series, by).select(*by, "target_date", "state_version", "b_k", "u_k", "k_k"))


REGIME_SQL = STATE_SQL.rstrip() + """,
gs AS (SELECT dw.*, s_unweighted AS s FROM dw JOIN spr USING (station_id, target_date, target_type)),""" + BIMODAL_SQL.format(keys="station_id, target_date, target_type", f="f", t="gs").rstrip() + """,
rg AS (SELECT * REPLACE (CASE WHEN centroid_1 IS NOT NULL THEN least(greatest(sigma_adj, (centroid_2 - centroid_1) / 2), 6.0) ELSE sigma_adj END AS sigma_adj) FROM sst LEFT JOIN bm USING (station_id, target_date, target_type)),
rgs AS (SELECT * REPLACE (greatest(sqrt(sigma_adj * sigma_adj + 0.5::DOUBLE * s_weighted * s_weighted), 0.1) AS sigma_eff) FROM rg)
"""


@query("kal05_ensemble_regime", REGIME_SQL + f"SELECT station_id, target_date, target_type, {R('sigma_adj', 'sigma_adj')}, {R('sigma_eff', 'sigma_eff')}, {R('centroid_1', 'centroid_1')}, size_1 FROM rgs")
def _(spark, sf):
    return rounded(state(spark, sf, True)[0].select(*V.GROUP, "sigma_adj", "sigma_eff", "centroid_1", "size_1"))


# ------------------------------------------------------------------ pricing

N = normal.number
PHI = normal.norm_cdf_text


def skew_cdf_sql(source: str, edge: str, name: str) -> str:
    """Nested selects adding the skew-normal CDF of ``edge`` (NULL stays NULL)."""
    text = f"SELECT *, ({edge} - xi) / omega AS _z FROM {source}"
    for step, body in normal.skew_cdf_steps("_z", "alpha"):
        text = f"SELECT *, {body} AS {step} FROM ({text})"
    return f"SELECT * EXCLUDE (_z, {', '.join(s for s, _ in normal.skew_cdf_steps('_z', 'alpha'))}), _cdf AS {name} FROM ({text})"


def params_sql(source: str) -> str:
    return f"""SELECT *, CASE WHEN abs(g1) < 1e-6 THEN 0 ELSE greatest(-10.0, least(10.0, delta / sqrt(1 - d2))) END::DOUBLE AS alpha,
  CASE WHEN abs(g1) < 1e-6 THEN sigma_eff ELSE greatest(sigma_eff / sqrt(1 - 2 * d2 / pi()), 0.01) END AS omega,
  CASE WHEN abs(g1) < 1e-6 THEN mu ELSE mu - greatest(sigma_eff / sqrt(1 - 2 * d2 / pi()), 0.01) * delta * sqrt(2 / pi()) END AS xi FROM (
  SELECT *, sign(g1) * sqrt(d2) AS delta FROM (SELECT *, least(kk * (pi() / 2) / (1 + kk), 0.999::DOUBLE) AS d2 FROM (
  SELECT *, pow(least(abs(g1), 0.9952::DOUBLE) * 2.0 / (4.0 - pi()), 2.0::DOUBLE / 3.0) AS kk FROM {source})))"""


@query("dst01_skewnormal_params", T("graded", extra="d AS (SELECT o_orderkey, p * 100 AS mu, price * 10 AS sigma_eff, (p - 0.5) * 2.4 AS g1 FROM graded)") + f"""
SELECT o_orderkey, {R('xi', 'xi')}, {R('omega', 'omega')}, {R('alpha', 'alpha')} FROM ({params_sql('d')})""")
def _(spark, sf):
    d = B.graded(spark, sf).selectExpr("o_orderkey", "p * 100 AS mu", "price * 10 AS sigma_eff", "(p - 0.5) * 2.4 AS g1")
    return rounded(P.skewnormal_params(d).select("o_orderkey", "xi", "omega", "alpha"))


LADDER_SQL = """
ct AS (SELECT *, round_even(mu / 2.0, 0) * 2.0 AS c FROM dist),
ld AS (SELECT *, CASE WHEN i > -7 THEN c + i * 2.0 - 0.5 END AS bin_lower, CASE WHEN i < 7 THEN c + i * 2.0 + 1.5 END AS bin_upper FROM ct CROSS JOIN (SELECT unnest(range(-7, 8)) AS i)),
tk AS (SELECT *, 'KX' || target_type || station_id::VARCHAR || '-' || upper(strftime(target_date, '%y%b%d')) || '-' ||
  CASE WHEN i = -7 THEN 'T' || CAST(bin_upper + 0.5 AS BIGINT)::VARCHAR || 'BELOW' WHEN i = 7 THEN 'T' || CAST(bin_lower - 0.5 AS BIGINT)::VARCHAR || 'ABOVE' ELSE 'B' || CAST(bin_lower + 0.5 AS BIGINT)::VARCHAR END AS ticker FROM ld)
"""


@query("prj13_bin_ladder", T("obs", extra="dist AS (SELECT station_id, target_date, 'HIGH' AS target_type, observed_high_f AS mu FROM obs)," + LADDER_SQL.rstrip()) + f"""
SELECT station_id, target_date, target_type, CAST(i AS INT) AS bin_index, ticker, {R('bin_lower', 'bin_lower')}, {R('bin_upper', 'bin_upper')} FROM tk""")
def _(spark, sf):
    d = B.observations(spark, sf).select("station_id", "target_date", F.lit("HIGH").alias("target_type"), F.col("observed_high_f").alias("mu"))
    return rounded(P.bin_ladder(d).drop("mu"))


@query("prj14_open_tails", T("graded") + f"""SELECT o_orderkey, {R('CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE p END', 'as_null')}, {R('CASE WHEN o_orderkey % 3 = 0 THEN -999.0 ELSE p END', 'as_999')} FROM graded""")
def _(spark, sf):
    edge = F.expr("CASE WHEN o_orderkey % 6 = 0 THEN -999.0D WHEN o_orderkey % 3 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE p END")
    null = S.open_edge_to_null(edge)
    return B.graded(spark, sf).select("o_orderkey", r6(null, "as_null"), r6(S.open_edge_from_null(null, "lower", "999"), "as_999"))


DIST_SQL = """dist AS (SELECT station_id, target_date, target_type, mu, sigma_eff, g1, xi, omega, alpha FROM (
""" + params_sql("(SELECT *, f_top AS mu FROM sst)") + "))," + LADDER_SQL.rstrip()

PRICE_SQL = STATE_SQL.rstrip() + ",\n" + DIST_SQL + ",\nc1 AS (" + skew_cdf_sql("tk", "bin_upper", "hi") + "),\nc2 AS (" + skew_cdf_sql("c1", "bin_lower", "lo") + """),
pb AS (SELECT *, greatest(coalesce(hi, 1.0) - coalesce(lo, 0.0), 0.001)::DOUBLE AS p FROM c2)
"""


def priced(spark, sf):
    return P.price_bins(P.bin_ladder(P.skewnormal_params(state(spark, sf, False)[0])))


@query("dst02_price_bins", PRICE_SQL + f"SELECT ticker, station_id, target_date, target_type, {R('p', 'p_win')} FROM pb")
def _(spark, sf):
    return rounded(priced(spark, sf).select("ticker", *V.GROUP, "p_win"))


NORM_SQL = """
n1 AS (SELECT *, sum(p) OVER g AS t, count(*) OVER g AS cnt FROM pb WINDOW g AS (PARTITION BY station_id, target_date, target_type)),
n2 AS (SELECT *, greatest(CASE WHEN abs(t - 1) > 0.001 THEN p / t ELSE p END, 0.001) AS p1 FROM n1),
n3 AS (SELECT *, sum(p1) OVER (PARTITION BY station_id, target_date, target_type) AS t2 FROM n2),
nb AS (SELECT *, CASE WHEN t <= 0 THEN 1.0 / cnt WHEN abs(t2 - 1) > 0.001 THEN p1 / t2 ELSE p1 END AS p_win, abs(t - 1) > 0.10 AS norm_warning FROM n3)
"""


@query("w06_normalize_probs", GRID := (T("obs", extra="""
pb AS (SELECT station_id, target_date, 'HIGH' AS target_type, b.i AS bin, exp(-((b.i * 25 - observed_high_f) / 60.0::DOUBLE) * ((b.i * 25 - observed_high_f) / 60.0::DOUBLE)) / 3 AS p FROM obs CROSS JOIN range(15) b(i)),""" + NORM_SQL.rstrip()) + f"SELECT station_id, target_date, CAST(bin AS INT) AS bin, {R('p_win', 'p_win')}, norm_warning FROM nb"))
def _(spark, sf):
    o = B.observations(spark, sf).select("station_id", "target_date", "observed_high_f", F.lit("HIGH").alias("target_type"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("bin"))
    d = (F.col("bin") * 25 - F.col("observed_high_f")) / 60.0
    return rounded(P.normalize_probs(o.withColumn("p_win", F.exp(-d * d) / 3)).select("station_id", "target_date", "bin", "p_win", "norm_warning"))


@query("dst03_price_bins_mixture", T("obs", extra="""
dist AS (SELECT station_id, target_date, 'HIGH' AS target_type, (observed_high_f + observed_low_f) / 2 AS mu, observed_low_f AS mu1, observed_high_f AS mu2, 0.4::DOUBLE AS w1, 3.5::DOUBLE AS sigma_eff FROM obs),""" + LADDER_SQL.rstrip() + f""",
zz AS (SELECT *, (bin_upper - mu1) / sigma_eff AS u1, (bin_upper - mu2) / sigma_eff AS u2, (bin_lower - mu1) / sigma_eff AS l1, (bin_lower - mu2) / sigma_eff AS l2 FROM tk),
mc AS (SELECT *, coalesce(w1 * {PHI('u1')} + (1 - w1) * {PHI('u2')}, 1.0) - coalesce(w1 * {PHI('l1')} + (1 - w1) * {PHI('l2')}, 0.0) AS m FROM (SELECT * FROM zz))""") + f"""
SELECT ticker, {R('''greatest(CASE WHEN bin_upper IS NULL THEN 1.0 - (w1 * ''' + PHI('l1') + ''' + (1 - w1) * ''' + PHI('l2') + ''') WHEN bin_lower IS NULL THEN w1 * ''' + PHI('u1') + ''' + (1 - w1) * ''' + PHI('u2') + ''' ELSE m END, 0.001)''', 'p_win')} FROM mc""")
def _(spark, sf):
    d = B.observations(spark, sf).select(
        "station_id", "target_date", F.lit("HIGH").alias("target_type"), ((F.col("observed_high_f") + F.col("observed_low_f")) / 2).alias("mu"),
        F.col("observed_low_f").alias("mu1"), F.col("observed_high_f").alias("mu2"), F.lit(0.4).alias("w1"), F.lit(3.5).alias("sigma_eff"))
    return rounded(P.price_bins_mixture(P.bin_ladder(d)).select("ticker", "p_win"))


def seen_extremes(spark, sf):
    """Observed extremes so far: those of the first half of each day."""
    rd = B.readings(spark, sf).filter(F.hour("ts") < 12)
    return rd.groupBy("station_id", F.to_date("ts").alias("target_date")).agg(
        F.max("temp_f").alias("t_max_f"), F.min("temp_f").alias("t_min_f"), F.max("ts").alias("last_obs_at"))


EXT_SQL = """ex AS (SELECT station_id, CAST(ts AS DATE) AS target_date, max(temp_f) AS t_max_f, min(temp_f) AS t_min_f FROM rd WHERE hour(ts) < 12 GROUP BY 1, 2)"""
TRUNC_HEAD = """
tj AS (SELECT nb.*, CASE WHEN target_type = 'HIGH' THEN t_max_f ELSE t_min_f END AS seen FROM nb LEFT JOIN ex USING (station_id, target_date)),
tg AS (SELECT *, coalesce(CASE WHEN target_type = 'HIGH' THEN bin_upper <= seen ELSE bin_lower >= seen END, false) AS truncated FROM tj),"""
TRUNC_TAIL = """
tt AS (SELECT *, sum(pp) OVER (PARTITION BY station_id, target_date, target_type) AS tot FROM tz),
tf AS (SELECT *, CASE WHEN tot > 0 THEN CASE WHEN pp / tot > 0 AND pp / tot < 0.001 THEN 0.001 ELSE pp / tot END END::DOUBLE AS q FROM tt),
tw AS (SELECT *, CASE WHEN seen IS NOT NULL AND tot > 0 THEN q / sum(q) OVER (PARTITION BY station_id, target_date, target_type) ELSE pp END AS pf FROM tf)
"""
TRUNC_ZERO = TRUNC_HEAD + "tz AS (SELECT *, CASE WHEN truncated THEN 0 ELSE p_win END AS pp FROM tg)," + TRUNC_TAIL
BOOK_SQL = PRICE_SQL.rstrip() + "," + NORM_SQL.rstrip() + ",\n" + B.SQL["rd"] + ",\n" + EXT_SQL + ","


@query("dst04_truncate_zero", BOOK_SQL + TRUNC_ZERO + f"SELECT ticker, station_id, target_date, target_type, truncated, {R('pf', 'p_win')} FROM tw")
def _(spark, sf):
    book = P.normalize_probs(priced(spark, sf))
    out = P.truncate_probs(book, seen_extremes(spark, sf), "zero")
    return rounded(out.select("ticker", *V.GROUP, "truncated", "p_win"))


@query("dst04_truncate_conditional", BOOK_SQL + TRUNC_HEAD + """
td AS (SELECT * EXCLUDE (hi, lo), CASE WHEN target_type = 'HIGH' THEN greatest(bin_lower, seen) ELSE bin_lower END AS ef, CASE WHEN target_type = 'HIGH' THEN bin_upper ELSE least(bin_upper, seen) END AS et FROM tg),
d1 AS (""" + skew_cdf_sql("td", "ef", "cf") + "),\nd2c AS (" + skew_cdf_sql("d1", "et", "ct") + "),\nd3 AS (" + skew_cdf_sql("d2c", "seen", "cs") + """),
tz AS (SELECT *, CASE WHEN seen IS NULL THEN p_win WHEN truncated THEN 0 ELSE coalesce(greatest(coalesce(ct, 1.0) - coalesce(cf, 0.0), 0.0) / nullif(CASE WHEN target_type = 'HIGH' THEN greatest(1 - cs, 0) ELSE cs END, 0), p_win) END AS pp FROM d3),""" + TRUNC_TAIL + f"""
SELECT ticker, station_id, target_date, target_type, truncated, {R('pf', 'p_win')} FROM tw""")
def _(spark, sf):
    book = P.normalize_probs(priced(spark, sf))
    out = P.truncate_probs(book, seen_extremes(spark, sf), "conditional")
    return rounded(out.select("ticker", *V.GROUP, "truncated", "p_win"))


@query("dst05_price_book", REGIME_SQL.rstrip() + ",\n" + DIST_SQL.replace("f_top AS mu FROM sst", "f_top AS mu FROM rgs").replace("mu, sigma_eff, g1,", "mu, sigma_eff, g1, centroid_1, centroid_2, size_1, size_2,") + ",\nc1 AS (" + skew_cdf_sql("tk", "bin_upper", "hi") + "),\nc2 AS (" + skew_cdf_sql("c1", "bin_lower", "lo") + f"""),
zz AS (SELECT *, (bin_upper - centroid_1) / sigma_eff AS u1, (bin_upper - centroid_2) / sigma_eff AS u2, (bin_lower - centroid_1) / sigma_eff AS l1, (bin_lower - centroid_2) / sigma_eff AS l2, size_1 * 1.0::DOUBLE / (size_1 + size_2) AS w1 FROM c2),
mh AS (SELECT *, w1 * {PHI('u1')} + (1 - w1) * {PHI('u2')} AS mhi, w1 * {PHI('l1')} + (1 - w1) * {PHI('l2')} AS mlo FROM zz),
pb AS (SELECT *, CASE WHEN w1 IS NULL THEN greatest(coalesce(hi, 1.0) - coalesce(lo, 0.0), 0.001)
  ELSE greatest(CASE WHEN bin_upper IS NULL THEN 1.0 ELSE mhi END - CASE WHEN bin_lower IS NULL THEN 0.0 ELSE mlo END, 0.001) END::DOUBLE AS p FROM mh),""" + NORM_SQL.rstrip() + ",\n" + B.SQL["rd"] + ",\n" + EXT_SQL + "," + TRUNC_ZERO + f"""
SELECT ticker, station_id, target_date, target_type, truncated, norm_warning, {R('pf', 'p_win')} FROM tw""")
def price_book(spark, sf):
    out = P.price_book(state(spark, sf, True)[0], seen_extremes(spark, sf))
    return rounded(out.select("ticker", *V.GROUP, "truncated", "norm_warning", "p_win"))


LISTED_SQL = BOOK_SQL + TRUNC_ZERO
for _old, _new in (("range(-7, 8)", "range(-3, 4)"), ("i > -7", "i > -3"), ("i < 7", "i < 3"), ("i = -7", "i = -3"), ("i = 7", "i = 3"), ("f_top AS mu FROM sst)", "f_top AS mu FROM sst WHERE station_id % 2 = 0)")):
    assert _old in LISTED_SQL
    LISTED_SQL = LISTED_SQL.replace(_old, _new)


@query("dst05_publish_listed", LISTED_SQL + f"SELECT ticker, station_id, target_date, target_type, {R('pf', 'p_win')}, 2::BIGINT AS n_runs FROM tw")
def _(spark, sf):
    """Listed ladders only; an outdated run that arrives last changes no current price."""
    states = cut_lineage(state(spark, sf, False)[0])
    mu = states.filter("station_id % 2 = 0").select(*V.GROUP, "mu")
    listed = P.bin_ladder(mu, n=7).select(*V.GROUP, "bin_index", "bin_lower", "bin_upper", "ticker")
    book = P.price_book(states, seen_extremes(spark, sf), listed).select("ticker", *V.GROUP, "p_win")
    from brierworks.plans.source_queries import scratch
    from brierworks.sources import snapshots

    path, history = scratch(spark, "book"), scratch(spark, "book-history")
    book = cut_lineage(book)
    TB.publish_book(spark, book, path, history, 2)
    TB.publish_book(spark, book.withColumn("p_win", F.col("p_win") / 2), path, history, 1)
    now = snapshots.read(spark, path, book.withColumn("run_no", F.lit(1)).schema)
    runs = spark.read.schema("ticker string, run_stamp string").parquet(history).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_runs"))
    return rounded(now.join(runs, "ticker").select("ticker", *V.GROUP, "p_win", "n_runs"))


@query("udf03_skew_cdf", T("graded", extra=f"""
v AS (SELECT DISTINCT p, (p - 0.5::DOUBLE) * 6.0 AS z, ((p * 7.0) % 1.0 - 0.5::DOUBLE) * 8.0 AS al FROM graded),
o AS (SELECT p, z, al, i, -9.0::DOUBLE + (z + 9.0) * i / 400.0 AS t FROM v CROSS JOIN range(401) r(i)),
x AS (SELECT *, greatest(-9.0::DOUBLE, least(9.0::DOUBLE, al * t)) AS e FROM o),
c AS (SELECT p, i, z, t, 0.5::DOUBLE + list_sum(list_transform(range(401), lambda j: (CASE WHEN j = 0 OR j = 400 THEN 1.0 WHEN j % 2 = 1 THEN 4.0 ELSE 2.0 END) * exp(-0.5::DOUBLE * (e * j / 400.0) * (e * j / 400.0)))) * e / 1200.0 / sqrt(2 * pi()) AS ph FROM x),
s AS (SELECT p, sum((CASE WHEN i = 0 OR i = 400 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * 2.0 * exp(-0.5::DOUBLE * t * t) / sqrt(2 * pi()) * ph) * (any_value(z) + 9.0) / 1200.0 AS cdf FROM c GROUP BY 1)""") + " SELECT p, round(cdf + 1e-9, 5) + 0.0 AS cdf FROM s")
def _(spark, sf):
    """The SQL integrates the density numerically."""
    normal.register_sql_functions(spark)
    v = B.graded(spark, sf).select("p").distinct()
    return v.select("p", (F.round(F.expr("bw_skew_cdf((p - 0.5D) * 6.0D, ((p * 7.0D) % 1.0D - 0.5D) * 8.0D)") + 1e-9, 5) + 0.0).alias("cdf"))


@query("udf03_sql_functions", T("graded") + f"""SELECT o_orderkey, {R(PHI('((p - 0.5e0) * 8.0e0)'), 'phi')} FROM graded""")
def _(spark, sf):
    normal.register_sql_functions(spark)
    g = B.graded(spark, sf)
    return g.select("o_orderkey", r6(F.expr("bw_norm_cdf((p - 0.5D) * 8.0D)"), "phi"))
