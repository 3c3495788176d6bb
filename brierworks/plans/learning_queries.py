"""Learned correction on daily series derived from the orders (seven years per station)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from brierworks.operators import learning as ML
from brierworks.operators.series import chrono_split
from brierworks.plans import bindings as B
from brierworks.plans.bindings import with_tables as T
from brierworks.plans.registry import R, query, rounded
from brierworks.session import cut_lineage

DAY_COLS = {
    "forecast_high": "avg((o_orderkey * 29) % 450) / 5.0",
    "forecast_low": "avg((o_orderkey * 29) % 450) / 5.0 - 10.0 - count(*) % 3",
    "forecast_precip": "avg(o_orderkey % 10) / 10.0",
    "forecast_wind": "max(o_orderkey % 30) * 1.0",
    "forecast_radiation": "avg(o_totalprice) / 10000.0",
    "forecast_evap": "avg(o_orderkey % 7) * 1.0",
    "_shift": "(min(o_orderkey) % 5 - 2) * 0.5",
    "_gap": "min(o_orderkey) % 11",
}


def day_table(spark, sf):
    o = B.table(spark, sf, "orders").withColumn("station_id", F.expr("o_custkey % 20")).withColumn("target_date", F.to_date("o_orderdate"))
    return o.groupBy("station_id", "target_date").agg(*[F.expr(e.replace(".0", ".0D").replace("0.5", "0.5D")).alias(n) for n, e in DAY_COLS.items()])


def forecasts_daily(spark, sf):
    return day_table(spark, sf).drop("_shift", "_gap").withColumn("lead_hours", F.when(F.col("target_date") >= F.lit("1998-01-01").cast("date"), 24).otherwise(0))


def actuals_daily(spark, sf):
    angle = F.lit(2.0) * F.pi() * F.dayofyear("target_date") / 365.25
    d = day_table(spark, sf).filter("_gap <> 0")
    return d.select(
        "station_id", "target_date", (F.col("forecast_high") + 3.0 * F.sin(angle) + F.col("_shift")).alias("actual_high"),
        (F.col("forecast_low") - 2.0 * F.cos(angle) + F.col("_shift")).alias("actual_low"))


def features(spark, sf):
    return ML.bias_features(forecasts_daily(spark, sf), actuals_daily(spark, sf))


DAY_SQL = "dt AS (SELECT o_custkey % 20 AS station_id, CAST(o_orderdate AS DATE) AS target_date, " + ", ".join(
    f"{e.replace('.0', '.0::DOUBLE').replace('0.5', '0.5::DOUBLE')} AS {n}" for n, e in DAY_COLS.items()
) + """ FROM orders GROUP BY 1, 2),
rw AS (SELECT * EXCLUDE (_shift, _gap), CASE WHEN target_date >= DATE '1998-01-01' THEN 24 ELSE 0 END AS lead_hours, forecast_high + 3.0 * sin(2.0 * pi() * dayofyear(target_date) / 365.25) + _shift AS actual_high,
  forecast_low - 2.0 * cos(2.0 * pi() * dayofyear(target_date) / 365.25) + _shift AS actual_low, _gap FROM dt)"""


def memory_sql(source: str) -> str:
    """Dense calendar, lags with bounded fill and rolling statistics, as in the feature job."""
    parts = [
        f"sp AS (SELECT station_id, min(target_date) AS a, max(target_date) AS b FROM {source} GROUP BY 1)",
        "dn AS (SELECT station_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS target_date FROM sp)",
        f"d0 AS (SELECT dn.station_id, dn.target_date, r.* EXCLUDE (station_id, target_date), actual_high - forecast_high AS target_error_high, actual_low - forecast_low AS target_error_low FROM dn LEFT JOIN {source} r USING (station_id, target_date))",
        "d1 AS (SELECT *, lag(target_error_high, 1) OVER w AS h1, lag(target_error_high, 2) OVER w AS h2, lag(target_error_low, 1) OVER w AS l1, lag(target_error_low, 2) OVER w AS l2 FROM d0 WINDOW w AS (PARTITION BY station_id ORDER BY target_date))",
        "d2 AS (SELECT *, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {n}" for c, n in (("h1", "lag_high_1d"), ("h2", "lag_high_2d"), ("l1", "lag_low_1d"), ("l2", "lag_low_2d")))
        + " FROM d1 WINDOW w AS (PARTITION BY station_id ORDER BY target_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))",
        "d3 AS (SELECT *, " + ", ".join(
            f"CASE WHEN count(lag_{t}_1d) OVER w7 >= 4 THEN avg(lag_{t}_1d) OVER w7 END AS roll_{t}_7d_mean, CASE WHEN count(lag_{t}_1d) OVER w14 >= 7 THEN avg(lag_{t}_1d) OVER w14 END AS roll_{t}_14d_mean, CASE WHEN count(lag_{t}_1d) OVER w7 >= 4 THEN stddev_samp(lag_{t}_1d) OVER w7 END AS roll_{t}_7d_std"
            for t in ("high", "low"))
        + ", sin(2.0 * pi() * dayofyear(target_date) / 365.25) AS day_sin, cos(2.0 * pi() * dayofyear(target_date) / 365.25) AS day_cos, forecast_high - forecast_low AS forecast_diurnal_range FROM d2"
        + " WINDOW w7 AS (PARTITION BY station_id ORDER BY target_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY station_id ORDER BY target_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))",
    ]
    return ", ".join(parts)


OUT = ["station_id", "target_date", *dict.fromkeys([*ML.feature_names("HIGH"), *ML.feature_names("LOW")])]
OUT_SQL = ", ".join(c if c in ("station_id", "target_date") else R(c, c) for c in OUT)
MEMORY = [f"{c}" for t in ("high", "low") for c in (f"target_error_{t}", f"lag_{t}_1d", f"lag_{t}_2d", f"roll_{t}_7d_mean", f"roll_{t}_14d_mean", f"roll_{t}_7d_std")]


@query("ml01_bias_features", "WITH " + DAY_SQL + """, ok AS (SELECT * FROM rw WHERE _gap <> 0),
ah AS (SELECT *, count(*) FILTER (WHERE lead_hours = 24) OVER (PARTITION BY station_id) AS n24 FROM ok), kp AS (SELECT * FROM ah WHERE n24 < 180 OR lead_hours = 24), """ + memory_sql("kp") + f"""
SELECT {OUT_SQL}, {R('target_error_high', 'target_error_high')}, {R('target_error_low', 'target_error_low')} FROM d3 WHERE {' AND '.join(c + ' IS NOT NULL' for c in MEMORY)}""")
def _(spark, sf):
    return rounded(features(spark, sf).select(*OUT, "target_error_high", "target_error_low"))


@query("ml02_inference_features", "WITH " + DAY_SQL + """, hs AS (SELECT * REPLACE (CASE WHEN _gap <> 0 THEN actual_high END AS actual_high, CASE WHEN _gap <> 0 THEN actual_low END AS actual_low) FROM rw),
bt AS (SELECT * FROM hs WHERE target_date >= DATE '2000-06-15' - 21 AND target_date < DATE '2000-06-15'
  UNION ALL SELECT * REPLACE (NULL AS actual_high, NULL AS actual_low) FROM hs WHERE target_date >= DATE '2000-06-15' AND target_date <= DATE '2000-06-16'), """ + memory_sql("bt") + f"""
SELECT {OUT_SQL} FROM d3 WHERE target_date = DATE '2000-06-15' AND forecast_high IS NOT NULL""")
def _(spark, sf):
    fc = forecasts_daily(spark, sf)
    day = F.lit("2000-06-15").cast("date")
    near = (F.col("target_date") >= F.date_sub(day, 21)) & (F.col("target_date") < day)
    history = fc.filter(near).join(actuals_daily(spark, sf).filter(near), ["station_id", "target_date"], "left")
    live = fc.filter((F.col("target_date") >= day) & (F.col("target_date") <= F.date_add(day, 1)))
    return rounded(ML.inference_features(history, live, day).select(*OUT))


TARGETS = ("HIGH", "LOW")


def scored(spark, sf, target="HIGH", weights=0.5, refit=False):
    """Every feature row scored by models of this very call."""
    rows = cut_lineage(chrono_split(features(spark, sf), ["station_id"], "target_date"))
    models = ML.fit_bias_models(rows.drop("split"), target, refit=refit)
    return ML.score_bias(models, rows, target, weights)


@query("ml03_fit_bias_models")
def _(spark, sf):
    out = []
    for t in TARGETS:
        s, e = scored(spark, sf, t).filter("split = 'val'"), F.col(f"target_error_{t.lower()}")
        out.append(s.groupBy("station_id").agg(F.lit(t).alias("target_type"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(e - F.col("bias_a"))).alias("mae_a"), F.avg(F.abs(e - F.col("bias_b"))).alias("mae_b")))
    return rounded(out[0].unionByName(out[1]))


KEPT_SQL = "WITH " + DAY_SQL + """, ok AS (SELECT * FROM rw WHERE _gap <> 0),
ah AS (SELECT *, count(*) FILTER (WHERE lead_hours = 24) OVER (PARTITION BY station_id) AS n24 FROM ok), kp AS (SELECT * FROM ah WHERE n24 < 180 OR lead_hours = 24), """ + memory_sql("kp") + f""",
ft AS (SELECT * FROM d3 WHERE {' AND '.join(c + ' IS NOT NULL' for c in MEMORY)}),
fs AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY target_date) - 1 AS i, count(*) OVER (PARTITION BY station_id) AS n FROM ft),
pz AS (SELECT *, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM fs),
er AS (SELECT station_id, target_date, split, 'HIGH' AS target_type, target_error_high AS e FROM pz UNION ALL SELECT station_id, target_date, split, 'LOW', target_error_low FROM pz)
"""


@query("ml03_predictions", KEPT_SQL + f"SELECT station_id, target_date, target_type, split, {R('e', 'error_raw')}, tr.ok AS has_a, tr.ok AS has_b, CASE WHEN count(*) FILTER (WHERE split = 'test') OVER (PARTITION BY target_type) >= 100 THEN true END AS gains FROM er, (SELECT count(*) > 0 AS ok FROM pz WHERE split = 'train') tr WHERE split <> 'train'")
def _(spark, sf):
    """Every row after the training days has a prediction of each learner; on the last fifth of the days, which no fit has
    seen, the learners and their blend have a lower mean absolute error than the raw forecast (judged on 100 rows at
    least). Without training rows there are no predictions."""
    out = []
    for t in TARGETS:
        e, later = F.col(f"target_error_{t.lower()}"), cut_lineage(scored(spark, sf, t).filter("split <> 'train'"))
        gain = [F.avg(F.abs(e - F.col(c))) < F.avg(F.abs(e)) for c in ("bias_a", "bias_b", "bias_blend")]
        gains = later.filter("split = 'test'").agg(F.when(F.count(F.lit(1)) >= 100, gain[0] & gain[1] & gain[2]).alias("g")).scalar()
        out.append(later.select(
            "station_id", "target_date", F.lit(t).alias("target_type"), "split", e.alias("error_raw"),
            F.col("bias_a").isNotNull().alias("has_a"), F.col("bias_b").isNotNull().alias("has_b"), gains.alias("gains")))
    return rounded(out[0].unionByName(out[1]))


TUNING_GRID = [
    ML.DEEP, replace(ML.DEEP, step=0.05), replace(ML.DEEP, depth=4), ML.WIDE, replace(ML.WIDE, step=0.1), replace(ML.WIDE, bins=16)]


@query("ml04_tune_bias_models")
def _(spark, sf):
    """Both types over all 6 folds, both learners at their default rounds and with settings around the default."""
    rows = features(spark, sf).persist()
    try:
        out = [ML.tune_bias_models(rows, t, TUNING_GRID).withColumn("target_type", F.lit(t)) for t in TARGETS]
    finally:
        rows.unpersist()
    return rounded(out[0].unionByName(out[1]).select("target_type", "trial_id", "learner", "depth", "max_rounds", "step", "state", "value", "rounds", "fits_saved", "rank"))


@query("ml05_blend_weight", T("graded", extra="""
bp AS (SELECT station_id, target_type, p * 6 - 3 AS a, price * 6 - 3 AS b, outcome * 3.0::DOUBLE - 1 AS y FROM graded),
bg AS (SELECT station_id, target_type, i / 1000.0::DOUBLE AS w, sum(CASE WHEN abs(y - (i / 1000.0::DOUBLE * a + (1.0 - i / 1000.0::DOUBLE) * b)) > 1.5 THEN 2.0 ELSE 1.0 END * abs(y - (i / 1000.0::DOUBLE * a + (1.0 - i / 1000.0::DOUBLE) * b))) + 10.0 * (i / 1000.0::DOUBLE - 0.5) * (i / 1000.0::DOUBLE - 0.5) AS o
 FROM bp CROSS JOIN range(1001) r(i) GROUP BY 1, 2, 3)""") + f"SELECT station_id, target_type, {R('arg_min(w, (o, w))', 'w')}, {R('min(o)', 'objective')} FROM bg GROUP BY 1, 2")
def _(spark, sf):
    p = B.graded(spark, sf).selectExpr("station_id", "target_type", "p * 6 - 3 AS bias_a", "price * 6 - 3 AS bias_b", "outcome * 3.0D - 1 AS target_error")
    return rounded(ML.blend_weight(p, ["station_id", "target_type"]))


FEATURES_SQL = "WITH " + DAY_SQL + ", ok AS (SELECT * FROM rw WHERE _gap <> 0), ah AS (SELECT *, count(*) FILTER (WHERE lead_hours = 24) OVER (PARTITION BY station_id) AS n24 FROM ok), kp AS (SELECT * FROM ah WHERE n24 < 180 OR lead_hours = 24), " + memory_sql("kp") + f", ft AS (SELECT * FROM d3 WHERE {' AND '.join(c + ' IS NOT NULL' for c in MEMORY)})"


@query("ml06_score_bias", FEATURES_SQL + """ SELECT station_id, target_date, target_type, true AS blended, true AS corrects FROM ft CROSS JOIN (VALUES ('HIGH'), ('LOW')) t(target_type)""")
def _(spark, sf):
    """Every feature row of both types is scored by the refitted models, and the sums hold."""
    out = []
    for t in TARGETS:
        val = scored(spark, sf, t).filter("split = 'val'").withColumnRenamed(f"target_error_{t.lower()}", "target_error")
        weights = ML.blend_weight(val, ["station_id"])
        s = scored(spark, sf, t, weights, refit=True).join(weights.select("station_id", F.col("w").alias("_w")), "station_id", "left")
        w = F.coalesce("_w", F.lit(0.5))
        out.append(s.select(
            "station_id", "target_date", F.lit(t).alias("target_type"),
            (F.abs(F.col("bias_blend") - (w * F.col("bias_a") + (1 - w) * F.col("bias_b"))) < 1e-9).alias("blended"),
            (F.abs(F.col("corrected") - F.col(f"forecast_{t.lower()}") - F.col("bias_blend")) < 1e-9).alias("corrects")))
    return out[0].unionByName(out[1])


@query("ml06_lead_choice", "WITH " + DAY_SQL + " SELECT station_id, count(*) FILTER (WHERE lead_hours = 24) AS n_day_ahead, count(*) AS n_all, count(*) FILTER (WHERE lead_hours = 24) >= 180 AS only_day_ahead FROM rw WHERE _gap <> 0 GROUP BY 1")
def _(spark, sf):
    return ML.lead_choice(forecasts_daily(spark, sf), actuals_daily(spark, sf))


def holdout(spark, sf, report):
    out = []
    for t in TARGETS:
        test = scored(spark, sf, t).filter("split = 'test'")
        out.append(report(test, t.lower()).withColumn("target_type", F.lit(t)))
    return rounded(out[0].unionByName(out[1]))


@query("ml07_holdout_report")
def _(spark, sf):
    return holdout(spark, sf, lambda df, t: ML.holdout_report(df, f"forecast_{t}", "corrected", f"actual_{t}", ["station_id"]))


@query("ml07_holdout_bias")
def _(spark, sf):
    return holdout(spark, sf, lambda df, t: ML.holdout_bias(df, "corrected", f"actual_{t}", ["station_id"]))
