"""Learned correction: the models must help on unseen days, and live features must equal training ones."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from brierworks.operators import learning as ML
from brierworks.plans import learning_queries as Q

SF = "/root/testdata/sf0.01"


def test_holdout_improves(spark):
    r = Q.scored(spark, SF).filter("split = 'test'").agg(
        F.avg(F.abs(F.col("forecast_high") - F.col("actual_high"))).alias("raw"), F.avg(F.abs(F.col("corrected") - F.col("actual_high"))).alias("new")).first()
    assert r.new < 0.8 * r.raw


def test_live_features_equal_training_features(spark):
    fc, obs = Q.forecasts_daily(spark, SF), Q.actuals_daily(spark, SF)
    full = ML.bias_features(fc, obs)
    day = F.lit(full.groupBy("target_date").count().orderBy(F.desc("count"), "target_date").first()[0])
    cols = ["station_id", *ML.feature_names("HIGH")]
    train = full.filter(F.col("target_date") == day).select(*cols)
    # the retrospective must reach back over the longest window and its lag
    live = ML.inference_features(fc.join(obs, ["station_id", "target_date"], "left"), fc.filter(F.col("target_date") == day), day, 60).select(*cols)
    a, b = {r.station_id: r for r in train.collect()}, {r.station_id: r for r in live.collect()}
    assert a and all(all(x is None or abs(x - y) < 1e-9 for x, y in zip(a[k], b[k])) for k in a)


def test_tuning_table(spark):
    small = Q.features(spark, SF)
    out = ML.tune_bias_models(small, "LOW", [ML.TreeParams(depth=2, rounds=3, step=0.3)], folds=2, test_days=20).first()
    assert out.value > 0 and len(out.fold_mae) == 2 and 1 <= out.rounds <= 3


def test_blend_prefers_the_better_learner(spark):
    df = spark.createDataFrame([(1, float(i % 5), 9.0, float(i % 5)) for i in range(200)], "k int, bias_a double, bias_b double, target_error double")
    assert ML.blend_weight(df, ["k"]).first().w > 0.95


def test_every_row_is_scored(spark):
    rows = Q.features(spark, SF).withColumn("station_id", F.concat(F.lit("K"), F.col("station_id").cast("string")))
    small = ML.TreeParams(depth=2, rounds=2, step=0.3)
    models = ML.fit_bias_models(rows, "HIGH", small, small)
    holes = rows.withColumn("forecast_wind", F.when(F.dayofmonth("target_date") % 2 == 0, F.col("forecast_wind"))).withColumn("forecast_precip", F.lit(None).cast("double"))
    out = ML.score_bias(models, holes, "HIGH")
    assert out.count() == rows.count() and out.filter("bias_blend IS NULL").count() == 0
    assert set(out.columns) == set(holes.columns) | {"bias_a", "bias_b", "bias_blend", "corrected"}


def test_tuning_ranks_a_grid(spark):
    assert len(Q.TUNING_GRID) > 1 and {p.rounds for p in Q.TUNING_GRID} == {ML.DEEP.rounds, ML.WIDE.rounds} and Q.TARGETS == ("HIGH", "LOW")
    grid = [ML.TreeParams(depth=1, rounds=1, step=0.01), ML.TreeParams(depth=3, rounds=3, step=0.3)]
    rows = ML.tune_bias_models(Q.features(spark, SF), "HIGH", grid, folds=2, test_days=20).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0].trial_id == 1 and rows[0].value < rows[1].value


def test_each_station_has_its_own_effect(spark):
    """Far more stations than any fixed number of columns: rows stay as wide as they are with one station."""
    rows = Q.features(spark, SF).withColumn("station_id", F.concat_ws("-", F.col("station_id").cast("string"), F.dayofmonth("target_date").cast("string"))).persist()
    label, data = "target_error_high", ML._prepared(rows, "HIGH")
    mine = {r["_station"]: r["_effect"] for r in ML.station_effects(data, label).collect()}
    byhand = {}
    for r in rows.select("station_id", label).collect():
        byhand.setdefault(r.station_id, []).append(r[label])
    assert len(mine) > 500 and all(abs(mine[k] - sum(v) / (len(v) + ML.EFFECT_DAYS)) < 1e-9 for k, v in byhand.items()) and set(mine) == set(byhand)
    small = ML.TreeParams(depth=2, rounds=2, step=0.3)
    models = ML.fit_bias_models(rows, "HIGH", small, ML.StumpParams(rounds=3, bins=4))
    assert models["a"].learner.stages[-1].numFeatures == 2 * len(ML.feature_names("HIGH")) + 1
    new = ML.score_bias(models, rows.limit(5).withColumn("station_id", F.lit("new")), "HIGH")
    assert new.count() == 5 and new.filter("bias_blend IS NULL").count() == 0


def test_effects_know_earlier_days_only(spark):
    days = [("a", d, float(d * d % 7)) for d in (1, 2, 2, 5, 9)] + [("b", 3, 4.0), ("b", 4, None)]
    df = spark.createDataFrame(days, "_station string, d int, e double")
    got = sorted((r["_station"], r["d"], r["x"]) for r in df.withColumn("x", ML.earlier_effect("e", F.col("d"))).collect())
    def want(s, d):
        before = [e for t, k, e in days if t == s and k < d and e is not None]
        return sum(before) / (len(before) + ML.EFFECT_DAYS)
    assert all(abs(x - want(s, d)) < 1e-12 for s, d, x in got) and len(got) == len(days)


def test_additive_model_against_row_by_row_boosting(spark):
    """The joint sums give the scores that boosting over the rows themselves gives, and predictions follow them."""
    rng = np.random.default_rng(5)
    names = ML.feature_names("HIGH")
    table = [[None if rng.random() < 0.15 else float(v) for v in rng.integers(0, 6, len(names))] for _ in range(300)]
    table = [[3, datetime.date(2024, 1, 1) + datetime.timedelta(i), *row, (row[0] or 0) - 2.0 * (row[5] is None) + float(rng.normal())] for i, row in enumerate(table)]
    label = "target_error_high"
    df = spark.createDataFrame(table, "station_id int, target_date date, " + ", ".join(f"{n} double" for n in names) + f", {label} double")
    data = ML._prepared(df, "HIGH").withColumn("_effect", ML.earlier_effect(label, F.unix_date("target_date"))).persist()
    p = ML.StumpParams(rounds=25, step=0.4, bins=5, least=10)
    bins = ML.Bins.of(data, "HIGH", p.bins)
    scores, rounds = ML.boost(bins, *ML.joint_sums(data, bins, label)[0], p)
    rows = data.orderBy("target_date").select(*[F.when(F.col(n).isNotNull(), F.col(n)).alias(n) for n in names], "_effect", label).toPandas().to_numpy(float)
    x, y = rows[:, :-1], rows[:, -1]
    cell = np.array([[0 if np.isnan(v) else 1 + sum(v > c for c in cuts) for v, cuts in zip(r, bins.cuts)] for r in x])
    pred = np.full(len(y), y.mean())
    for _ in range(p.rounds):
        options = []
        for f in range(cell.shape[1]):
            for m in range(len(bins.cuts[f]) + 1):
                low = cell[:, f] <= m
                if p.least <= low.sum() <= len(y) - p.least:
                    a, b = (y - pred)[low].mean(), (y - pred)[~low].mean()
                    options.append((-(a * a * low.sum() + b * b * (~low).sum()), f, m, a, b))
        _, f, m, a, b = min(options)
        pred += p.step * np.where(cell[:, f] <= m, a, b)
    got = ML.AdditiveModel(bins, tuple(scores.tolist())).transform(data).orderBy("target_date").select("prediction").toPandas()["prediction"].to_numpy()
    assert rounds == p.rounds and np.abs(got - pred).max() < 1e-8


def test_pruned_search_keeps_the_winner(spark):
    rows = Q.features(spark, SF).persist()
    grid = [ML.StumpParams(rounds=60, step=s, bins=8) for s in (0.1, 0.3, 0.002, 0.001)]
    full = {r.trial_id: r for r in ML.tune_bias_models(rows, "HIGH", grid, folds=4, test_days=15, prune=False).collect()}
    cut = {r.trial_id: r for r in ML.tune_bias_models(rows, "HIGH", grid, folds=4, test_days=15).collect()}
    rows.unpersist()
    assert all(r.state == "COMPLETE" and r.fits_saved == 0 for r in full.values())
    assert [i for i, r in full.items() if r["rank"] == 1] == [i for i, r in cut.items() if r["rank"] == 1]
    assert cut[2].state == cut[3].state == "PRUNED" and cut[2]["rank"] is None and cut[0].state == "COMPLETE"
    assert cut[3].fold_mae == full[3].fold_mae[: len(cut[3].fold_mae)] and len(cut[3].fold_mae) == 2
    folds = len(full[0].fold_mae)
    assert abs(cut[0].fits_saved - 2 * (folds - 2) / (4 * folds)) < 1e-12 and folds > 2


def test_nothing_to_learn_from(spark):
    rows = Q.features(spark, SF)
    none = ML.fit_bias_models(rows.limit(0), "HIGH")
    assert none == {}
    out = ML.score_bias(none, rows.limit(3), "HIGH")
    assert out.count() == 3 and out.filter("bias_blend IS NOT NULL OR corrected IS NOT NULL").count() == 0
    assert ML.score_bias(none, rows.limit(0), "HIGH").count() == 0
    assert ML.tune_bias_models(rows.limit(0), "LOW", [ML.TreeParams(depth=1, rounds=1)], folds=2).count() == 0
