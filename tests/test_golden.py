"""Worked examples with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from brierworks.functions import scalar as S
from brierworks.operators import ensemble as E, pricing as P, selection as X
from brierworks.sources import reports as RP


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_metar(spark):
    raw = [
        ("KJFK 291456Z 18012G20KT 10SM SCT040 BKN250 22/14 A2998",),
        ("KJFK 291456Z 00000KT 10SM M02/M08 A2998",),
        ("KJFK 291456Z VRB05KT 10SM A2998",),
    ]
    df = spark.createDataFrame(raw, "raw string").withColumn("received_at", F.lit("2026-03-29 15:00:00").cast("timestamp"))
    rows = RP.decode_metar(df).orderBy(F.desc("temp_f")).collect()
    assert [(r.temp_f, r.dewpoint_f, r.wind_kt, r.wind_dir) for r in rows] == [(71.6, 57.2, 12, 180), (28.4, 17.6, 0, 0)]
    assert str(rows[0].observed_at) == "2026-03-29 14:56:00"



@pytest.mark.parametrize(
    "text,want",
    [
        ("High confidence in this", ("HIGH", 0, None, 1.0)),
        ("A challenging setup. Models disagree and the model spread is large.", ("LOW", 1, None, 1.25)),
        ("warmer than guidance", ("NEUTRAL", 0, "WARM_BIAS", 1.0)),
        ("cooler than guidance", ("NEUTRAL", 0, "COOL_BIAS", 1.0)),
        ("plain text", ("NEUTRAL", 0, None, 1.0)),
    ],
)
def test_discussion(spark, text, want):
    r = RP.scan_discussions(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.confidence, r.disagreement, r.direction, r.sigma_mult) == want


def test_lead_brackets(spark):
    got = spark.createDataFrame([(-1.0,), (0.0,), (11.99,), (12.0,), (24.0,), (48.0,), (72.0,)], "h double").select(S.lead_bracket(F.col("h")).alias("b"))
    assert [r.b for r in got.collect()] == [None, "h1", "h1", "h2", "h3", "h4", "h5"]


def test_fees(spark):
    r = one(spark, order=S.order_fee(F.lit(0.5), F.lit(10), 0.07), ev1=S.net_ev(F.lit(0.6), F.lit(0.45), 0.07), ev2=S.net_ev(F.lit(0.4), F.lit(0.5), 0.07))
    assert r.order == 18 and r.ev1 > 0 > r.ev2
    fills = spark.createDataFrame([(1, 0.5, 33.0), (1, 0.5, 33.0), (1, 0.5, 34.0)], "k int, price double, contracts double")
    f = X.fill_fees(fills, ["k"], 0.07).first()
    assert (f.fill_fee_cents, f.order_fee_cents) == (176, 175)


def test_scales(spark):
    r = one(
        spark, a=S.skill_scale(F.lit(0.25)), b=S.skill_scale(F.lit(0.125)), c=S.skill_scale(F.lit(0.01)),
        d=S.drawdown_scale(F.lit(0.05)), e=S.drawdown_scale(F.lit(0.15)), f=S.drawdown_scale(F.lit(0.25)),
    )
    assert (r.a, r.b, r.c, r.d, r.f) == (1.0, 0.5, 0.1, 1.0, 0.0) and math.isclose(r.e, 0.5)


def test_bic(spark):
    r = one(spark, a=S.bic(F.lit(100), F.lit(10.0), 3), b=S.bic(F.lit(0), F.lit(1.0), 1), c=S.bic(F.lit(5), F.lit(0.0), 1))
    assert math.isclose(r.a, 100 * math.log(0.1) + 3 * math.log(100)) and r.b == r.c == math.inf


def gate(spark, **over):
    base = {"p_win": 0.65, "price": 0.45, "n_bets": 5000, "spread": 2.0, "bss": 0.08, "was_qualified": False, "lead_hours": 48.0}
    row = {**base, **over}
    df = spark.createDataFrame([tuple(row.values())], "p_win double, price double, n_bets int, spread double, bss double, was_qualified boolean, lead_hours double")
    return X.evaluate_gates(df).first()


@pytest.mark.parametrize(
    "over,flag,want",
    [
        ({}, "edge", True), ({"p_win": 0.46}, "edge", False), ({"spread": 4.0}, "spread", True), ({"spread": 4.01}, "spread", False),
        ({"bss": 0.05}, "skill", False), ({"bss": 0.05, "was_qualified": True}, "skill", True), ({"bss": 0.02, "was_qualified": True}, "skill", False),
        ({"bss": None}, "skill", True), ({"lead_hours": 80.0}, "lead", False),
    ],
)
def test_gates(spark, over, flag, want):
    assert gate(spark, **over).gate_flags[flag] is want


def test_kelly_three_bins(spark):
    df = spark.createDataFrame([(1, "A", 0.25, 0.3), (1, "B", 0.5, 0.4), (1, "C", 0.25, 0.3)], "g int, ticker string, p_win double, price double")
    rows = X.kelly_exclusive(df, ["g"]).collect()
    assert [(r.ticker, round(r.f_star, 4)) for r in rows] == [("B", 0.1667)]
    assert X.kelly_exclusive(df.withColumn("price", F.lit(0.0)), ["g"]).count() == 0


def test_vwap(spark):
    book = spark.createDataFrame([(1, 42, 50.0), (1, 43, 30.0), (1, 44, 20.0), (2, 42, 10.0)], "t int, price int, quantity double")
    rows = {r.t: r for r in X.vwap(book, F.when(F.col("t") == 1, 60.0).otherwise(50.0), ["t"]).collect()}
    assert rows[1].filled == 60 and 0.42 < rows[1].vwap < 0.44 and rows[2].filled == 10


def test_tranches(spark):
    df = spark.createDataFrame([(1, 10), (2, 120)], "k int, contracts int")
    rows = X.split_tranches(df).collect()
    assert [r.tranche_contracts for r in rows if r.k == 1] == [10]
    big = [r.tranche_contracts for r in rows if r.k == 2]
    assert sum(big) == 120 and max(big) <= 25


def test_composite(spark):
    cols = "kcv_mod double, mpds_mod double, hmas_mod double, fct_mod double, scas_mod double, kcv_veto boolean, mpds_veto boolean, fct_veto boolean"
    df = spark.createDataFrame([(0.9, 0.8, 1.1, 1.0, 0.95, False, True, True), (0.1, 0.1, 0.1, 0.1, 0.1, False, False, False)], cols)
    a, b = X.signal_composite(df).orderBy(F.desc("composite")).collect()
    assert 0.85 < a.composite < 0.95 and a.veto_reason == "MPDS" and b.composite == 0.25 and not b.veto


def test_sizing(spark):
    base = "0.10D f_star, 0.20D bss, 0.95D composite, 1.0D gamma_scale, 1000.0D bankroll, 0.25D capacity, 0.45D price, 'T' ticker"
    df = spark.sql(f"SELECT {base}, 0.05D mdd UNION ALL SELECT {base}, 0.20D mdd")
    ok, halted = X.size_positions(df).orderBy(F.desc("contracts")).collect()
    assert ok.contracts > 0 and ok.skip_reason is None and halted.skip_reason == "below_minimum"
    assert sorted(X.size_positions(df, seed=7).collect()) == sorted(X.size_positions(df.repartition(3), seed=7).collect())


def test_entropy_weights(spark):
    df = spark.createDataFrame([(1, s, k) for s, k in zip("abcde", (0.8, 0.5, 0.1, 0.0, 0.45))], "g int, source_id string, skill double")
    got = {r.source_id: r.weight for r in E.entropy_weights(df, ["g"], floor=F.lit(0.01)).collect()}
    want = dict(zip("abcde", (0.90742, 0.045178, 0.01, 0.01, 0.027402)))
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want) and math.isclose(sum(got.values()), 1.0)


def test_source_skill(spark):
    rows = [("s1", 1.0)] * 6 + [("s2", 3.0)] * 6 + [("s3", 2.0)] * 2
    df = spark.createDataFrame(rows, "source_id string, error_raw double").withColumn("error_adjusted", F.lit(None).cast("double")).withColumn("c", F.lit(1))
    got = {r.source_id: r.skill for r in E.source_skill(df, ["c"]).collect()}
    assert math.isclose(got["s1"], 8 / 9) and got["s2"] == 0.0 and "s3" not in got
    alone = {r.source_id: r.skill for r in E.source_skill(df.filter("source_id = 's1'"), ["c"]).collect()}
    assert alone == {"s1": 1.0}


def test_bimodal(spark):
    two = (70, 70.5, 71, 70.2, 80, 80.5, 81, 80.2)
    near = (74, 74.5, 75, 75.2, 75.5, 75.7)
    df = spark.createDataFrame([(1, float(v), 2.0) for v in two] + [(2, float(v), 1.0) for v in near] + [(3, 1.0, 1.0), (3, 9.0, 1.0)], "g int, f double, s double")
    rows = E.detect_bimodal(df, ["g"]).collect()
    assert [r.g for r in rows] == [1] and rows[0].centroid_2 - rows[0].centroid_1 > 5 and (rows[0].size_1, rows[0].size_2) == (4, 4)


@pytest.mark.parametrize("g1,want", [(0.0, 0.26111732), (0.3, 0.26328694), (-0.5, 0.26143951)])
def test_skew_normal_bin(spark, g1, want):
    df = spark.createDataFrame([(1, 75.0, 3.0, g1, 74.0, 76.0)], "g int, mu double, sigma_eff double, g1 double, bin_lower double, bin_upper double")
    r = P.price_bins(P.skewnormal_params(df), ["g"]).first()
    assert abs(r.p_win - want) < 1e-7


def test_skew_params(spark):
    df = spark.createDataFrame([(75.0, 3.0, 0.3), (75.0, 3.0, -0.5), (75.0, 3.0, 0.0)], "mu double, sigma_eff double, g1 double")
    a, b, c = P.skewnormal_params(df).collect()
    assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip((a.xi, a.omega, a.alpha), (72.337597, 4.011034, 1.499191)))
    assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip((b.xi, b.omega, b.alpha), (78.156628, 4.354802, -2.173758)))
    assert (c.xi, c.omega, c.alpha) == (75.0, 3.0, 0.0)


def test_climate_report(spark):
    text = "CLINYC\nCLIMATE SUMMARY FOR MARCH 5 2024\nMAXIMUM TEMPERATURE: 55R\nMINIMUM: 38\n"
    r = RP.decode_climate_reports(spark.createDataFrame([(text,)], "text string")).first()
    assert (str(r.report_date), r.high_f, r.low_f, r.had_letter) == ("2024-03-05", 55.0, 38.0, True)
