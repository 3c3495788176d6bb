"""Operators against plain loops, and block-wise forms against plain windows."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brierworks.operators import bias as K, ensemble as E, joins as J, ordering as O, pricing as P, selection as X, verification as V
from brierworks.params import DEFAULTS as D


def hot_series(n=4000, seed=1):
    """A third of all rows under one key, values with ties and NULLs."""
    r = random.Random(seed)
    return [(0 if i % 3 == 0 else r.randrange(1, 40), i, r.randrange(0, 500), None if r.random() < 0.2 else float(r.randrange(100))) for i in range(n)]


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(hot_series(), "k int, i int, t int, v double").repartition(7).cache()


@pytest.mark.parametrize("exclusive", [False, True])
def test_blocks_equal_window(hot, exclusive):
    measures = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "mx": ("max", F.col("v")), "mn": ("min", F.col("v")), "la": ("last", F.col("v"))}
    a = O.running(hot, ["k"], ["t", "i"], measures, None, exclusive=exclusive).toPandas().sort_values("i").reset_index(drop=True)
    b = O.running(hot, ["k"], ["t", "i"], measures, F.col("t"), n_blocks=13, exclusive=exclusive).toPandas().sort_values("i").reset_index(drop=True)
    b["n"], a["n"] = b["n"].fillna(0), a["n"].fillna(0)
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_percentiles_equal_numpy(hot):
    got = O.grouped_percentiles(hot, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.9}, 9).toPandas().set_index("k")
    for k, g in hot.filter("v IS NOT NULL").toPandas().groupby("k"):
        assert np.allclose(got.loc[k, ["lo", "mid", "hi"]].astype(float), np.quantile(g.v, [0.05, 0.5, 0.9]))


def test_block_sizes_are_balanced(hot):
    bounds = O.block_bounds(hot, F.col("t"), 10)
    sizes = hot.groupBy("k", O.block_of(F.col("t"), bounds).alias("b")).count().agg(F.max("count")).first()[0]
    assert sizes < 0.2 * hot.count()


def test_percentiles_of_values_that_many_groups_share(spark):
    """Far fewer values than blocks, each in every group: quantiles repeat, so blocks are cut inside a value."""
    rows = [(k, float(v)) for k in range(40) for v in range(3 + k % 4) for _ in range(1 + (k + v) % 3)] + [(None, 1.0), (0, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: (r["lo"], r["mid"]) for r in O.grouped_percentiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5}).collect()}
    want = {k: [v for j, v in rows if j == k and v is not None] for k in {k for k, _ in rows}}
    assert got.keys() == want.keys()
    for k, vs in want.items():
        assert got[k] == pytest.approx(tuple(np.quantile(vs, [0.05, 0.5])))


@pytest.mark.parametrize("strict", [True, False])
def test_asof_equals_merge_asof(spark, strict):
    r = random.Random(3)
    left = pd.DataFrame([(i, r.randrange(3) if i % 3 else 0, r.randrange(300)) for i in range(600)], columns=["i", "k", "t"])
    right = pd.DataFrame([(r.randrange(3), t, float(t)) for t in r.sample(range(300), 120)], columns=["k", "u", "x"])
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="k", allow_exact_matches=not strict)
    inst = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    ld = spark.createDataFrame(left).withColumn("lt", inst(F.col("t")))
    rd = spark.createDataFrame(right).withColumn("ut", inst(F.col("u")))
    got = J.asof_join(ld, rd, ["k"], "lt", "ut", ["x"], strict, n_blocks=7).toPandas()
    assert len(got) == len(left)
    pd.testing.assert_series_equal(got.sort_values("i")["x"].reset_index(drop=True), want.sort_values("i")["x"].reset_index(drop=True))


@pytest.mark.parametrize("salt", [1, 5])
def test_locate_bin(spark, salt):
    values = spark.createDataFrame([(i, 0 if i % 3 == 0 else i % 4, float(i % 97) - 20) for i in range(900)], "i int, g int, x double")
    edges = [None, 0.0, 3.5, 20.0, 21.0, 60.0, None]
    bins = spark.createDataFrame([(g, b, edges[b], edges[b + 1]) for g in range(4) for b in range(6)], "g int, b int, bin_lower double, bin_upper double")
    got = {r.i: r.b for r in J.locate_bin(values, bins, ["g"], "x", 7.0, salt).collect()}
    for r in values.collect():
        want = [b for b in range(6) if (edges[b] is None or r.x >= edges[b]) and (edges[b + 1] is None or r.x < edges[b + 1])]
        assert [got[r.i]] == want


def kalman_loop(days, eps):
    """Plain recursion over one key."""
    b, u, q_base, last, out, seen = D.b_init, D.u_init, 0.0, None, [], []
    for day, e in zip(days, eps):
        seen = [(d, x) for d, x in seen if d >= day - 30] + [(day, e)]
        xs = [x for _, x in seen]
        q = q_base + D.gamma * sum((x - b) ** 2 * (1.5 if x < b else 1.0) for x in xs[-5:])
        up = u + q + (2.0 * q * max(0, day - last - 1) if last is not None else 0.0)
        k = up / (up + D.r_default)
        b, u, last = b + k * (e - b), (1 - k) * up, day
        if len(xs) >= 2:
            ds = list(np.diff(xs))
            if len(ds) < 2:
                q_base = 0.01
            else:
                span = 90
                if len(ds) >= 20:
                    whole = np.var(ds)
                    if whole > 0:
                        ratio = np.var(ds[-20:]) / whole
                        span = 20 if ratio > 2 else int(90 - min(ratio / 2, 1) * 70)
                a, m, v = 2 / (span + 1), ds[0], 0.0
                for x in ds[1:]:
                    d = x - m
                    m, v = m + a * d, (1 - a) * (v + a * d * d)
                q_base = max(v, 1e-6)
        out.append((b, u, q, k))
    return out


def bias_input(spark, seed=5, n=120):
    r = random.Random(seed)
    rows = [(s, "HIGH", d, r.gauss(1, 2)) for s in (1, 2) for d in range(n) if r.random() > 0.15]
    return rows, spark.createDataFrame(rows, "station_id int, target_type string, d int, epsilon double").withColumn("target_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).drop("d")


@pytest.mark.parametrize("block_days", [1, 4, 64])
def test_kalman_at_block_edges(spark, block_days):
    """Series that end just before, at and after the end of a block, some with gaps, one with a given start."""
    rnd, rows = random.Random(block_days), []
    for s, n in enumerate((1, block_days, block_days + 1, 2 * block_days, 2 * block_days + 1, 5 * block_days + 3)):
        day = 0
        for _ in range(n):
            day += rnd.choice([1, 1, 1, 3])
            rows.append((s, "HIGH", day, rnd.gauss(0, 3)))
    df = spark.createDataFrame(rows, "station_id int, target_type string, d int, epsilon double").withColumn("target_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).drop("d")
    by = ["station_id", "target_type"]
    got = K.run_filter(K.with_noise(df, by), by, block_days=block_days).orderBy("station_id", "target_date").collect()
    want = [x for s in range(6) for x in kalman_loop([r[2] for r in rows if r[0] == s], [r[3] for r in rows if r[0] == s])]
    assert len(got) == len(want) == len(rows)
    for r, w in zip(got, want):
        assert (r.b_k, r.u_k) == pytest.approx(w[:2])
    for s in range(6):
        assert [r.state_version for r in got if r.station_id == s] == list(range(1, 1 + sum(x[0] == s for x in rows)))


def test_kalman_equals_loop(spark):
    rows, df = bias_input(spark)
    got = K.kalman_filter(df.repartition(5), ["station_id", "target_type"]).orderBy("station_id", "target_date").collect()
    want = [x for s in (1, 2) for x in kalman_loop([r[2] for r in rows if r[0] == s], [r[3] for r in rows if r[0] == s])]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert np.allclose((g.b_k, g.u_k, g.q_k, g.k_k), w, rtol=1e-9) and 0 < g.k_k < 1


def test_replay_equals_recompute(spark):
    _, df = bias_input(spark, 9)
    by = ["station_id", "target_type"]
    changed = F.expr("station_id = 1 AND target_date BETWEEN '2024-02-01' AND '2024-02-03'")
    fixed = df.withColumn("epsilon", F.when(changed, F.col("epsilon") + 5).otherwise(F.col("epsilon")))
    out = K.kalman_replay(K.kalman_filter(df, by), fixed, df.filter(changed).select(*by, "target_date"), by)
    a = out.orderBy("station_id", "target_date").select("b_k", "u_k").collect()
    b = K.kalman_filter(fixed, by).orderBy("station_id", "target_date").select("b_k", "u_k").collect()
    assert np.allclose(a, b)
    assert out.filter("is_amendment").select("station_id").distinct().collect()[0][0] == 1


def two_means(vs):
    s = sorted(vs)
    c1, c2 = s[len(s) // 4], s[3 * len(s) // 4]
    for _ in range(50):
        a = [v for v in s if abs(v - c1) <= abs(v - c2)]
        b = [v for v in s if abs(v - c1) > abs(v - c2)]
        if not a or not b:
            break
        c1, c2 = sum(a) / len(a), sum(b) / len(b)
    return min(c1, c2), max(c1, c2)


def test_two_means(spark):
    assert two_means((1, 1.5, 2, 10, 10.5, 11)) == (1.5, 10.5)
    r = random.Random(2)
    groups = {g: [r.gauss(0 if r.random() < 0.5 else 12, 1.5) for _ in range(9)] for g in range(60)}
    df = spark.createDataFrame([(g, v, float(np.std(vs, ddof=1))) for g, vs in groups.items() for v in vs], "g int, f double, s double")
    got = {x.g: (x.centroid_1, x.centroid_2) for x in E.detect_bimodal(df, ["g"]).collect()}
    assert len(got) > 10
    for g, c in got.items():
        assert np.allclose(c, two_means(groups[g]))


def kelly_loop(cands):
    chosen, sp, sc = [], 0.0, 0.0
    for t, p, c in sorted([x for x in cands if x[2] > 0 and x[1] / x[2] > 1], key=lambda x: (-x[1] / x[2], x[0])):
        if 1 - sc <= 0 or p / c <= (1 - sp) / (1 - sc):
            break
        chosen.append((t, p, c))
        sp, sc = sp + p, sc + c
    ratio = (1 - sp) / max(1 - sc, 1e-9)
    return {t: max(0.0, p - c * ratio) for t, p, c in chosen}


def test_kelly_equals_loop(spark):
    r = random.Random(4)
    rows = []
    for g in range(80):
        w = [r.random() for _ in range(6)]
        rows += [(g, f"T{i}", x / sum(w), max(0.01, x / sum(w) + r.uniform(-0.15, 0.15))) for i, x in enumerate(w)]
    df = spark.createDataFrame(rows, "g int, ticker string, p_win double, price double")
    got = {}
    for x in X.kelly_exclusive(df, ["g"]).collect():
        got.setdefault(x.g, {})[x.ticker] = x.f_star
    for g in range(80):
        want = kelly_loop([(t, p, c) for gg, t, p, c in rows if gg == g])
        have = got.get(g, {})
        assert set(have) == set(want) and all(math.isclose(have[t], want[t], abs_tol=1e-12) for t in want)
        assert sum(have.values()) <= 1 + 1e-9


def test_prices_sum_to_one(spark):
    df = spark.createDataFrame([(g, 60.0 + g, 1.0 + g / 7, (g % 9 - 4) / 5) for g in range(40)], "station_id int, mu double, sigma_eff double, g1 double")
    df = df.withColumn("target_date", F.lit("2024-05-01").cast("date")).withColumn("target_type", F.lit("HIGH"))
    book = P.price_book(df.withColumn("b_k", F.lit(0.0)))
    sums = book.groupBy("station_id").agg(F.sum("p_win").alias("s"), F.min("p_win").alias("m"), F.count("*").alias("n")).collect()
    assert all(abs(x.s - 1) < 2e-3 and x.m >= 0.0009 and x.n == 15 for x in sums)


def test_skew_cdf_against_integration(spark):
    zs, alphas = np.linspace(-4, 4, 17), (-6.0, -1.0, -0.3, 0.0, 0.7, 2.5, 10.0)
    df = spark.createDataFrame([(float(z), a) for z in zs for a in alphas], "z double, alpha double")
    from brierworks.functions.normal import with_skew_cdf

    erf = np.vectorize(math.erf)
    for r in with_skew_cdf(df, "z", "alpha", "c").collect():
        t = np.linspace(-12, r.z, 40001)
        y = 2 * np.exp(-t * t / 2) / math.sqrt(2 * math.pi) * 0.5 * (1 + erf(r.alpha * t / math.sqrt(2)))
        assert abs(np.trapezoid(y, t) - r.c) < 1e-6


def test_hysteresis_equals_loop(spark):
    r = random.Random(8)
    rows = [(k, i, None if r.random() < 0.1 else r.uniform(-0.05, 0.15)) for k in range(5) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, i int, bss double")
    got = {(x.k, x.i): x.qualified for x in V.hysteresis(df, ["k"], "i").collect()}
    for k in range(5):
        q = False
        for _, i, b in [x for x in rows if x[0] == k]:
            q = False if b is None else (b >= 0.03 if q else b >= 0.07)
            assert got[(k, i)] == q


def test_seasonal_mean_wraps(spark):
    df = spark.createDataFrame([(1, "2023-12-31", 10.0), (1, "2024-01-03", 20.0), (1, "2024-06-01", 99.0)], "k int, d string, v double").withColumn("d", F.to_date("d"))
    got = {r.doy: r.seasonal_mean for r in J.seasonal_mean(df, ["k"], "d", "v").collect()}
    assert got[1] == 15.0 and got[153] == 99.0 and got[365] == 15.0 and 100 not in got


def test_results_ignore_partitioning(spark):
    df = spark.createDataFrame(hot_series(1500, 6), "k int, i int, t int, v double")
    spec = {"s": ("sum", F.col("v"))}
    base = sorted(O.running(df.coalesce(1), ["k"], ["t", "i"], spec, F.col("t")).select("i", "s").collect())
    assert base == sorted(O.running(df.repartition(23), ["k"], ["t", "i"], spec, F.col("t"), n_blocks=5).select("i", "s").collect())


def test_empty_and_null_inputs(spark):
    empty = spark.createDataFrame([], "k int, i int, t int, v double")
    assert O.running(empty, ["k"], ["t", "i"], {"s": ("sum", F.col("v"))}, F.col("t")).count() == 0
    assert O.grouped_percentiles(empty, ["k"], "v", {"m": 0.5}).count() == 0
    nulls = spark.createDataFrame([(1, 1, 1, None), (1, 2, 2, None)], "k int, i int, t int, v double")
    assert [r.s for r in O.running(nulls, ["k"], ["t", "i"], {"s": ("last", F.col("v"))}, F.col("t")).collect()] == [None, None]
    assert V.skew(nulls, "v", ["k"]).first().g == 0.0


def test_latest_per_key_prunes_before_shuffle(hot):
    plan = O.latest_per_key(hot, ["k"], [F.col("t").desc(), F.col("i")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_null_keys_agree_in_both_forms(spark):
    from brierworks.operators import joins as J, ordering as O

    rows = [(i % 3 or None, float(i // 2), i) for i in range(60)]
    left = spark.createDataFrame(rows, "k int, t double, i int")
    right = spark.createDataFrame([(i % 3 or None, float(i), i * 10) for i in range(0, 30, 2)], "k int, t double, v int")
    stamp = lambda df: df.withColumn("t", F.timestamp_seconds("t"))
    out = [sorted(map(str, J.asof_join(stamp(left), stamp(right), ["k"], "t", "t", ["v"], bounded=b).collect())) for b in (True, False)]
    assert out[0] == out[1] and len(out[0]) == 60
    got = O.positions(left, ["k"], "t", ["i"]).collect()
    want = {}
    for k in (None, 1, 2):
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = n
    assert {r.i: r.pos for r in got} == want


def test_folds_are_unstable_by_their_mean(spark):
    from brierworks.operators import verification as V

    rows = [(1, "HIGH", "a", 1, 1.0, "COMPLETE", [100.0, 190.0], [1.0, 1.45]), (2, "HIGH", "a", 1, 1.0, "COMPLETE", [100.0, 500.0], [1.0, 1.0]), (3, "HIGH", "a", 1, 1.0, "COMPLETE", [100.0], [9.0]), (4, "HIGH", "a", 1, 1.0, "COMPLETE", [5.0, 5.0], [1.0, 1.6])]
    df = spark.createDataFrame(rows, "station_id int, target_type string, model string, trial_id int, value double, state string, fold_rounds array<double>, fold_mae array<double>")
    assert {r.station_id: r.unstable for r in V.trial_diagnostics(df).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_report_day_falls_back_to_a_month_that_has_it(spark):
    from brierworks.sources import reports as RP

    rows = [("KJFK 311456Z 18012KT 22/14", "2024-03-05 00:00:00"), ("KJFK 041456Z 18012KT 22/14", "2024-03-05 00:00:00"), ("KJFK 301456Z 18012KT 22/14", "2024-03-05 00:00:00")]
    df = spark.createDataFrame(rows, "raw string, received_at string").withColumn("received_at", F.to_timestamp("received_at"))
    got = {r.raw[5:7]: str(r.observed_at)[:10] for r in RP.decode_metar(df).collect()}
    assert got == {"31": "2024-01-31", "04": "2024-03-04", "30": "2024-01-30"}


def test_city_of_four_words(spark):
    from brierworks.sources import listings as L

    events = spark.createDataFrame([("E-1", None, "High in Salt Lake City Airport tomorrow?"), ("E-2", None, "High in Salt Lake tomorrow?")], "event_ticker string, series_ticker string, title string")
    stations = spark.createDataFrame([("KSLC", "Salt Lake City Airport", None, None, None), ("KX", "", None, None, None)], "station_id string, city string, city_code string, series_high string, series_low string")
    assert {r.event_ticker: r.station_id for r in L.match_station(events, stations).collect()} == {"E-1": "KSLC", "E-2": None}


def test_markets_of_odd_tickers_and_strikes(spark):
    import json

    from brierworks.sources import listings as L

    def market(ticker, **more):
        return {"ticker": ticker, "status": "open", "yes_ask": 42} | more

    docs = {
        "whole": [market("S-24JAN05-T59"), market("S-24JAN05-B61"), market("S-24JAN05-B63"), market("S-24JAN05-T65"), None, market(None)],
        "half": [market("S-69dec31-B61.5"), market("S-68DEC31-B64.5"), market("S-24FEB29-T70"), market("S-24FEB29-T60")],
        "strike": [market("S-24JAN05-X", strike_type="less", cap_strike=50), market("S-24JAN05-X", floor_strike=55), market("S-24JAN05-X", strike_type="less")],
        "days": [market("S-23FEB29-B61"), market("S-24ANJ05-B61"), market("S-24JAN5-B61"), market("S-24JAN05"), market("S")],
        "gone": [market("S-24JAN05-B61")],
    }
    raw = spark.createDataFrame([(k, json.dumps({"event_ticker": k, "markets": ms})) for k, ms in docs.items()], "k string, raw_json string")
    ignored = spark.createDataFrame([("gone",), (None,)], "event_ticker string")
    rows = L.decode_markets(L.parse_events(raw), ignored).collect()
    got = sorted((r.k, str(r.target_date), r.is_tail, r.bin_lower or 0.0, r.bin_upper or 0.0, r.yes_ask) for r in rows)
    jan, zero = "2024-01-05", 0.0
    assert got == sorted([
        ("whole", jan, True, zero, 59.5, 0.42), ("whole", jan, False, 60.5, 62.5, 0.42), ("whole", jan, False, 62.5, 64.5, 0.42), ("whole", jan, True, 64.5, zero, 0.42),
        ("half", "1969-12-31", False, 61.5, 64.5, 0.42), ("half", "2068-12-31", False, 64.5, 67.5, 0.42),
        ("half", "2024-02-29", True, 67.5, zero, 0.42), ("half", "2024-02-29", True, zero, 61.5, 0.42),
        ("strike", jan, False, zero, 50.5, 0.42), ("strike", jan, False, 54.5, zero, 0.42),
    ])


def crowded_rows(n=12_000, seed=4):
    """40 % of all rows on one instant of one key, another 20 % on one instant of many keys, open edges included."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        x = r.random()
        k, t = (1, 50) if x < 0.4 else (r.randrange(40), 70) if x < 0.6 else (r.randrange(40), None if x < 0.7 else r.randrange(200))
        out.append((k, t, i, float(r.randrange(100))))
    return out


def test_crowded_instants_are_split(spark):
    rows = crowded_rows()
    df = spark.createDataFrame(rows, "k int, t int, i int, v double").repartition(6)
    cut = O.blocks(df, ["k"], ["t", "i"], F.col("t"), 16).cache()
    sizes = [r["count"] for r in cut.groupBy("_blk").count().collect()]
    assert max(sizes) <= 1.5 * len(rows) / 16
    ordered = sorted((r._blk, r.t is not None, r.t or 0, r.k, r.i) for r in cut.collect())
    per_key = {}
    for blk, known, t, k, i in ordered:  # blocks follow the order within every key
        per_key.setdefault(k, []).append((known, t, i, blk))
    for mine in per_key.values():
        assert [m[3] for m in sorted(mine)] == sorted(m[3] for m in mine)
    measures = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "la": ("last", F.col("v"))}
    a = O.running(df, ["k"], ["t", "i"], measures, None).orderBy("i").collect()
    b = O.running(df, ["k"], ["t", "i"], measures, F.col("t"), n_blocks=16).orderBy("i").collect()
    assert a == b
    pos = O.positions(df, ["k"], "t", ["i"], nulls="last")
    for k in (0, 1):
        want = [r[2] for r in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is None, x[1] or 0, x[2]))]
        assert [r.i for r in pos.where(F.col("k") == k).orderBy("pos").collect()] == want


def test_asof_on_a_crowded_instant(spark):
    rows = crowded_rows(3000)
    left = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=t), i) for k, t, i, _ in rows if t is not None], "k int, at timestamp_ntz, i int")
    right = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=t), v) for k, t, i, v in rows if t is not None and i % 3 == 0], "k int, seen timestamp_ntz, v double")
    got = {r.i: r.v for r in J.asof_join(left, right, ["k"], "at", "seen", ["v"], n_blocks=16).collect()}
    held = sorted((k, t, v) for k, t, i, v in rows if t is not None and i % 3 == 0)
    assert len(got) == sum(t is not None for _, t, _, _ in rows)
    for k, t, i, _ in rows:
        if t is not None:
            before = [h for h in held if h[0] == k and h[1] < t]
            assert got[i] in ({h[2] for h in before if h[1] == before[-1][1]} if before else {None})


def test_dashboard_against_numpy(spark):
    """Windows nest; a cell may hold several rows of one day, days without rows, equal values and NULL errors."""
    rng = np.random.default_rng(11)
    last = dt.date(2024, 3, 31)
    rows = [("S", str(c), "HIGH", "h1", last - dt.timedelta(int(a)), None if rng.random() < 0.1 else float(v), None)
            for c in range(4) for a, v in zip(rng.integers(-2, 40, 30), rng.integers(-6, 7, 30) / 4.0)]
    rows += [("S", "flat", "HIGH", "h1", last - dt.timedelta(k), 0.1, None) for k in range(6)]
    df = spark.createDataFrame(rows, "station_id string, source_id string, target_type string, lead_bracket string, target_date date, error_raw double, error_adjusted double")
    windows = (2, 7, 30)
    got = {(r.source_id, r.window_days): r for r in V.dashboard(df, F.lit(last), windows).collect()}
    want = {}
    for c in {r[1] for r in rows}:
        for w in windows:
            e = np.array([r[5] for r in rows if r[1] == c and r[5] is not None and 0 <= (last - r[4]).days <= w])
            if len(e):
                want[c, w] = e
    assert set(got) == set(want)
    for key, e in want.items():
        r, d = got[key], e - e.mean()
        skew = 0.0 if len(e) < 3 or np.ptp(e) == 0 else (d**3).mean() / (d**2).mean() ** 1.5
        hand = [len(e), e.mean(), abs(e).mean(), np.sqrt((e * e).mean()), *np.percentile(e, [10, 25, 50, 75, 90]), (abs(e) <= 0.5).mean(), (abs(e) <= 1).mean(), (e > 0).mean(), (e < 0).mean(), skew]
        mine = [r.n, r.bias, r.mae, r.rmse, r.p10, r.p25, r.p50, r.p75, r.p90, r.pct_within_05, r.pct_within_1, r.pct_over, r.pct_under, r.skew_biased]
        assert np.allclose(hand, mine, atol=1e-9), key
