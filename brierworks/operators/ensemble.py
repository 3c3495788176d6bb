"""Combining sources into one predictive distribution.

All windows here run inside one (station, date, type) group of latest-per-source rows, whose size is
the number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.functions.scalar import shrink, sigma_eff, unbiased_skew
from brierworks.operators.ordering import join_keys, latest_per_key
from brierworks.operators.verification import CELL, GROUP, recent_errors, used_errors
from brierworks.params import DEFAULTS, Params
from brierworks.session import cut_lineage


def source_skill(errors: DataFrame, by: list[str] = CELL, min_n: int = 5, asof: Column | None = None, p: Params = DEFAULTS) -> DataFrame:
    """AGG-08: 1 - MSE / worst MSE among sources with enough rows in the window before ``asof``; a lone
    eligible source gets 1."""
    e = F.col("e")
    mse = (
        used_errors(recent_errors(errors, asof, p))
        .groupBy(*by, "source_id")
        .agg(F.avg(e * e).alias("mse"), F.count("e").alias("n"))
        .filter(F.col("n") >= min_n)
    )
    return skill_from_mse(mse, by)


def skill_from_mse(mse: DataFrame, by: list[str]) -> DataFrame:
    cell = Window.partitionBy(*by)
    worst = F.max("mse").over(cell)
    skill = (
        F.when(F.count(F.lit(1)).over(cell) == 1, 1.0)
        .when(worst <= 0, 0.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("mse") / worst))
    )
    return mse.withColumn("skill", skill)


def top_source(df: DataFrame, by: list[str], skill: str = "skill", fallback: str | None = None) -> DataFrame:
    """W-02: best source per group. Without any positive skill the stored ``fallback`` source is used
    where it takes part, else the first source by name."""
    s = F.coalesce(F.col(skill), F.lit(0.0))
    stored = F.when(F.col("source_id") == F.col(fallback), 1).otherwise(0) if fallback else F.lit(0)
    return latest_per_key(df, by, [s.desc(), stored.desc(), F.col("source_id")])


def entropy_weights(df: DataFrame, by: list[str], skill: str = "skill", p: Params = DEFAULTS, lam: float | None = None, floor: Column | None = None) -> DataFrame:
    """AGG-33 / W-21: weights maximising sum(w * skill) + lam * entropy(w) with sum 1 and a floor.

    The optimum is a softmax over the best sources with the rest held at the floor. Taking sources
    by falling skill, the free set is the longest prefix whose smallest weight still reaches the
    floor, so running sums decide it exactly.
    """
    lam = p.entropy_lambda if lam is None else lam
    grp = Window.partitionBy(*by)
    ranked = grp.orderBy(F.col("_skill").desc(), F.col("source_id"))
    prefix = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.col("_m")
    low = F.lit(p.weight_min_factor) / m if floor is None else floor
    out = (
        df.withColumn("_skill", F.coalesce(F.col(skill), F.lit(0.0)))
        .withColumn("_m", F.count(F.lit(1)).over(grp))
        .withColumn("_best", F.max("_skill").over(grp))
        .withColumn("_e", F.exp((F.col("_skill") - F.col("_best")) / lam))
        .withColumn("_k", F.row_number().over(ranked))
        .withColumn("_cum", F.sum("_e").over(prefix))
        .withColumn("_low", low)
        .withColumn("_free", 1.0 - (m - F.col("_k")) * F.col("_low"))
        .withColumn("_ok", F.col("_free") * F.col("_e") / F.col("_cum") >= F.col("_low"))
        .withColumn("_kmax", F.max(F.when(F.col("_ok"), F.col("_k"))).over(grp))
        .withColumn("_cmax", F.max(F.when(F.col("_k") == F.col("_kmax"), F.col("_cum"))).over(grp))
    )
    share = (1.0 - (m - F.col("_kmax")) * F.col("_low")) * F.col("_e") / F.col("_cmax")
    weight = F.when((F.col("_best") <= 0) | (m == 1), 1.0 / m).when(F.col("_k") <= F.col("_kmax"), share).otherwise(F.col("_low"))
    return out.withColumn("weight", weight).select(*df.columns, "weight")


def decay_weights(df: DataFrame, by: list[str], age_hours: str, weight: str = "weight", p: Params = DEFAULTS) -> DataFrame:
    """AGG-32: older issues count less; weights are renormalised and stale sources flagged."""
    grp = Window.partitionBy(*by)
    factor = F.when(F.col(age_hours) > 0, F.exp(-F.col(age_hours) / (p.staleness_tau_days * 24.0))).otherwise(1.0)
    out = df.withColumn("_f", factor).withColumn("_d", F.col(weight) * F.col("_f"))
    total = F.sum("_d").over(grp)
    share = F.when(total > 0, F.col("_d") / total).otherwise(1.0 / F.count(F.lit(1)).over(grp))
    return out.withColumn(weight, share).withColumn("is_stale", F.col("_f") < 0.5).drop("_f", "_d")


def ensemble_spread(df: DataFrame, by: list[str], f: str = "f", weight: str = "weight") -> DataFrame:
    """AGG-09: weighted mean, sample spread and weighted spread; zero spread for a lone source."""
    grp = Window.partitionBy(*by)
    centred = df.withColumn("_bar", F.sum(F.col(weight) * F.col(f)).over(grp))
    d = F.col(f) - F.col("_bar")
    lone = F.count(F.lit(1)) <= 1
    return centred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("m_k"),
        F.max("_bar").alias("f_bar"),
        F.when(lone, 0.0).otherwise(F.stddev_samp(f)).alias("s_unweighted"),
        F.when(lone, 0.0).otherwise(F.sqrt(F.sum(F.col(weight) * d * d))).alias("s_weighted"),
    )


def _two_means(vs: Column, rounds: int = 50) -> Column:
    """Lloyd iteration with two centres on a short sorted array, from the quartile values. Rounds
    after convergence pass the centres on without looking at the values."""
    n = F.size(vs)
    state = lambda c1, c2, done: F.struct(c1.alias("c1"), c2.alias("c2"), done.alias("done"))
    start = state(vs[F.floor(n / 4).cast("int")], vs[F.floor(3 * n / 4).cast("int")], F.lit(False))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)

    def step(s: Column, _: Column) -> Column:
        near = F.filter(vs, lambda v: F.abs(v - s["c1"]) <= F.abs(v - s["c2"]))
        far = F.filter(vs, lambda v: F.abs(v - s["c1"]) > F.abs(v - s["c2"]))
        split = F.array(F.struct(near.alias("a"), far.alias("b")))
        both = lambda t: (F.size(t["a"]) > 0) & (F.size(t["b"]) > 0)
        centres = F.transform(split, lambda t: F.when(both(t), F.struct(mean(t["a"]).alias("c1"), mean(t["b"]).alias("c2"))))
        close = lambda c: (F.abs(c["c1"] - s["c1"]) < 1e-6) & (F.abs(c["c2"] - s["c2"]) < 1e-6)
        moved = F.transform(centres, lambda c: F.when(c.isNull(), state(s["c1"], s["c2"], F.lit(True))).otherwise(state(c["c1"], c["c2"], close(c))))
        return F.when(s["done"], s).otherwise(moved[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def detect_bimodal(df: DataFrame, by: list[str], f: str = "f", spread: str = "s", p: Params = DEFAULTS) -> DataFrame:
    """AGG-24: two-cluster regimes. ``df`` has one row per group and source plus the group's spread."""
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(f)).alias("_v"), F.max(spread).alias("_sp"))
    found = with_regime(grouped, "_v", "_sp", p).filter(F.col("centroid_1").isNotNull())
    return found.select(*by, "centroid_1", "centroid_2", "size_1", "size_2", "iqr_ratio")


def with_regime(df: DataFrame, values: str, spread: str, p: Params = DEFAULTS) -> DataFrame:
    """AGG-24 on sorted arrays (one short array per group): the two centres and sizes, NULL where the
    group has one regime."""
    v, s = F.col(values), F.col(spread)
    n = F.size(v)
    iqr = F.get(v, F.floor(3 * n / 4).cast("int")) - F.get(v, F.floor(n / 4).cast("int"))
    near = F.size(F.filter(v, lambda x: F.abs(x - F.col("_c.c1")) <= F.abs(x - F.col("_c.c2"))))
    swap = F.col("_c.c1") > F.col("_c.c2")
    out = (
        df.withColumn("iqr_ratio", F.when((n >= 4) & (s > 0), iqr / F.when(s > 0, s)))
        # groups failing the cheap test never reach the iteration
        .withColumn("_c", F.when(F.col("iqr_ratio") > p.bimodal_iqr, _two_means(v)))
        .withColumn("_n1", F.when(F.col("_c").isNotNull(), near))
    )
    gap = F.abs(F.col("_c.c2") - F.col("_c.c1"))
    small = F.least(F.col("_n1"), n - F.col("_n1")) / n
    ok = (gap >= p.bimodal_centroid * s) & (small >= p.bimodal_min_frac)
    return out.select(
        *df.columns,
        F.when(ok, F.least("_c.c1", "_c.c2")).alias("centroid_1"),
        F.when(ok, F.greatest("_c.c1", "_c.c2")).alias("centroid_2"),
        F.when(ok, F.when(swap, n - F.col("_n1")).otherwise(F.col("_n1"))).alias("size_1"),
        F.when(ok, F.when(swap, F.col("_n1")).otherwise(n - F.col("_n1"))).alias("size_2"),
        "iqr_ratio",
    )


def source_stats(errors: DataFrame, by: list[str] = CELL, min_n: int = 5, asof: Column | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Everything the ensemble needs from the error history, one row per cell and source."""
    e = F.col("e")
    sums = used_errors(recent_errors(errors, asof, p)).groupBy(*by, "source_id").agg(
        F.count("e").alias("n"), F.sum(e * e).alias("ssq"), F.skewness("e").alias("g")
    )
    cell = Window.partitionBy(*by)
    mse = F.when(F.col("n") >= min_n, F.col("ssq") / F.col("n"))
    worst, eligible = F.max(mse).over(cell), F.count(mse).over(cell)
    skill = F.when(mse.isNull(), 0.0).when(eligible == 1, 1.0).when(worst <= 0, 0.0)
    return sums.withColumn("skill", skill.otherwise(F.greatest(F.lit(0.0), 1.0 - mse / worst)))


def ensemble_state(
    fc: DataFrame,
    errors: DataFrame,
    bias: DataFrame | None = None,
    text_mods: DataFrame | None = None,
    regime: bool = True,
    p: Params = DEFAULTS,
    asof: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """KAL-05: the ensemble of every (station, date, type) group and its weight rows.

    ``fc`` holds the latest forecast per source: station_id, target_date, target_type, source_id, f,
    lead_bracket, age_hours. ``bias`` holds b_k (and optionally a stored top_source) per station and
    type, ``text_mods`` a sigma multiplier per station. With ``asof``, only groups of that day and
    later are combined, from errors of the trailing window before it: nothing looks ahead.

    The error statistics and the weighted rows are each needed more than once; both are written to
    the shared checkpoint folder, so the raw tables are read once and a lost executor costs nothing
    upstream.
    """
    if asof is not None:
        fc = fc.filter(F.col("target_date") >= asof)
    stats = cut_lineage(source_stats(errors, asof=asof, p=p))
    pooled = stats.groupBy("target_type", "lead_bracket").agg(F.sqrt(F.sum("ssq") / F.sum("n")).alias("pooled"))

    rows = fc.join(stats.drop("ssq"), [*CELL, "source_id"], "left").withColumn("skill", F.coalesce("skill", F.lit(0.0)))
    if bias is not None:
        rows = join_keys(rows, bias, ["station_id", "target_type"], "left")
    stored = F.when(F.col("source_id") == F.col("top_source"), 0).otherwise(1) if "top_source" in rows.columns else F.lit(0)
    b_k = F.coalesce(F.first("b_k"), F.lit(0.0)) if bias is not None else F.lit(0.0)
    weights = cut_lineage(decay_weights(entropy_weights(rows, GROUP, "skill", p), GROUP, "age_hours", "weight", p))

    # the group is already co-located by the weight windows; one aggregate yields the rest
    d = F.col("f") - F.col("_bar")
    lone = F.count(F.lit(1)) <= 1
    top = F.min_by(
        F.struct("source_id", "f", "lead_bracket", "n", "g"), F.struct(-F.col("skill"), stored, F.col("source_id"))
    )
    centred = weights.withColumn("_bar", F.sum(F.col("weight") * F.col("f")).over(Window.partitionBy(*GROUP)))
    state = centred.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("m_k"),
        F.max("_bar").alias("f_bar"),
        F.when(lone, 0.0).otherwise(F.stddev_samp("f")).alias("s_unweighted"),
        F.when(lone, 0.0).otherwise(F.sqrt(F.sum(F.col("weight") * d * d))).alias("s_weighted"),
        top.alias("_top"),
        F.array_sort(F.collect_list("f")).alias("_v"),
        F.collect_list("source_id").alias("_sources"),
        b_k.alias("b_k"),
    )
    gn, g = F.col("_top.n"), F.col("_top.g")
    state = state.withColumn("top_source", F.col("_top.source_id")).withColumn("f_top", F.col("_top.f"))
    state = state.withColumn("lead_bracket", F.col("_top.lead_bracket")).withColumn(
        "g1", F.coalesce(F.when(F.isnan(g), 0.0).otherwise(unbiased_skew(gn, g, p)), F.lit(0.0))
    )
    # sigma of the group's sources at the top source's bracket
    members = state.select(*GROUP, "lead_bracket", F.explode("_sources").alias("source_id"))
    own = (
        members.join(stats.select(*CELL, "source_id", "n", "ssq"), [*CELL, "source_id"])
        .groupBy(*GROUP)
        .agg(F.sum("n").alias("_n"), F.sqrt(F.sum("ssq") / F.sum("n")).alias("_rmse"))
    )
    shrunk = shrink(F.col("_n"), F.col("_rmse"), F.coalesce("pooled", F.lit(p.sigma_default)), p)
    # a handful of (type, bracket) keys: never shuffle the groups on them
    state = join_keys(state.join(own, GROUP, "left"), pooled, ["target_type", "lead_bracket"], "left")
    state = state.withColumn("sigma_adj", F.coalesce(shrunk, F.lit(p.sigma_default)))
    if regime:
        gap = F.col("centroid_2") - F.col("centroid_1")
        inflated = F.least(F.greatest(F.col("sigma_adj"), gap / 2.0), F.lit(p.sigma_cap))
        state = with_regime(state, "_v", "s_unweighted", p).withColumn(
            "sigma_adj", F.when(gap.isNotNull(), inflated).otherwise(F.col("sigma_adj"))
        )
    mod = F.lit(1.0)
    if text_mods is not None:
        state = join_keys(state, text_mods.select("station_id", "sigma_mult"), ["station_id"], "left")
        mod = F.coalesce("sigma_mult", F.lit(1.0))
    state = state.withColumn("sigma_eff", sigma_eff(F.col("sigma_adj"), F.col("s_weighted"), mod, p))
    state = state.withColumn("mu", F.col("f_top") + F.col("b_k"))
    keep = [*GROUP, "top_source", "lead_bracket", "f_top", "f_bar", "s_unweighted", "s_weighted", "sigma_adj", "sigma_eff", "g1", "b_k", "mu", "m_k"]
    if regime:
        keep += ["centroid_1", "centroid_2", "size_1", "size_2"]
    return state.select(*keep), weights.select(*GROUP, "source_id", "lead_bracket", "weight", "skill", "is_stale")
