"""Learned bias correction: features, tree ensembles, blending, scoring and reports.

One model per target type is trained over all stations at once, with a station's mean error so far as a feature,
so training is a distributed job and new stations need no new model.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool
from statistics import median

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.functions.scalar import cyclic_day
from brierworks.operators.joins import sweep, sweep_best
from brierworks.operators.ordering import keep_last
from brierworks.operators.series import calendar_lags, chrono_split, densify_daily, ffill, rolling_stats, walk_forward_blocks
from brierworks.operators.verification import bias_diagnostics, forecast_metrics
from brierworks.session import cut_lineage

KEY, DATE = "station_id", "target_date"
WEATHER = ("precip", "wind", "radiation", "evap")
NEEDED = ["forecast_high", "forecast_low", "actual_high", "actual_low"]
MIN_DAY_AHEAD = 180


def feature_names(target: str) -> list[str]:
    """The fourteen features of a target type."""
    t = target.lower()
    other = "low" if t == "high" else "high"
    return [
        f"forecast_{t}", f"forecast_{other}", "forecast_diurnal_range", "day_sin", "day_cos",
        *[f"forecast_{w}" for w in WEATHER],
        f"lag_{t}_1d", f"lag_{t}_2d", f"roll_{t}_7d_mean", f"roll_{t}_14d_mean", f"roll_{t}_7d_std",
    ]


def _with_memory(dense: DataFrame) -> DataFrame:
    """Errors of the days before, on a calendar without holes: short outages are bridged, rolling
    statistics need half of their days."""
    out = dense
    for t in ("high", "low"):
        out = out.withColumn(f"target_error_{t}", F.col(f"actual_{t}") - F.col(f"forecast_{t}"))
        out = calendar_lags(out, [KEY], DATE, f"target_error_{t}", [1, 2], dense=True)
        s1 = ffill(F.col(f"target_error_{t}_lag1"), [KEY], DATE, 2)
        s2 = ffill(F.col(f"target_error_{t}_lag2"), [KEY], DATE, 2)
        out = out.withColumn(f"lag_{t}_1d", s1).withColumn(f"lag_{t}_2d", s2)
        specs = {f"roll_{t}_7d_mean": ("mean", 7, 4), f"roll_{t}_14d_mean": ("mean", 14, 7), f"roll_{t}_7d_std": ("std", 7, 4)}
        out = out.select("*", *rolling_stats([KEY], DATE, F.col(f"lag_{t}_1d"), specs))
        out = out.drop(f"target_error_{t}_lag1", f"target_error_{t}_lag2")
    day_sin, day_cos = cyclic_day(F.col(DATE))
    return (
        out.withColumn("day_sin", day_sin)
        .withColumn("day_cos", day_cos)
        .withColumn("forecast_diurnal_range", F.col("forecast_high") - F.col("forecast_low"))
    )


def lead_choice(fc: DataFrame, obs: DataFrame, min_day_ahead: int = MIN_DAY_AHEAD) -> DataFrame:
    """Per station: its day-ahead forecasts with an observation, and whether training uses only those."""
    both = fc.join(obs, [KEY, DATE]).dropna(subset=NEEDED)
    out = both.groupBy(KEY).agg(F.count_if(F.col("lead_hours") == 24).alias("n_day_ahead"), F.count(F.lit(1)).alias("n_all"))
    return out.withColumn("only_day_ahead", F.col("n_day_ahead") >= min_day_ahead)


def bias_features(fc: DataFrame, obs: DataFrame, min_day_ahead: int = MIN_DAY_AHEAD) -> DataFrame:
    """ML-01: one training row per station and day with complete history.

    A station with at least ``min_day_ahead`` day-ahead forecasts is trained on those alone, others on
    all forecasts (:func:`lead_choice` tells which). Forecasts come as one row per station and day, so
    all windows run over calendar-bounded series.
    """
    rows = fc.join(obs, [KEY, DATE]).dropna(subset=NEEDED)
    ahead = F.count(F.when(F.col("lead_hours") == 24, 1)).over(Window.partitionBy(KEY))
    rows = rows.withColumn("_ahead", ahead).filter((F.col("_ahead") < min_day_ahead) | (F.col("lead_hours") == 24)).drop("_ahead", "lead_hours")
    full = _with_memory(densify_daily(rows, [KEY], DATE))
    memory = [c for t in ("high", "low") for c in (f"target_error_{t}", f"lag_{t}_1d", f"lag_{t}_2d", f"roll_{t}_7d_mean", f"roll_{t}_14d_mean", f"roll_{t}_7d_std")]
    return full.dropna(subset=memory)


def inference_features(history: DataFrame, live: DataFrame, asof: Column, days: int = 21) -> DataFrame:
    """ML-02: the feature rows of one day from a trailing retrospective and the live forecast.

    Only the last ``days`` are read; the live row of a day replaces the retrospective one.
    """
    recent = history.filter((F.col(DATE) >= F.date_sub(asof, days)) & (F.col(DATE) < asof)).withColumn("_live", F.lit(0))
    both = recent.unionByName(live.withColumn("_live", F.lit(1)), allowMissingColumns=True)
    rows = keep_last(both, [KEY, DATE], [F.col("_live").desc()]).drop("_live")
    return _with_memory(densify_daily(rows, [KEY], DATE)).filter((F.col(DATE) == asof) & F.col("forecast_high").isNotNull())


# ---------------------------------------------------------------- learners

@dataclass(frozen=True)
class TreeParams:
    """One tree-ensemble configuration."""

    depth: int = 4
    rounds: int = 20
    step: float = 0.1
    subsample: float = 0.8
    seed: int = 42


@dataclass(frozen=True)
class StumpParams:
    """One additive configuration: ``rounds`` trees of a single split, between the ``bins`` of one input."""

    rounds: int = 400
    step: float = 0.3
    bins: int = 32
    least: int = 20
    depth: int = 1


DEEP, WIDE = TreeParams(depth=5, rounds=20, step=0.1), StumpParams()
EFFECT_DAYS = 20  # days without error that a station's mean error is mixed with
TASK_ROWS = 20_000  # rows a task of a tree fit has at least; each level of each tree is a job, so smaller tasks cost more than they do
STOP = 1e-3  # a tree that lowers the held-out error by a smaller share than this is the last one


def _inputs(target: str) -> list[str]:
    return [*[f"_{c}" for c in feature_names(target)], "_effect"]


def _prepared(df: DataFrame, target: str) -> DataFrame:
    """Learner inputs: the station as text, whatever its type, and each feature with a mark where it is missing; so no
    row is dropped."""
    known = [F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)).cast("double") for c in feature_names(target)]
    filled = {f"_{n}": F.coalesce(c, F.lit(0.0)) for n, c in zip(feature_names(target), known)}
    marks = {f"_no_{n}": c.isNull().cast("double") for n, c in zip(feature_names(target), known)}
    return df.withColumns({"_station": F.coalesce(F.col(KEY).cast("string"), F.lit("")), **filled, **marks})


def _bare(df: DataFrame, target: str) -> DataFrame:
    names = feature_names(target)
    return df.drop("_station", "_effect", "features", *[f"_{n}" for n in names], *[f"_no_{n}" for n in names])


def earlier_effect(label: str, order: Column) -> Column:
    """The station's mean error over its rows at a smaller ``order``, drawn towards zero by ``EFFECT_DAYS`` rows. A row's own
    error and later ones have no part in it, so it may be learned from; one input serves any number of stations."""
    before = Window.partitionBy("_station").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(label).over(before), F.lit(0.0)) / (F.count(label).over(before) + EFFECT_DAYS)


def station_effects(data: DataFrame, label: str) -> DataFrame:
    """What :func:`earlier_effect` says after the last row: one row per station, for scoring."""
    return data.groupBy("_station").agg((F.coalesce(F.sum(label), F.lit(0.0)) / (F.count(label) + EFFECT_DAYS)).alias("_effect"))


def _trees(target: str, p: TreeParams, held: str | None = None) -> Pipeline:
    """Boosted trees. With a column ``held`` they are grown until its rows gain no more."""
    until = {"validationIndicatorCol": held, "validationTol": STOP} if held else {}
    tree = GBTRegressor(
        labelCol=f"target_error_{target.lower()}", featuresCol="features", maxDepth=p.depth, maxIter=p.rounds,
        stepSize=p.step, subsamplingRate=p.subsample, seed=p.seed, **until,
    )
    marks = [f"_no_{c}" for c in feature_names(target)]
    return Pipeline(stages=[VectorAssembler(inputCols=[*_inputs(target), *marks], outputCol="features"), tree])


def _in_few_tasks(data: DataFrame, rows: int) -> DataFrame:
    """Training data in as many partitions as its ``rows`` are worth, and never in more than it has."""
    return data.coalesce(max(1, rows // TASK_ROWS))


@dataclass(frozen=True)
class Bins:
    """Value ranges of the inputs. An input's cells are numbered on from the one before: first the missing values, then the
    ranges between its cuts."""

    inputs: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]

    @classmethod
    def of(cls, data: DataFrame, target: str, bins: int) -> "Bins":
        """Quantiles of the known values, one pass over the data."""
        names = _inputs(target)
        known = data.select(*[F.when(F.col(f"_no{n}") == 0.0, F.col(n)).alias(n) for n in names[:-1]], names[-1])
        found = known.approxQuantile(names, [i / bins for i in range(1, bins)], 0.001)
        return cls(tuple(names), tuple(tuple(sorted(set(c))) for c in found))

    @property
    def ranges(self) -> list[tuple[int, int]]:
        """First cell of each input and the one after its last."""
        ends = np.cumsum([len(c) + 2 for c in self.cuts]).tolist()
        return list(zip([0, *ends[:-1]], ends))

    def lookup(self, values: list) -> list[Column]:
        """For each input, the entry of ``values`` at its cell."""
        out = []
        for name, cuts, (a, b) in zip(self.inputs, self.cuts, self.ranges):
            missing = "" if name == "_effect" else f"WHEN `_no{name}` = 1 THEN {values[a]} "
            steps = " ".join(f"WHEN `{name}` <= {c!r}D THEN {v}" for c, v in zip(cuts, values[a + 1 : b - 1]))
            out.append(F.expr(f"CASE {missing}{steps} ELSE {values[b - 1]} END" if missing or steps else str(values[b - 1])))
        return out


def joint_sums(data: DataFrame, bins: Bins, label: str, by: Column | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per group: how many rows share each pair of cells, and the label's sum in each cell. That is all a sum of one-split
    trees needs to be grown under squared error, so the data are read once for any number of rounds and configurations. Its
    size is the number of cells squared, whatever the data; it is summed in every task before the shuffle."""
    cells = bins.ranges[-1][1]
    rows = data.select((F.lit(0) if by is None else by).alias("g"), F.col(label).cast("double").alias("y"), F.array(*bins.lookup(list(range(cells)))).alias("c"))
    first = rows.select("g", "y", "c", F.explode("c").alias("i"))
    pairs = first.select("g", "y", "i", F.explode(F.filter("c", lambda c: c >= F.col("i"))).alias("j"))
    sums = pairs.groupBy("g", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("i") == F.col("j"), F.col("y"))).alias("y")).toPandas()
    out = {}
    for g, part in sums.groupby("g"):
        shared, total = np.zeros((cells, cells)), np.zeros(cells)
        i, j = part["i"].to_numpy(int), part["j"].to_numpy(int)
        shared[i, j] = shared[j, i] = part["n"]
        own = i == j
        total[i[own]] = part["y"].to_numpy(float)[own]
        out[int(g)] = shared, total
    return out


def boost(bins: Bins, shared: np.ndarray, total: np.ndarray, p: StumpParams, held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, int]:
    """Scores of the cells and the rounds they took: from the mean on, each round adds ``step`` times the split that lowers
    the squared error most and leaves ``least`` rows on both sides. With ``held`` sums, the round that suits them best."""
    count, score = np.diag(shared), np.zeros(len(total))
    a, b = bins.ranges[0]
    score[a:b] = total[a:b].sum() / count[a:b].sum()
    best = (np.inf, score, 0)
    for r in range(p.rounds + 1):
        if held is not None:
            error = score @ held[0] @ score - 2.0 * score @ held[1]
            if error < best[0]:
                best = (error, score.copy(), r)
        if r == p.rounds:
            break
        left, top = total - shared @ score, (0.0, None)
        for a, b in bins.ranges:
            n, s = np.cumsum(count[a:b]), np.cumsum(left[a:b])
            low, high = n[:-1], n[-1] - n[:-1]
            fits = (low >= p.least) & (high >= p.least)
            gain = np.where(fits, s[:-1] ** 2 / np.maximum(low, 1) + (s[-1] - s[:-1]) ** 2 / np.maximum(high, 1), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > top[0] + 1e-12:
                top = (gain[k], (a, a + k + 1, b, s[k] / low[k], (s[-1] - s[k]) / high[k]))
        if top[1] is None:
            break
        a, m, b, low, high = top[1]
        score[a:m] += p.step * low
        score[m:b] += p.step * high
    return (best[1], best[2]) if held is not None else (score, r)


@dataclass(frozen=True)
class AdditiveModel:
    """One score per cell; a row's prediction is the sum over its cells."""

    bins: Bins
    scores: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for part in self.bins.lookup([f"{v!r}D" for v in self.scores]):
            total = total + part
        return df.withColumn("prediction", total)


@dataclass(frozen=True)
class BiasModel:
    """A learner and the station effects of the days it was trained on (zero for a station it has not seen)."""

    learner: PipelineModel | AdditiveModel
    effects: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        known = df.join(self.effects, "_station", "left").withColumn("_effect", F.coalesce("_effect", F.lit(0.0)))
        return self.learner.transform(known).drop("features", "_effect")


def fit_bias_models(features: DataFrame, target: str, a: TreeParams | StumpParams = DEEP, b: TreeParams | StumpParams = WIDE, refit: bool = False) -> dict[str, BiasModel]:
    """ML-03: two learners on the first 60 % of each station's days, boosted trees and an additive model; ``refit`` uses all
    days and 1.1 times the rounds. The station enters as its mean error of earlier days, so a row's width does not grow with
    the stations. Without a row to train on there is no model."""
    label = f"target_error_{target.lower()}"
    data = _prepared(features, target).filter(F.col(label).isNotNull())
    if refit:
        a, b = (replace(x, rounds=int(round(x.rounds * 1.10))) for x in (a, b))
    else:
        data = chrono_split(data, [KEY], DATE).filter("split = 'train'")
    data = data.withColumn("_effect", earlier_effect(label, F.unix_date(DATE))).persist()

    def fit(p: TreeParams | StumpParams) -> PipelineModel | AdditiveModel:
        if isinstance(p, TreeParams):
            return _trees(target, p).fit(_in_few_tasks(data, rows))
        bins = Bins.of(data, target, p.bins)
        scores, _ = boost(bins, *joint_sums(data, bins, label)[0], p)
        return AdditiveModel(bins, tuple(scores.tolist()))

    try:
        rows = data.count()
        if not rows:
            return {}
        effects = cut_lineage(station_effects(data, label))
        return {"a": BiasModel(fit(a), effects), "b": BiasModel(fit(b), effects)}
    finally:
        data.unpersist()


def score_bias(models: dict[str, BiasModel], features: DataFrame, target: str, weights: DataFrame | float = 0.5) -> DataFrame:
    """ML-06: both learners' bias, their blend and the corrected forecast, for every row; NULL without models."""
    out = _prepared(features, target)
    if not models:
        out = out.withColumns({f"bias_{name}": F.lit(None).cast("double") for name in "ab"})
    for name, m in models.items():
        out = m.transform(out).withColumnRenamed("prediction", f"bias_{name}")
    out = _bare(out, target)
    if isinstance(weights, DataFrame):
        out = out.join(weights.select(KEY, F.col("w").alias("_w")), KEY, "left").withColumn("_w", F.coalesce("_w", F.lit(0.5)))
    else:
        out = out.withColumn("_w", F.lit(float(weights)))
    out = out.withColumn("bias_blend", F.col("_w") * F.col("bias_a") + (1.0 - F.col("_w")) * F.col("bias_b"))
    return out.withColumn("corrected", F.col(f"forecast_{target.lower()}") + F.col("bias_blend")).drop("_w")


def blend_weight(preds: DataFrame, by: list[str], a: str = "bias_a", b: str = "bias_b", actual: str = "target_error", points: int = 1001) -> DataFrame:
    """ML-05: blend with the least bracket loss. Misses beyond 1.5 degrees count twice, and a pull to
    one half keeps both learners. The loss jumps, so a fine grid is searched."""

    def loss(w: Column) -> Column:
        miss = F.abs(F.col(actual) - (w * F.col(a) + (1.0 - w) * F.col(b)))
        return F.when(miss > 1.5, miss * 2.0).otherwise(miss)

    grid = [i / (points - 1) for i in range(points)]
    total = sweep(preds, by, grid, loss, "w")
    pull = 10.0 * (F.col("w") - 0.5) * (F.col("w") - 0.5)
    return sweep_best(total.withColumn("objective", F.col("objective") + pull), by, "w")


def tune_bias_models(features: DataFrame, target: str, grid: list[TreeParams | StumpParams], folds: int = 6, test_days: int = 45, parallelism: int = 6, startup: int = 1, warmup: int = 1, prune: bool = True) -> DataFrame:
    """ML-04: walk-forward search. Fold k trains on all earlier days and is scored on its own block, where station effects
    are those before the block. A fit ends with the round that its block gains from; the round count is the folds' mean,
    weighted by fold position.

    The first ``startup`` configurations of each learner run all folds. The others go from fold to fold, and one whose mean
    error so far is above the median of those first ones is given up (``state`` PRUNED, no rank), from the fold after
    ``warmup`` on. ``fits_saved`` is the share of fits that this left out. Trees are fitted as distributed jobs,
    ``parallelism`` at a time; additive models of all folds and configurations come from one pass per bin count.

    Folds without an earlier day or without rows (short histories) are left out, and without any other fold there are no
    rows. ``rank`` 1 is the configuration with the least mean error (of equal ones the first).
    """
    spark = features.sparkSession
    label = f"target_error_{target.lower()}"
    known = _prepared(features, target).filter(F.col(label).isNotNull())
    known = walk_forward_blocks(known, [KEY], DATE, test_days, folds).filter("fold IS NOT NULL")
    known = known.withColumns({"_effect": earlier_effect(label, F.unix_date(DATE)), "_held_effect": earlier_effect(label, F.col("fold"))})
    data = known.persist()
    scored = data.withColumn("_effect", F.col("_held_effect"))

    def sums(bins: int):
        cells = Bins.of(data.filter(F.col("fold") == held[0]), target, bins)  # these rows train every fold
        return cells, joint_sums(data, cells, label, F.col("fold")), joint_sums(scored, cells, label, F.col("fold"))

    def trial(job: tuple[int, int]) -> tuple[float, int]:
        p, k = grid[job[0]], job[1]
        block = scored.filter(F.col("fold") == k)
        if isinstance(p, TreeParams):
            both = data.filter(F.col("fold") < k).withColumn("_held", F.lit(False)).unionByName(block.withColumn("_held", F.lit(True)))
            model = _trees(target, p, "_held").fit(_in_few_tasks(both, sum(n for f, n in sizes.items() if f <= k)))
            rounds = model.stages[-1].getNumTrees
        else:
            cells, train, test = joint[p.bins]
            before = [train[f] for f in held if f < k]
            scores, rounds = boost(cells, sum(x[0] for x in before), sum(x[1] for x in before), p, test[k])
            model = AdditiveModel(cells, tuple(scores.tolist()))
        return float(model.transform(block).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]), int(rounds)

    def so_far(i: int, step: int) -> float:
        return sum(mae for mae, _ in done[i][: step + 1]) / (step + 1)

    done: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(grid))}
    kinds = [type(p) for p in grid]
    lead = [i for i in range(len(grid)) if not prune or kinds[:i].count(kinds[i]) < startup]
    try:
        sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
        held = sorted(sizes)
        usable = held[1:]  # with rows before
        joint = {n: sums(n) for n in {p.bins for p in grid if isinstance(p, StumpParams)}} if usable else {}
        with ThreadPool(parallelism) as pool:
            def run(jobs: list[tuple[int, int]]) -> None:
                for (i, _), result in zip(jobs, pool.map(inheritable_thread_target(spark)(trial), jobs, chunksize=1)):
                    done[i].append(result)

            run([(i, k) for i in lead for k in usable])
            active = [i for i in done if i not in lead]
            for step, k in enumerate(usable):
                run([(i, k) for i in active])
                if step >= warmup:
                    bar = {kind: median(so_far(i, step) for i in lead if kinds[i] is kind) for kind in set(kinds)}
                    active = [i for i in active if so_far(i, step) <= bar[kinds[i]] or step + 1 == len(usable)]
    finally:
        data.unpersist()
    rows = []
    saved = 1.0 - sum(map(len, done.values())) / (len(grid) * len(usable)) if grid and usable else 0.0
    for i, p in enumerate(grid if usable else []):
        maes, best = (list(x) for x in zip(*done[i]))
        ran = usable[: len(maes)]
        rounds = sum(k * r for k, r in zip(ran, best)) / sum(ran)
        state = "COMPLETE" if len(ran) == len(usable) else "PRUNED"
        learner = "trees" if isinstance(p, TreeParams) else "stumps"
        rows.append((i, learner, p.depth, p.rounds, p.step, state, sum(maes) / len(ran), int(round(rounds)), maes, [float(r) for r in best], saved))
    whole = sorted((row for row in rows if row[5] == "COMPLETE"), key=lambda row: (row[6], row[0]))
    rank = {row[0]: k + 1 for k, row in enumerate(whole)}
    return spark.createDataFrame([(*row, rank.get(row[0])) for row in rows], "trial_id int, learner string, depth int, max_rounds int, step double, state string, value double, rounds int, fold_mae array<double>, fold_rounds array<double>, fits_saved double, rank int")


def holdout_report(preds: DataFrame, raw: str, corrected: str, actual: str, by: list[str]) -> DataFrame:
    """ML-07: quality of the raw and the corrected forecast side by side."""
    return forecast_metrics(preds, {"raw": raw, "corrected": corrected}, actual, by)


def holdout_bias(preds: DataFrame, corrected: str, actual: str, by: list[str]) -> DataFrame:
    """ML-07: bias of the corrected forecast by month and tercile."""
    return bias_diagnostics(preds, corrected, actual, DATE, by)
