"""Ordered computations that stay balanced when one key holds much of the data.

Two regimes are used on purpose:

* a *bounded* series (one row per key and calendar day, one ladder of bins, ...) runs as a plain window;
* an *unbounded* one is cut into value-range blocks first. A block holds about ``1/n`` of all rows
  whatever the key distribution is, so no task sees more than that; the state at each block's start
  comes from a per-block summary with one row per key and block. A value that alone fills blocks is cut
  further, by key and by the columns that order its rows, at places taken from a sample of these rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.session import cut_lineage


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W-01: first row per key in ``order``. Spark prunes to one row per key before the shuffle
    (WindowGroupLimit), so a hot key costs one row per task."""
    return tail_n(df, keys, order, 1)


def tail_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """TOP-06: the first ``n`` rows per key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_by(df: DataFrame, order: list[Column]) -> DataFrame:
    """TOP-01: one row overall (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(1)


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """TOP-02: a report of ``n`` rows."""
    return df.orderBy(*order).limit(n)


def rank_in_group(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """W-16: rank inside a bounded group (the candidates of one station and day)."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(*order)))


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """SET-02."""
    return df.select(*keys).distinct()


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """SET-03: order-stable de-duplication."""
    return latest_per_key(df, keys, order)


def minus_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """SET-04: rows whose key is unknown to ``other``."""
    return df.join(other.select(*keys), keys, "left_anti")


def concat(*frames: DataFrame) -> DataFrame:
    """SET-01: UNION ALL by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def join_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys match, as grouping sees them. The plan is left to Spark: the broadcast
    threshold, and adaptive execution, which splits crowded keys."""
    named = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


# ---------------------------------------------------------------- blocks

def _default_blocks(df: DataFrame) -> int:
    return min(2048, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _quantiles(df: DataFrame, order: Column, n: int | None) -> tuple[list[float], int]:
    n = n or _default_blocks(df)
    probs = [i / n for i in range(1, n)]
    value = F.coalesce(order.cast("double"), F.lit(float("-inf")))  # as block_of places NULLs
    row = df.agg(F.percentile_approx(value, probs, max(2000, 10 * n)).alias("b")).first()
    return list(row["b"] or []), n


def block_bounds(df: DataFrame, order: Column, n: int | None = None) -> list[float]:
    """At most ``n - 1`` split points of ``order`` (a fixed-size summary, safe on the driver).

    By default there are as many blocks as the session has shuffle partitions, 64 at least: the number
    that its owner has set for the size of the data."""
    return sorted(set(_quantiles(df, order, n)[0]))


TIE_SAMPLE = 64  # sampled rows for each piece that a crowded value is cut into
MAX_PIECES = 4096


def blocks(df: DataFrame, by: list[str], order: list[str], position: Column, n: int | None = None) -> DataFrame | None:
    """``df`` with ``_blk``, the ordinal of each row's block: blocks follow ``position``, the numeric form of the first
    ``order`` column, and within one value the key and the other order columns. None where one block would do.

    Quantiles are taken at twice ``n``. Where none repeats, every second one bounds a block. Otherwise all do, since a
    value may lie on one and reach almost to both neighbours; a value that spans several gets blocks of its own, as many
    as it spans, with bounds that are order statistics of a sample of its rows, of about TIE_SAMPLE rows a piece. So a
    block has about ``1/n`` of the rows at most. Rows that agree in key and all order columns share one.
    """
    found, n = _quantiles(df, position, 2 * (n or _default_blocks(df)))
    if not found:
        return None
    repeats = Counter(found)
    crowded = {v: c + 1 for v, c in repeats.items() if c > 1}
    if not crowded:
        return df.withColumn("_blk", block_of(position, found[1::2] or found))
    # a crowded value begins a block
    bounds = sorted(set(found) | {math.nextafter(v, -math.inf) for v in crowded})
    place = block_of(position, bounds).cast("long") * MAX_PIECES
    value = F.coalesce(position.cast("double"), F.lit(float("-inf")))
    at = F.when(value.isin(list(crowded)), value)
    tie = F.struct(F.xxhash64(*by) if by else F.lit(0), *order)
    marked = df.withColumn("_crowd", at).withColumn("_place", tie)
    pieces = F.create_map(*[F.lit(x) for v, c in crowded.items() for x in (v, min(c, MAX_PIECES))])
    # a value that spans c quantiles has at least (c - 1) / n of all rows
    total = marked.where("_crowd IS NOT NULL").groupBy("_crowd").agg(F.count(F.lit(1)).alias("_crowd_n"))  # no name of ``df``
    lot = F.pmod(F.xxhash64(F.lit(7), *by, *order), F.lit(1 << 30)) / float(1 << 30)
    drawn = marked.where("_crowd IS NOT NULL").join(F.broadcast(total), "_crowd").where(lot < pieces[F.col("_crowd")] * TIE_SAMPLE / F.col("_crowd_n"))
    cuts = drawn.groupBy("_crowd").agg(F.array_sort(F.collect_list("_place")).alias("_s"))
    k = pieces[F.col("_crowd")]
    cuts = cuts.select("_crowd", F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.col("_s")[F.floor(i * F.size("_s") / k).cast("int")]).alias("_cuts"))
    inner = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_place"))))
    placed = marked.join(F.broadcast(cuts), "_crowd", "left")  # at most n rows, n bounds in all
    return placed.withColumn("_blk", place + inner).drop("_crowd", "_place", "_cuts")


def block_of(order: Column, bounds: list[float]) -> Column:
    """Ordinal of the block a value falls in; equal values share a block. A balanced tree of
    comparisons, so a row costs the logarithm of the number of blocks. NULL falls in the first block."""
    v = F.coalesce(order.cast("double"), F.lit(float("-inf")))

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(v <= bounds[mid], place(low, mid)).otherwise(place(mid + 1, high))

    return place(0, len(bounds))


def ts_number(ts: Column) -> Column:
    """Microsecond-exact number of a zone-less or zoned instant."""
    return F.unix_micros(ts.cast("timestamp")).cast("double")


_REDUCE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    measures: dict[str, tuple[str, Column]],
    position: Column | None = None,
    n_blocks: int | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Prefix aggregates per key: ``measures`` maps an output name to (kind, input), kind being one of
    sum, count, max, min, last (last non-NULL). ``position`` is the numeric form of the first order
    column; without it the series is taken as bounded and a plain window is used. ``exclusive`` leaves
    the current row out.
    """
    if position is None:
        return _running_window(df, by, order, measures, exclusive)
    cut = blocks(df, by, order, position, n_blocks)
    if cut is None:
        return _running_window(df, by, order, measures, exclusive)
    return _running_blocks(cut, by, order, measures, exclusive)


def _frame(by: list[str], order: list[str], exclusive: bool):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else Window.currentRow
    )


def _over(kind: str, c: Column, w) -> Column:
    return F.last(c, ignorenulls=True).over(w) if kind == "last" else _REDUCE[kind](c).over(w)


def _running_window(df, by, order, measures, exclusive):
    w = _frame(by, order, exclusive)
    return df.select("*", *[_over(k, c, w).alias(n) for n, (k, c) in measures.items()])


def _running_blocks(df, by, order, measures, exclusive):
    keys = [*by, "_blk"]
    totals, carries, merged = [], [], []
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, c) in measures.items():
        if kind == "last":
            totals.append(F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"_t_{name}"))
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
        else:
            totals.append(_REDUCE[kind](c).alias(f"_t_{name}"))
            reduce = F.sum if kind in ("sum", "count") else _REDUCE[kind]
            carries.append(reduce(f"_t_{name}").over(before).alias(f"_c_{name}"))
        local, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            both = F.coalesce(local + carry, local, carry)
        elif kind == "last":
            both = F.coalesce(local, carry)
        else:
            both = (F.greatest if kind == "max" else F.least)(local, carry)
        merged.append(both.alias(name))
    carry_in = df.groupBy(*keys).agg(*totals).select(*keys, *carries)
    w = _frame(keys, order, exclusive)
    local_df = df.select("*", *[_over(k, c, w).alias(f"_l_{n}") for n, (k, c) in measures.items()])
    return join_keys(local_df, carry_in, keys).select(*[c for c in df.columns if c != "_blk"], *merged)


def positions(df: DataFrame, by: list[str], key: str, tie: list[str], nulls: str = "first", name: str = "pos") -> DataFrame:
    """TOP-05: position of each row in its key's order by a number, open (NULL) values first or last."""
    flag = F.col(key).isNull() if nulls == "last" else F.col(key).isNotNull()
    # NULLs get their own place before or after every number, in the order and in the blocks
    edge = F.coalesce(F.col(key).cast("double"), F.lit(float("inf") if nulls == "last" else float("-inf")))
    keyed = df.withColumn("_open", flag.cast("int")).withColumn("_edge", edge)
    out = running(keyed, by, ["_open", "_edge", *tie], {name: ("count", F.lit(1))}, F.col("_edge"))
    return out.drop("_open", "_edge")


# ---------------------------------------------------------------- exact quantiles

def grouped_percentiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], n_blocks: int | None = None
) -> DataFrame:
    """Exact interpolated percentiles without gathering a group: count equal values, rank them with
    block-wise prefix sums and pick the two order statistics each percentile needs. The counts are
    read several times, so they are written once to the shared folder."""
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")))
    ranked = running(counts, by, [value], {"_cum": ("sum", F.col("_n"))}, F.col(value), n_blocks)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    joined = join_keys(ranked, totals, by) if by else ranked.withColumn("_total", totals.scalar())
    picks, outs = [], []
    for name, q in probs.items():
        rank = (F.col("_total") - 1) * F.lit(q)
        for side, k in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = (F.col("_cum") > k) & (F.col("_cum") - F.col("_n") <= k)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        frac = (F.col("_total") - 1) * F.lit(q) - F.floor((F.col("_total") - 1) * F.lit(q))
        outs.append((lo + (hi - lo) * frac).alias(name))
    return joined.groupBy(*by).agg(F.max("_total").alias("_total"), *picks).select(*by, *outs)
