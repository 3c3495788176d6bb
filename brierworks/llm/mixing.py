"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words, so each of its documents should be taken target / source size times. The
whole part of that is certain; the fractions are rounded by pivoting: two documents' fractions are paired and words move
from one to the other, in a random direction that keeps both expectations, until one of them is taken or left. So the
words a source gives stay what they were, up to one document at the end. Buckets of documents pivot on their own, each
leaving at most one open document; those meet in a reduction tree of fan-in ``2**FAN_BITS``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from brierworks.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 2048
FAN_BITS = 6
SMALL_TABLE = 100_000


def targets(totals: DataFrame, weights: Iterable[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target from source and source_size (one row per source).

    Weights repeat over the sources in code point order, null last. Targets are as the weights and sum to ``share`` of
    all sizes, but stop at ``most`` times a source's size, the excess going to the others by weight. The level at which
    that holds is found from sources in order of their stopping level.
    """
    weights = list(weights)
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("stop", F.col("cap") / F.col("weight"))
    every = Window.orderBy("stop", "place")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    onward = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = ranked.withColumn("level", level)
    settled = levelled.withColumn("final", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "place", "level"))).over(whole)["level"])
    return settled.select("source", "source_size", F.least("cap", F.coalesce("final", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def pivot(size: list[float], p: list[float], draws: np.ndarray) -> list[float]:
    """Fractions after pairing them in order: all 0 or 1 but at most one."""
    p, open_ = list(p), None
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if open_ is None:
            open_ = j
            continue
        i = open_
        up = min(size[i] * (1 - p[i]), size[j] * p[j])  # words that can move from j to i
        down = min(size[i] * p[i], size[j] * (1 - p[j]))
        if draws[j] * (up + down) < down:
            full, empty = size[i] * (1 - p[i]) <= up, size[j] * p[j] <= up
            p[i], p[j] = (1.0 if full else p[i] + up / size[i]), (0.0 if empty else p[j] - up / size[j])
        else:
            empty, full = size[i] * p[i] <= down, size[j] * (1 - p[j]) <= down
            p[i], p[j] = (0.0 if empty else p[i] - down / size[i]), (1.0 if full else p[j] + down / size[j])
        open_ = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else None
    return p


def _pivoted(seed: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending")])
        key, size, p = (group.column(c).to_numpy() for c in ("key", "mass", "p"))
        level = int(group.column("level")[0].as_py())
        rng = np.random.default_rng([seed & 0xFFFFFFFF, level, *np.frombuffer(key[:1].tobytes(), "<u4").tolist()])
        draws = rng.random(len(key) + 1)
        out = pivot(size.tolist(), p.tolist(), draws)
        if last:
            out = [x if x in (0.0, 1.0) else float(draws[-1] < x) for x in out]
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(out, pa.float64()))

    return run


UNITS = "key bigint, source string, bucket bigint, mass double, p double, level int"


def rounded(units: DataFrame, bits: int, seed: int) -> DataFrame:
    """key and up (0 or 1) for units with columns key, source, mass and p in (0, 1).

    ``bits``: so many bits of the key deal a source's units to buckets.
    """
    spread = F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 64 - bits) if bits else F.lit(0).cast("bigint")
    todo = units.select("key", "source", spread.alias("bucket"), F.col("mass").cast("double").alias("mass"), "p", F.lit(0).alias("level"))
    done = None
    for level in range(64):
        last = bits - FAN_BITS * level <= 0
        made = cut_lineage(todo.groupBy("source", "bucket").applyInArrow(_pivoted(seed, last), UNITS))
        settled = made.where("p in (0.0, 1.0)").select("key", F.col("p").cast("int").alias("up"))
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        todo = made.where("p not in (0.0, 1.0)").withColumn("bucket", F.shiftrightunsigned("bucket", FAN_BITS)).withColumn("level", F.col("level") + 1)
    raise ValueError("too many bits")


def words(text: str = "text"):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: Iterable[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """For each row its columns as the struct ``doc``, size, source_size, target and copies.

    ``copies`` is how often the mix takes the document, at most ``most`` rounded up and the same whenever the job runs
    again on the same rows. Equal rows (id, source and text) are one unit and get equal copies. Documents without words
    have no mass: they are taken as often as is certain. A null source is a source of its own.
    """
    key = F.xxhash64(F.col("doc.doc_id").cast("long"), F.col("doc.source").cast("string"), F.col("doc.text"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("key", key)
    sized = keyed.select("key", F.col("doc.source").cast("string").alias("source"), words("doc.text").alias("size"))
    units = cut_lineage(sized.groupBy("key", "source", "size").agg(F.count("*").alias("rows")))
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    aims = cut_lineage(targets(totals, weights, share, most).withColumn("source_key", F.xxhash64("source", F.col("source").isNull())))
    aims = F.broadcast(aims) if aims.count() <= SMALL_TABLE else aims
    aimed = units.withColumn("source_key", F.xxhash64("source", F.col("source").isNull())).join(aims.drop("source"), "source_key").drop("source_key")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = aimed.withColumn("sure", F.floor(each).cast("int")).withColumn("p", each - F.floor(each))
    open_ = aimed.where("p > 0 and size > 0").select("key", "source", (F.col("size") * F.col("rows")).alias("mass"), "p")
    largest = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    ups = rounded(open_, max(0, (int(largest) // BUCKET_ROWS).bit_length()), seed)
    taken = aimed.join(ups, "key", "left").select("key", "size", "source_size", "target", (F.col("sure") + F.coalesce("up", F.lit(0))).alias("copies"))
    return keyed.join(taken, "key").drop("key")
