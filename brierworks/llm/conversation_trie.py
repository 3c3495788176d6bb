"""The prefix trie of conversations, rolled up in bands of depth.

A node is a distinct sequence of first turns. It goes by a 128-bit key, the exclusive or of hashes of its turns and their
places, which running aggregates give for all prefixes of a conversation at once. Subtree totals come from bands: a node
adds its own values to its ancestors within its band of ``band`` depths only. The topmost nodes of the bands form a
coarser trie, whose totals are found in the same way; what a finished band's top has in all then goes to the ancestors in
the band above. So a row is copied to ``band`` ancestors at most, and the number of rounds is the logarithm of the depth.

Texts are hashed where they are read; only hashes and lengths are shuffled. Conversations of any length are cut into
blocks of depths, so that none is gathered in one task.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from brierworks.operators.ordering import positions
from brierworks.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BAND = 8
BLOCK = 512  # depths that share a running aggregate
LONG = 100_000  # turns of a conversation that are numbered in one window
ID_BITS = 8  # ids joined in one piece: 2 ** ID_BITS at most

KEY = ["k1", "k2"]


def _piece(digest: Column, n: int) -> Column:
    return F.conv(F.substring(digest, 1 + 15 * n, 15), 16, 10).cast("long")


def number_turns(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, pos (from 1), c1 and c2 (a hash of role and text) and bytes (UTF-8 bytes of the text) of each turn.

    Turns are ordered by ``turn`` (null first) and, where that is equal, by the hash of role and text. Null role and text
    are empty; rows with a null conv_id take no part. Conversations of over ``long`` turns are numbered by blocks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = cut_lineage(rows.select("conv_id", "turn", _piece(F.col("digest"), 0).alias("c1"), _piece(F.col("digest"), 1).alias("c2"), "bytes"))
    columns = ["conv_id", "pos", "c1", "c2", "bytes"]
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "c1", "c2")).cast("long")
    crowded = cut_lineage(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select("conv_id"))
    if crowded.isEmpty():
        return rows.withColumn("pos", place).select(*columns)
    short = rows.join(crowded, "conv_id", "left_anti").withColumn("pos", place)
    blocks = positions(rows.join(crowded, "conv_id", "left_semi"), ["conv_id"], "turn", ["c1", "c2"], nulls="first")
    return short.select(*columns).unionByName(blocks.select(*columns))


def rebuild(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: the first ``crc32(id) % heads`` turns come from the first conversation of the
    ``group`` (all if it has fewer, none if it is absent), the rest are the conversation's own.

    Returns the conversations (conv_id, depth: turns in all) and their turns (conv_id, d from 1, c1, c2, bytes, last).
    """
    turns = cut_lineage(turns)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % group
    kin = F.explode(F.transform(F.sequence(F.lit(1 - group), F.lit(group - 1)), lambda i: F.try_add("conv_id", i)))
    heirs = lambda df: df.where(F.col("conv_id") == first).withColumn("heir", kin).where(F.col("heir") - F.col("heir") % group == F.col("conv_id"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    lent = heirs(sizes).select(F.col("heir").alias("conv_id"), F.col("n").alias("lender"))
    convs = sizes.withColumn("h", head).join(lent, "conv_id", "left").withColumn("b", F.least("h", F.coalesce("lender", F.lit(0))))
    convs = cut_lineage(convs.select("conv_id", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")))
    lines = heirs(turns.where(F.col("pos") < heads)).drop("conv_id").withColumnRenamed("heir", "conv_id")
    begun = lines.join(convs, "conv_id").where(F.col("pos") <= F.col("h")).withColumn("d", F.col("pos"))
    own = turns.join(convs, "conv_id").where(F.col("pos") > F.col("h")).withColumn("d", F.col("b") + F.col("pos") - F.col("h"))
    rows = begun.unionByName(own.select(*begun.columns))
    return convs.select("conv_id", "depth"), rows.select("conv_id", "d", "c1", "c2", "bytes", (F.col("d") == F.col("depth")).alias("last"))


def prefix_keys(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with the key of each prefix (k1, k2) and of the prefix before (p1, p2)."""
    rows = rows.withColumn("blk", F.floor((F.col("d") - 1) / block)).withColumn("v1", F.xxhash64(F.lit(1), "d", "c1", "c2")).withColumn("v2", F.xxhash64(F.lit(2), "d", "c2", "c1"))
    rows = cut_lineage(rows.drop("c1", "c2"))
    w = Window.partitionBy("conv_id", "blk").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = rows.select("*", F.bit_xor("v1").over(w).alias("k1"), F.bit_xor("v2").over(w).alias("k2"))
    deep = rows.where("blk > 0")
    if not deep.isEmpty():
        totals = rows.join(deep.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "blk").agg(F.bit_xor("v1").alias("t1"), F.bit_xor("v2").alias("t2"))
        before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select("conv_id", "blk", *[F.bit_xor(t).over(before).alias(t) for t in ("t1", "t2")]).where("blk > 0")
        keyed = keyed.join(carry, ["conv_id", "blk"], "left")
        for k, t in (("k1", "t1"), ("k2", "t2")):
            keyed = keyed.withColumn(k, F.col(k).bitwiseXOR(F.coalesce(t, F.lit(0))))
    before = [F.when(F.col("d") == 1, 0).otherwise(F.col(f"k{i}").bitwiseXOR(F.col(f"v{i}"))).alias(f"p{i}") for i in (1, 2)]
    return cut_lineage(keyed.select("conv_id", "d", "bytes", "last", *KEY, *before))


class _Rollup:
    """Subtree sums over the trie of ``keyed`` rows, whose deepest has depth ``deepest``."""

    def __init__(self, keyed: DataFrame, nodes: DataFrame, deepest: int, band: int, values: list[str]):
        self.keyed, self.nodes, self.deepest, self.band, self.values = keyed, nodes, deepest, band, values

    def paths(self, step: int) -> DataFrame:
        """The keys from the top of its band to each row, at every ``step``-th depth."""
        w = Window.partitionBy("conv_id", F.floor((F.col("d") - 1) / (step * self.band))).orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.keyed.where((F.col("d") - 1) % step == 0).select("conv_id", "d", F.collect_list(F.struct(*KEY)).over(w).alias("path"))

    def spread(self, rows: DataFrame) -> DataFrame:
        """Sums of the values over all rows whose path passes a key."""
        up = rows.select(F.explode("path").alias("at"), *self.values)
        return up.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(*[F.sum(v).alias(v) for v in self.values])

    def totals(self, values: DataFrame, step: int = 1) -> DataFrame:
        """k1, k2 and subtree sums, given ``values`` (conv_id, d and the values) of the nodes at every ``step``-th depth."""
        paths = self.paths(step)
        inside = self.spread(values.join(paths, ["conv_id", "d"]))
        wide = step * self.band
        if self.deepest <= wide:
            return inside
        inside = cut_lineage(inside)
        tops = self.nodes.where((F.col("d") - 1) % wide == 0).select("conv_id", "d", *KEY)
        done = self.totals(tops.join(inside, KEY).drop(*KEY), wide)
        ends = paths.where((F.col("d") - 1) % wide == wide - step)  # the last of each band; what comes next begins the band below
        below = tops.where("d > 1").join(done, KEY).withColumn("d", F.col("d") - step).join(ends, ["conv_id", "d"])
        return cut_lineage(inside.unionByName(self.spread(below)).groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in self.values]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each key; pieces come in order, so only one state is held."""
    at, state, out = None, None, []
    for batch in batches:
        for k1, k2, piece in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "piece"))):
            if (k1, k2) == at:
                state.update(b"," + piece.encode())
                continue
            if at is not None:
                out.append((*at, state.hexdigest()))
            at, state = (k1, k2), hashlib.sha256(piece.encode())
        if out:
            yield _hashed(out)
            out = []
    if at is not None:
        yield _hashed([(*at, state.hexdigest())])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, digest = zip(*rows)
    return pa.RecordBatch.from_pydict({"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "ends_sha256": pa.array(digest, pa.string())})


def end_digests(ends: DataFrame) -> DataFrame:
    """k1, k2 and the SHA-256 of the comma-joined ascending ids of each key (k1, k2, conv_id; each id once)."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", ID_BITS).alias("nth")).agg(ids.alias("piece"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "nth").select(*KEY, "piece").mapInArrow(_digests, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, rows: DataFrame, band: int = BAND, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.

    ``convs`` holds each conversation (conv_id) and its ``depth``; ``rows`` its turns (conv_id, d, c1, c2, bytes, last). The
    root is the node of depth 0 and has all conversations, those without turns included; without any conversation there
    is no node. ``n_leaves`` counts the childless nodes of the subtree, ``saved_tokens`` adds up its nodes' (n_convs - 1)
    times the bytes of their last text, ``ends_sha256`` hashes the ids of the conversations that end in the node.
    """
    seen = convs.agg(F.min("conv_id").alias("low"), F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    keyed = prefix_keys(rows, block)
    nodes = keyed.groupBy(*KEY, "d").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = cut_lineage(nodes)
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    own = nodes.select("conv_id", "d", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
    sums = _Rollup(keyed, nodes, seen["deepest"] or 0, band, ["n_leaves", "saved_tokens"]).totals(own)
    zero = F.lit(0).cast("long")
    ended = keyed.where("last").select(*KEY, "conv_id").unionByName(convs.where("depth = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    inner = nodes.join(sums, KEY).join(parents, ["p1", "p2"], "left")
    inner = inner.select(*KEY, "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == 1, F.lit(seen["low"])).otherwise(F.col("parent")).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    whole = own.agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.when(F.col("d") == 1, 1)).alias("n_children"))
    root = whole.where(F.lit(seen["n"]) > 0).select(zero.alias("k1"), zero.alias("k2"), F.lit(seen["low"]).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(seen["n"]).cast("long").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"))
    none = hashlib.sha256(b"").hexdigest()
    out = inner.unionByName(root).join(end_digests(ended), KEY, "left")
    return out.drop(*KEY).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))


def conversation_trie(conversations: DataFrame, group: int = 5, heads: int = 9, band: int = BAND) -> DataFrame:
    """The trie (see :func:`prefix_trie`) of conversations (conv_id, turn, role, text) rebuilt with shared heads.

    Null role and text are empty, a null turn comes first, turns of equal number stand in the order of a hash of role and
    text, repeated rows are turns of their own; rows with a null conv_id take no part; other columns are ignored.
    """
    return prefix_trie(*rebuild(number_turns(conversations), group, heads), band)
