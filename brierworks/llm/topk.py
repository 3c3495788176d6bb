"""Exact top-k search by inner product with an M-tree on Spark.

Components are whole numbers; with R the largest squared length, every vector v gets one more component
sqrt(R - |v|^2), a query 0. Then |q - v|^2 = |q|^2 + R - 2 q.v, so the largest inner products are the nearest neighbours
in a metric space, where an M-tree applies.

The tree's root level divides the vectors among routing objects taken from a bounded sample; its nodes, with covering
radii, are the only part that is broadcast. Below, each node's vectors are cut into shards of bounded size, each an
M-tree of leaf pages: a routing object, the covering radius, the page's distance to the shard's routing object, and each
member's distance to its page's routing object. A query first searches its nearest root node best-first; what it finds
bounds the score that matters, and it visits only those other nodes whose ball reaches that bound. Inside a shard pages
are taken in the order of their lower bounds; stored distances and the triangle inequality save the computation of
distances to pages and members. All scores are computed in whole numbers, so ties are exact.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from brierworks.llm.vectors import matrix, numbered, usable
from brierworks.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_VALUES = 1 << 20
NODE_ROWS = 16_384
MAX_NODES = 1024
SHARD_VALUES = 1 << 20
QUERIES_A_TASK = 2048
PAGE_ROWS = 256

HIT = "query bigint, row bigint, vec_id bigint, score bigint"


def lift(x: np.ndarray, square: float) -> np.ndarray:
    """Vectors with the component that gives all of them squared length ``square``."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


def slack(square: float) -> float:
    """More than the rounding errors of distances between vectors of at most that squared length."""
    return 1e-6 * (1 + square**0.5)


class Shard:
    """An M-tree of two levels over some vectors of one root node."""

    def __init__(self, vec_id: np.ndarray, row: np.ndarray, x: np.ndarray, square: float, page_rows: int = PAGE_ROWS):
        self.vec_id, self.row, self.x, self.square = vec_id, row, x, square
        up = lift(x, square)
        rng = np.random.default_rng(len(x))
        k = max(1, -(-len(x) // page_rows))
        routing = up[rng.choice(len(x), k, replace=False)] if k > 1 else up[:1]
        near = distances(up, routing)
        home = near.argmin(axis=1) if k > 1 else np.zeros(len(x), np.int64)
        self.top = up.mean(axis=0)
        self.pages = []
        order = np.lexsort((near[np.arange(len(x)), home], home))
        edges = np.append(np.flatnonzero(np.diff(home[order], prepend=-1)), len(x))
        for a, b in zip(edges[:-1], edges[1:]):
            for s in range(a, b, 2 * page_rows):  # nearest members first: later pages of a crowded object are shells
                mine = order[s : min(b, s + 2 * page_rows)]
                r = routing[home[order[a]]]
                self.pages.append((mine, r, near[mine, home[order[a]]]))
        self.routing = np.array([r for _, r, _ in self.pages])
        self.radius = np.array([d.max() for _, _, d in self.pages])
        self.inner = np.array([d.min() for _, _, d in self.pages])
        self.from_top = distances(self.routing, self.top[None])[:, 0]
        self.saved = 0

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int, int]]:
        """The k best (score, -vec_id, index) with a score of at least ``floor``, ``own`` row left out."""
        big, eps = float(q @ q) + self.square, slack(self.square + float(q @ q))
        up = np.append(q.astype(np.float64), 0.0)
        best: list[tuple[int, int, int]] = []
        limit = np.sqrt(max(big - 2 * floor, 0)) + eps if floor > -np.inf else np.inf
        top = float(np.sqrt(((up - self.top) ** 2).sum()))
        queue = [(max(0.0, abs(top - f) - r), p) for p, (f, r) in enumerate(zip(self.from_top.tolist(), self.radius.tolist()))]
        heapq.heapify(queue)  # first by the bound that needs no distance to the page
        exact: set[int] = set()
        dist: dict[int, float] = {}
        while queue:
            bound, p = heapq.heappop(queue)
            if bound > limit:
                break
            if p not in exact:
                exact.add(p)
                dist[p] = d = float(np.sqrt(((up - self.routing[p]) ** 2).sum()))
                bound = max(0.0, d - self.radius[p], self.inner[p] - d)
                if bound <= limit:
                    heapq.heappush(queue, (bound, p))
                continue
            mine, _, parent = self.pages[p]
            keep = np.abs(parent - dist[p]) <= limit if limit < np.inf else np.ones(len(mine), bool)
            self.saved += len(mine) - int(keep.sum())
            mine = mine[keep]
            mine = mine[self.row[mine] != own]
            if not len(mine):
                continue
            score = self.score(mine, q)
            if len(best) == k:
                fine = score >= best[0][0]
                mine, score = mine[fine], score[fine]
            if len(score) > k:
                fine = score >= np.partition(score, -k)[-k]
                mine, score = mine[fine], score[fine]
            for s, v, i in zip(score.tolist(), self.vec_id[mine].tolist(), mine.tolist()):
                item = (s, -v, i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                limit = min(limit, np.sqrt(max(big - 2 * best[0][0], 0)) + eps)
        return best

    def score(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.square < 2.0**52:
            return (self.x[rows] @ q).astype(np.int64)  # exact in doubles
        return self.x[rows].astype(np.int64) @ q.astype(np.int64)


def _rooted(model, queries_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, dim = batch.column(batch.schema.get_field_index("x")), batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
            node, far = np.zeros(len(dim), np.int64), np.zeros(len(dim))
            for d in np.unique(dim).tolist():
                mine = np.flatnonzero(dim == d)
                routing, square = model.value[d]
                up = lift(matrix(x.take(pa.array(mine))), square)
                if queries_only:
                    up[:, -1] = 0
                near = distances(up, routing)
                node[mine] = near.argmin(axis=1)
                far[mine] = near.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int32()), pa.array(far, pa.float64())], names=[*batch.schema.names, "node", "far"])

    return run


def _others(model, radii):
    """The root nodes other than their own that queries have to visit, given the score they have reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, node, floor = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("dim", "node", "floor"))
            x = batch.column(batch.schema.get_field_index("x"))
            at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in np.unique(dim).tolist():
                mine = np.flatnonzero(dim == d)
                routing, square = model.value[d]
                q = matrix(x.take(pa.array(mine)))
                up = np.hstack([q, np.zeros((len(q), 1))])
                big = (q * q).sum(axis=1) + square
                limit = np.where(np.isfinite(floor[mine]), np.sqrt(np.maximum(big - 2 * np.where(np.isfinite(floor[mine]), floor[mine], 0), 0)) + slack(float(big.max(initial=0))), np.inf)
                visit = distances(up, routing) - radii.value[d] <= limit[:, None]
                visit &= radii.value[d] >= 0  # a node without members has radius -1
                visit[np.arange(len(mine)), node[mine]] = False
                a, b = np.nonzero(visit)
                at.append(mine[a])
                to.append(b)
            at, to = np.concatenate(at), np.concatenate(to)
            picked = batch.take(pa.array(at))
            yield picked.set_column(picked.schema.get_field_index("node"), "node", pa.array(to, pa.int32()))

    return run


def _searched(model, k: int):
    """The queries of a task against its shard."""

    def run(group: pa.Table) -> pa.Table:
        member = group.column("side").to_numpy() == 0
        x = matrix(group.column("x"))
        vec_id, row, floor = (group.column(c).to_numpy() for c in ("vec_id", "row", "floor"))
        out: list[tuple[int, int, int, int]] = []
        if member.any() and not member.all():
            order = np.argsort(row[member], kind="stable")
            _, square = model.value[int(group.column("dim")[0].as_py())]
            shard = Shard(vec_id[member][order], row[member][order], x[member][order], square)
            for q, own, least in zip(x[~member], row[~member].tolist(), floor[~member].tolist()):
                out += [(own, int(shard.row[i]), -v, s) for s, v, i in shard.search(q, own, k, least)]
        columns = list(zip(*out)) or [()] * 4
        return pa.table({c.split()[0]: pa.array(list(v), pa.int64()) for c, v in zip(HIT.split(", "), columns)})

    return run


def _tasks(members: DataFrame, queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every query of a node with every shard of the node; crowded nodes have several blocks of queries."""
    counts = queries.groupBy("dim", "node").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("blocks"))
    plan = F.broadcast(sizes.join(counts, ["dim", "node"]))  # at most MAX_NODES rows for each length of vectors
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["dim", "node", "row", "vec_id", "x"]
    left = members.join(plan, ["dim", "node"]).select(*keys, F.lit(0).alias("side"), F.lit(float("-inf")).alias("floor"), own("shards").alias("shard"), upto("blocks").alias("block"))
    right = queries.join(plan, ["dim", "node"]).select(*keys, F.lit(1).alias("side"), "floor", upto("shards").alias("shard"), own("blocks").alias("block"))
    return left.unionByName(right).groupBy("dim", "node", "shard", "block")


def _best(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, node_rows: int = NODE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` highest scores, ties to the smaller vec_id.

    Queries are the rows of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``; candidates are all
    other rows. A score is the inner product of the components floor(scale * x), exact while squared lengths stay below
    2**62. Vectors that are null or hold null or non-finite components take no part; vectors of different length do not
    meet. A repeated row is a candidate, or query, of its own; a null vec_id comes last among ties.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(usable(F.col("e")))
    table = numbered(good.select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("x")))
    square = F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)
    stats = table.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()
    values = sum(r["n"] * (r["dim"] + 1) for r in stats)
    lot = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / (1 << 30)
    sample: dict[int, list] = {}
    for r in table.where(lot < min(1.0, SAMPLE_VALUES / max(1, values))).select("dim", "row", "x").collect():
        sample.setdefault(r["dim"], []).append((r["row"], r["x"]))
    model = {}
    for r in stats:
        rows = [x for _, x in sorted(sample.get(r["dim"], []))]
        rows = np.array(rows, np.float64).reshape(len(rows), r["dim"])
        rows = np.unique(rows, axis=0) if len(rows) else np.zeros((1, r["dim"]))
        pick = np.random.default_rng(0).permutation(len(rows))[: min(MAX_NODES, -(-r["n"] // node_rows))]
        model[r["dim"]] = (lift(rows[pick], r["square"]), float(r["square"]))
    sent = spark.sparkContext.broadcast(model)
    schema = "vec_id bigint, dim int, x array<double>, row bigint, node int, far double"
    known = table.withColumn("vec_id", F.coalesce("vec_id", F.lit((1 << 63) - 1)))
    columns = ["vec_id", "dim", "x", "row"]
    members = known.select(*columns).mapInArrow(_rooted(sent, False), schema)
    found = members.groupBy("dim", "node").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    radius = {d: np.full(len(model[d][0]), -1.0) for d in model}
    for r in found:
        radius[r["dim"]][r["node"]] = r["radius"]
    sizes = spark.createDataFrame([(r["dim"], r["node"], -(-r["n"] // max(PAGE_ROWS, SHARD_VALUES // (r["dim"] + 1)))) for r in found], "dim int, node int, shards int")
    asked = known.where(F.col("vec_id") % every == 0).where(F.col("vec_id") < (1 << 63) - 1).select(*columns)
    first = asked.mapInArrow(_rooted(sent, True), schema).drop("far").withColumn("floor", F.lit(float("-inf")))
    near = cut_lineage(_tasks(members, first, sizes).applyInArrow(_searched(sent, k), HIT))
    reached = _best(near, k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") == k, F.col("least").cast("double")).otherwise(float("-inf"))
    bounded = first.drop("floor").join(reached, F.col("row") == F.col("query"), "left").select(*columns, "node", F.coalesce(floor, F.lit(float("-inf"))).alias("floor"))
    rest = bounded.mapInArrow(_others(sent, spark.sparkContext.broadcast(radius)), "vec_id bigint, dim int, x array<double>, row bigint, node int, floor double")
    far = _tasks(members, rest, sizes).applyInArrow(_searched(sent, k), HIT)
    best = _best(near.unionByName(far), k)
    names = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", F.nullif("vec_id", F.lit((1 << 63) - 1)).alias("vec_id"), "score")
