"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative a group.

Every vector has a home cell, that of its nearest centroid. A vector within the threshold angle of a cell's border is a
guest of that cell too: for unit vectors x of cell c and y of cell h with angle(x, y) <= t, y lies at most sin t beyond
the plane that separates the two centroids. So each home vector meets all vectors that it can be linked with, and the
links found are all there are. Cells larger than BLOCK rows are cut into blocks, and each pair of a home block and a
block of members is a task of its own.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from brierworks.llm.components import components, forest
from brierworks.llm.vectors import matrix, numbered, usable
from brierworks.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_VALUES = 1 << 21
CELL_ROWS = 4096
MAX_CELLS = 256
MAX_LABELS = 256
BLOCK = 1024
ROUNDS = 8
SLACK = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """At most ``k`` distinct unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = np.unique(x, axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return np.unique(centres, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dealt(centroids, threshold: float):
    """Home and guest cells of each vector."""
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = centroids.value
        for batch in batches:
            label, dim, row = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("label", "dim", "row"))
            vectors = batch.column(batch.schema.get_field_index("v"))
            for key in sorted(set(zip(label.tolist(), dim.tolist()))):
                mine = np.flatnonzero((label == key[0]) & (dim == key[1]))
                at, cell, guest = np.arange(len(mine)), np.zeros(len(mine), np.int64), np.zeros(len(mine), bool)
                if key in model:
                    centres = model[key]
                    x = unit(matrix(vectors.take(pa.array(mine))))
                    near = x @ centres.T
                    home = near.argmax(axis=1)
                    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
                    beyond = near[at, home][:, None] - near <= (reach * apart + SLACK)[home]
                    beyond[at, home] = False
                    a, c = np.nonzero(beyond)
                    at, cell, guest = np.append(at, a), np.append(home, c), np.append(guest, np.ones(len(a), bool))
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array(np.full(len(at), key[0]), pa.int64()), "dim": pa.array(np.full(len(at), key[1]), pa.int32()),
                    "cell": pa.array(cell, pa.int32()), "guest": pa.array(guest, pa.bool_()), "row": pa.array(row[mine][at], pa.int64()),
                })

    return run


def _compared(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        home = group.column("side").to_numpy() == 0
        row = group.column("row").to_numpy()
        x = unit(matrix(group.column("v")))
        a, b, ra, rb = x[home], x[~home], row[home], row[~home]
        count = np.zeros(len(ra), np.int64)
        every, place = np.unique(np.concatenate([ra, rb]), return_inverse=True)
        parent = np.arange(len(every))
        for i in range(0, len(ra), 512):
            near = a[i : i + 512] @ b.T >= threshold
            p, q = np.nonzero(near)
            other = ra[i + p] != rb[q]
            p, q = p[other] + i, q[other]
            count += np.bincount(p, minlength=len(ra))
            parent = forest(len(every), place[p], place[len(ra) + q], parent)
        root = every[parent[place[: len(ra)]]]
        kids = np.flatnonzero(parent != np.arange(len(every)))
        return pa.table({
            "row": pa.array(np.concatenate([ra, every[kids]]), pa.int64()),
            "n": pa.array(np.concatenate([count, np.zeros(len(kids), np.int64)]), pa.int64()),
            "root": pa.array(np.concatenate([root, every[parent[kids]]]), pa.int64()),
        })

    return run


def fit_cells(active: DataFrame, cell_rows: int = CELL_ROWS, seed: int = 0) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of each label and dimension with more than ``cell_rows`` vectors.

    At most MAX_LABELS such groups get cells of their own, the largest first, with at most MAX_CELLS in one and 4096 in
    all; they are fitted on about SAMPLE_VALUES components of rows chosen by a hash. Cells only divide the work: links
    are the same whatever the centroids are.
    """
    big = active.groupBy("label", "dim").count().where(F.col("count") > cell_rows).orderBy(F.desc("count"), "label", "dim").limit(MAX_LABELS).collect()
    if not big:
        return {}
    values = sum(r["count"] * r["dim"] for r in big)
    share = min(1.0, SAMPLE_VALUES / values)
    keys = active.sparkSession.createDataFrame([(r["label"], r["dim"]) for r in big], "label bigint, dim int")
    lot = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    sample: dict[tuple[int, int], list] = {}
    for r in active.where(lot < share).join(F.broadcast(keys), ["label", "dim"]).select("label", "dim", "row", "v").collect():
        sample.setdefault((r["label"], r["dim"]), []).append((r["row"], r["v"]))
    wanted = {(r["label"], r["dim"]): min(MAX_CELLS, -(-r["count"] // cell_rows)) for r in big}
    scale = min(1.0, 4096 / sum(wanted.values()))
    out = {}
    for key, rows in sample.items():
        x = unit(np.array([v for _, v in sorted(rows)], np.float64))
        centres = spherical_kmeans(x, max(2, int(wanted[key] * scale)), seed=seed)
        if len(centres) > 1:
            out[key] = centres
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and their cosine is at least ``threshold`` (over 0). Vectors that are null,
    zero, empty, or hold null or non-finite components link with nothing, nor do rows without a label or vectors of
    different length. A repeated row is a vector of its own, which links with its twins. component_id is the smallest
    vec_id reachable; it is null only if no row of the component has one. kept is false for a null vec_id.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    table = numbered(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label")))
    active = table.where(usable(F.col("v")) & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)).select("row", "label", F.size("v").alias("dim"), "v")
    spark = vectors.sparkSession
    model = spark.sparkContext.broadcast(fit_cells(active, cell_rows))
    dealt = cut_lineage(active.mapInArrow(_dealt(model, threshold), "label bigint, dim int, cell int, guest boolean, row bigint"))
    cell = ["label", "dim", "cell"]
    blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    sizes = dealt.groupBy(*cell).agg(blocks(F.count_if(~F.col("guest"))).alias("homes"), blocks(F.count("*")).alias("members"))
    placed = dealt.join(sizes, cell)
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    homes = placed.where("not guest").select("row", *cell, F.lit(0).alias("side"), own("homes").alias("i"), F.explode(upto("members")).alias("j"))
    others = placed.select("row", *cell, F.lit(1).alias("side"), F.explode(upto("homes")).alias("i"), own("members").alias("j"))
    tasks = homes.unionByName(others.select(*homes.columns)).join(active.select("row", "v"), "row")
    found = cut_lineage(tasks.groupBy(*cell, "i", "j").applyInArrow(_compared(threshold), "row bigint, n bigint, root bigint"))
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    classes = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    rows = table.select("row", "vec_id").join(classes.withColumnRenamed("node", "row"), "row", "left").select("row", "vec_id", F.coalesce("root", "row").alias("root"))
    least = rows.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = rows.join(least, "root").join(counts, "row", "left")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
