"""SimHash near-duplicates: 64-bit fingerprints linked by a binary trie self-join.

Every fingerprint is stored under five rotations of its bits. Four differing bits cannot touch all five blocks of 12 or
13 bits, and some rotation spreads them so evenly that after k blocks at most 4k/5 bits differ; so the trie of each
rotation is traversed with a budget that starts at zero and grows with the depth. The zero budget on the first block
means that node pairs there are a node with itself, which is where Spark cuts the tries apart.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from brierworks.llm.common import ids, mix, order_id, partitions, seeded, table_of, text_slices
from brierworks.llm.components import components, forest
from brierworks.session import cut_lineage

SEED = 42
BITS = 64
LEAF_PAIRS = 1 << 17
BLOCK = 256
BLOCK_HASHES = 1 << 21  # of a block of a family
TASK_HASHES = 1 << 20  # of a task, on average
SKETCH = 64
SLACK = 0.15
GROUP_ROWS = 1 << 15


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fingerprint(text: bytes, words: int, distinct: bool = False) -> int:
    """SimHash of a text's word shingles, repeats included or each ``distinct`` one once; zero for a text without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    plain = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.append(0, ends[:-1])
    n = max(1, len(parts) - words + 1)
    last = (ends[words - 1 :] if len(parts) >= words else ends[-1:]) - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    every = np.empty(n if distinct else 0, "<u8")
    for k in range(0, n, 1 << 15):
        pairs = zip(starts[k : min(n, k + (1 << 15))].tolist(), last[k : k + (1 << 15)].tolist())
        hashes = np.array([digest(plain[s:e], SEED) for s, e in pairs], "<u8")
        if distinct:
            every[k : k + len(hashes)] = hashes
        else:
            ones += _bit_counts(hashes)
    if distinct:
        every = np.unique(every)
        n = len(every)
        for k in range(0, n, 1 << 15):
            ones += _bit_counts(every[k : k + (1 << 15)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprints(words: int, distinct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts, ends in text_slices(batch):
                whole = data.tobytes()
                prints = [fingerprint(whole[s:e], words, distinct) for s, e in zip(starts.tolist(), ends.tolist())]
                yield table_of(batch, i, j, ["doc_id"], fp=pa.array(prints, pa.int64()))

    return run


def fingerprints(docs: DataFrame, words: int = 5, distinct: bool = False) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a long), one row per input row; see :func:`fingerprint`."""
    return ids(docs).mapInArrow(_fingerprints(words, distinct), "doc_id bigint, fp bigint")


def blocks(budget: int) -> list[int]:
    """First bit of each of budget + 1 blocks, and the end."""
    return [BITS * k // (budget + 1) for k in range(budget + 2)]


def _rotated(fps: np.ndarray, by: int) -> np.ndarray:
    return fps if by == 0 else (fps << np.uint64(by)) | (fps >> np.uint64(BITS - by))


def _allowed(budget: int, by: int) -> np.ndarray:
    """Differing bits that a pair of nodes may have after each number of leading bits in the rotation by ``by`` bits."""
    edges = blocks(budget)
    k = edges.index(by)
    sizes = [b - a for a, b in zip(edges, edges[1:])]
    ends = np.cumsum(sizes[k:] + sizes[:k])
    return np.array([np.searchsorted(ends, d, "left") if d else 0 for d in range(BITS + 1)]).clip(0, budget)


def trie_pairs(left: np.ndarray, right: np.ndarray | None, allowed: np.ndarray, budget: int, leaf: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within ``budget`` bits, by a joint traversal of two binary tries.

    ``left`` and ``right`` are sorted and distinct; a trie node is a range of such an array. Without ``right`` the trie
    meets itself and each pair appears once. A pair of nodes is dropped as soon as its differing bits exceed what
    ``allowed`` grants at its depth, and compared directly once one of its nodes has ``leaf`` members or fewer.
    """
    same, right = right is None, left if right is None else right
    stack = [(0, *(np.array([x]) for x in (0, len(left), 0, len(right), 0)))] if len(left) and len(right) else []
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        done = np.minimum(a1 - a0, b1 - b0) <= leaf if depth < BITS else np.ones(len(a0), bool)
        if done.any():
            yield from _leaf_pairs(left, right, a0[done], a1[done], b0[done], b1[done], same, budget)
            a0, a1, b0, b1, err = (x[~done] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if len(a0) > 1 << 16:  # bounded frontiers: the rest waits on the stack
            half = len(a0) // 2
            stack += [(depth, *(x[s] for x in (a0, a1, b0, b1, err))) for s in (slice(half), slice(half, None))]
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        above = ~np.uint64((1 << (BITS - depth)) - 1) if depth else np.uint64(0)
        am = np.clip(np.searchsorted(left, (left[a0] & above) | bit), a0, a1)
        bm = np.clip(np.searchsorted(right, (right[b0] & above) | bit), b0, b1)
        twin = same & (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), tuple(x[~twin] for x in (am, a1, b0, bm, err + 1))]
        merged = [np.concatenate(x) for x in zip(*parts)]
        keep = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= allowed[depth + 1])
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in merged)))


def _leaf_pairs(left, right, a0, a1, b0, b1, same, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compares all members of node pairs, about LEAF_PAIRS at a time."""
    lines = np.repeat(np.arange(len(a0)), a1 - a0)
    a = np.arange(len(lines)) - np.repeat(np.cumsum(a1 - a0) - (a1 - a0), a1 - a0) + a0[lines]
    start, width = b0[lines], (b1 - b0)[lines]
    upto = np.cumsum(width)
    k = 0
    while k < len(a):
        m = max(k + 1, int(np.searchsorted(upto, upto[k] - width[k] + LEAF_PAIRS, "right")))
        w = width[k:m]
        x = np.repeat(a[k:m], w)
        y = np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[k:m], w)
        near = np.bitwise_count(left[x] ^ right[y]) <= budget
        if same:
            near &= x < y
        yield x[near], y[near]
        k = m


def _linked(budget: int):
    edges = blocks(budget)
    allowed = {edges[r]: _allowed(budget, edges[r]) for r in range(budget + 1)}

    def run(group: pa.Table) -> pa.Table:
        by = edges[group.column("rot")[0].as_py()]
        fps = _rotated(group.column("fp").to_numpy().view(np.uint64), by)
        side = group.column("side").to_numpy()
        left = np.sort(fps[side == 0])
        right = np.sort(fps[side == 1]) if (side == 1).any() else None
        every = left if right is None else np.concatenate([left, right])
        parent = np.arange(len(every))
        for x, y in trie_pairs(left, right, allowed[by], budget):
            parent = forest(len(every), x, y if right is None else y + len(left), parent)
        child = np.flatnonzero(parent != np.arange(len(every)))
        back = [_rotated(every[k], BITS - by if by else 0).view(np.int64) for k in (child, parent[child])]
        return pa.table({"a": pa.array(back[0], pa.int64()), "b": pa.array(back[1], pa.int64())})

    return run


def _dealt(points: DataFrame, budget: int, group_rows: int) -> DataFrame:
    """The points (with a column ``fp``) under every rotation, dealt to the tasks of the trie join.

    A trie part that holds more than ``group_rows`` points is cut into chunks, and each pair of chunks is a task of its
    own: exact, with bounded tasks. The chunk counts are a table of at most (budget + 1) x 4096 rows, which is broadcast.
    """
    edges = blocks(budget)
    bits = min(edges[1], 12, max(2, int(points.count() // (group_rows // 8)).bit_length()))
    turned = lambda r: F.expr(f"shiftleft(fp, {edges[r]}) | shiftrightunsigned(fp, {BITS - edges[r]})") if r else F.col("fp")
    keys = F.array(*[F.struct(F.lit(r).alias("rot"), F.shiftrightunsigned(turned(r), BITS - bits).alias("top")) for r in range(budget + 1)])
    spread = points.withColumn("key", F.explode(keys)).select(*points.columns, "key.rot", "key.top")
    sizes = spread.groupBy("rot", "top").count().select("rot", "top", F.ceil(F.col("count") / group_rows).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64(*points.columns[:2]), F.col("chunks")).cast("int")
    cut = spread.join(F.broadcast(sizes), ["rot", "top"]).withColumn("own", own)
    return _pairs_of_blocks(cut, "own", "chunks").select(*points.columns, "rot", "top", "i", "j", "side")


def fingerprint_links(prints: DataFrame, budget: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that join the distinct values of ``fp`` just as all pairs within ``budget`` bits would."""
    if not 0 <= budget <= 15:
        raise ValueError("budget must be between 0 and 15 bits")
    tasks = _dealt(prints.where("fp is not null").select("fp").distinct(), budget, group_rows)
    return tasks.groupBy("rot", "top", "i", "j").applyInArrow(_linked(budget), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, budget: int = 4) -> DataFrame:
    """doc_id, fp and component_id, one row per input row.

    component_id is the smallest doc_id reachable over fingerprints within ``budget`` bits. A text without words (null,
    empty, blank) has fingerprint zero and links like any other; a row whose doc_id is null takes part in linking, and
    component_id is null only where no row of the component has an id. Repeated rows come back repeated.
    """
    prints = cut_lineage(fingerprints(docs, words))
    classes = components(fingerprint_links(prints, budget))
    first = prints.groupBy("fp").agg(F.min(order_id()).alias("low"))
    placed = first.join(classes.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(least, "root").select("fp", F.nullif("component_id", F.lit((1 << 63) - 1)).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _first_rotation(far: np.ndarray, budget: int) -> np.ndarray:
    """The first rotation in which a pair that differs in the bits ``far`` keeps to the growing budget: it is sure to be
    found there, so that no other task needs to report it."""
    edges = blocks(budget)
    m = budget + 1
    counts = [np.bitwise_count(far & np.uint64((1 << (BITS - a)) - (1 << (BITS - b)))).astype(np.int16) for a, b in zip(edges, edges[1:])]
    first = np.full(len(far), -1)
    for r in range(m):
        run, ok = np.zeros(len(far), np.int16), first < 0
        for k in range(m):
            run = run + counts[(r + k) % m]
            ok &= run <= k
        first[ok] = r
    return first


def _akin(budget: int, least: int):
    """Pairs within ``budget`` bits whose sketches agree in ``least`` places: a forest of the most alike of a trie task."""
    edges = blocks(budget)
    allowed = {edges[r]: _allowed(budget, edges[r]) for r in range(budget + 1)}

    def run(group: pa.Table) -> pa.Table:
        rot = group.column("rot")[0].as_py()
        by = edges[rot]
        fps = _rotated(group.column("fp").to_numpy().view(np.uint64), by)
        node, side = group.column("node").to_numpy(), group.column("side").to_numpy()
        order = np.lexsort((node, fps, side))
        fps, node = fps[order], node[order]
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)[order]
        cut = int((side == 0).sum())
        held = [np.zeros(0, np.int64)] * 3
        for x, y in trie_pairs(fps[:cut], fps[cut:] if cut < len(fps) else None, allowed[by], budget):
            y = y if cut == len(fps) else y + cut
            own = _first_rotation(_rotated(fps[x] ^ fps[y], BITS - by if by else 0), budget) == rot
            x, y = x[own], y[own]
            same = (sketch[x] == sketch[y]).sum(axis=1)
            near = same >= least
            if near.any():
                held = [np.concatenate(c) for c in zip(held, (SKETCH - same[near], x[near], y[near]))]
                keep = spanning(len(node), held[1], held[2], held[0])
                held = [c[keep] for c in held]
        return pa.table({"a": pa.array(node[held[1]], pa.int64()), "b": pa.array(node[held[2]], pa.int64())})

    return run


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the pairs of a lightest spanning forest of ``n`` nodes."""
    rank = np.lexsort((np.maximum(a, b), np.minimum(a, b), weight))
    x, y = a[rank], b[rank]
    parent, chosen, live = np.arange(n), [], np.arange(len(rank))
    while True:
        live = live[parent[x[live]] != parent[y[live]]]
        if not len(live):
            return rank[np.concatenate(chosen)] if chosen else rank[:0]
        best = np.full(n, len(rank))
        np.minimum.at(best, parent[x[live]], live)
        np.minimum.at(best, parent[y[live]], live)
        pick = np.unique(best[best < len(rank)])
        chosen.append(pick)
        parent = forest(n, x[pick], y[pick], parent)


def shingles(text: str | None, words: int) -> set[bytes]:
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in shingles(text, words)], np.uint64))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets of hashes; two empty sets are equal."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def digests(text: bytes, words: int) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes, none for a text without words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    plain = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.append(0, ends[:-1])
    n = max(1, len(parts) - words + 1)
    last = (ends[words - 1 :] if len(parts) >= words else ends[-1:]) - 1
    out, digest = np.empty(n, np.uint64), xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 15):
        pairs = zip(starts[k : min(n, k + (1 << 15))].tolist(), last[k : k + (1 << 15)].tolist())
        out[k : k + (1 << 15)] = [digest(plain[s:e], SEED) for s, e in pairs]
    return np.unique(out)


def sketch_of(hashes: np.ndarray) -> bytes:
    """One byte of the smallest of the hashes under each of SKETCH orders: two sketches agree in a place with a chance of
    about the similarity of the sets."""
    least = np.full(SKETCH, np.uint64((1 << 64) - 1))
    a = seeded(SKETCH, 11) | np.uint64(1)
    for k in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, (hashes[None, k : k + (1 << 11)] * a[:, None]).min(axis=1))
    return (mix(least) & np.uint64(255)).astype(np.uint8).tobytes()


def _profiles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts, ends in text_slices(batch):
                whole = data.tobytes()
                fps, sketches, sizes = [], [], []
                for s, e in zip(starts.tolist(), ends.tolist()):
                    every = digests(whole[s:e], words)
                    ones = sum((_bit_counts(every[k : k + (1 << 15)]) for k in range(0, len(every), 1 << 15)), np.zeros(BITS, np.int64))
                    fps.append(int(np.packbits(2 * ones > len(every), bitorder="little").view("<i8")[0]))
                    sketches.append(sketch_of(every))
                    sizes.append(len(every))
                yield table_of(batch, i, j, ["doc_id"], fp=pa.array(fps, pa.int64()), sketch=pa.array(sketches, pa.binary()), size=pa.array(sizes, pa.int64()))

    return run


def _digested(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts, ends in text_slices(batch):
                whole = data.tobytes()
                rows = [digests(whole[s:e], words).view(np.int64) for s, e in zip(starts.tolist(), ends.tolist())]
                yield table_of(batch, i, j, ["doc_id"], hashes=pa.array(rows, pa.list_(pa.int64())))

    return run


def _verified(budget: int, similarity: float):
    """Labels that are joined by candidate pairs with the similarity, in one block of a family or between two blocks of it:
    each but the smallest of a class with the smallest."""

    def part(rows: dict[str, np.ndarray], hashes: list[np.ndarray]) -> list[tuple[int, int]]:
        node, fp, side = rows["node"], rows["fp"].view(np.uint64), rows["side"]
        names, label = np.unique(rows["label"], return_inverse=True)
        size = np.array([len(h) for h in hashes])
        parent = list(range(len(names)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        right = np.flatnonzero(side == 1) if side.any() else np.arange(len(node))
        for m in right.tolist():
            others = np.flatnonzero(side == 0) if side.any() else np.arange(m)
            small, large = np.minimum(size[others], size[m]), np.maximum(size[others], size[m])
            near = (np.bitwise_count(fp[others] ^ fp[m]) <= budget) & (small >= similarity * large)
            for k in others[near].tolist():
                p, q = root(int(label[k])), root(int(label[m]))
                if p != q and jaccard(hashes[k], hashes[m]) >= similarity:
                    parent[max(p, q)] = min(p, q)
        least = [root(k) for k in range(len(names))]
        return [(int(names[k]), int(names[r])) for k, r in enumerate(least) if k != r]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("family", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")]).combine_chunks()
        columns = {c: group.column(c).to_numpy() for c in ("family", "i", "j", "node", "fp", "side", "label")}
        lists = group.column("hashes").combine_chunks() if isinstance(group.column("hashes"), pa.ChunkedArray) else group.column("hashes")
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, at = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
        new = np.append(True, (np.diff(columns["family"]) != 0) | (np.diff(columns["i"]) != 0) | (np.diff(columns["j"]) != 0))
        edges, links = np.append(np.flatnonzero(new), len(new)).tolist(), []
        for a, b in zip(edges, edges[1:]):
            links += part({c: v[a:b] for c, v in columns.items()}, [flat[at[k] : at[k + 1]] for k in range(a, b)])
        first = list(zip(*links)) or [(), ()]
        return pa.table({"a": pa.array(list(first[0]), pa.int64()), "b": pa.array(list(first[1]), pa.int64())})

    return run


def _pairs_of_blocks(df: DataFrame, own: str, blocks: str) -> DataFrame:
    """Every row once for each pair of blocks (i <= j) that its own block belongs to; ``side`` tells which of the two."""
    pair = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), F.when(k < F.col(own), 1).otherwise(0).alias("side")))
    return df.withColumn("_pair", F.explode(pair)).select(*df.columns, "_pair.*")


def similar_groups(docs: DataFrame, words: int = 5, budget: int = 12, similarity: float = 0.8, group_rows: int = GROUP_ROWS, block: int = BLOCK) -> DataFrame:
    """node (hash of a distinct text) and ``label``, equal for texts that are joined by verified links.

    Candidates are fingerprints of the distinct shingles within ``budget`` bits, from the trie join; a link needs a
    Jaccard similarity of word shingles of at least ``similarity``, computed on whole texts. Each point carries a sketch of
    SKETCH bytes, which tells chance neighbours from relatives inside the trie task (a pair of the similarity falls below
    its mark, SLACK less, with a chance under 0.1 %); the tasks' forests of related pairs give families. Then texts are
    compared as sets of hashes, each text hashed once: first within blocks of a family, of about ``block`` texts and
    a bounded number of hashes; then one text of each group found so far, where a family has several blocks; and only
    where several groups are left in such a family, every pair of its blocks. Pairs that are already joined are not
    compared. So the groups are those of all related candidate pairs, and no list of all pairs is made.
    """
    if not 0 <= budget <= 15:
        raise ValueError("budget must be between 0 and 15 bits")
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = texts.mapInArrow(_profiles(words), "doc_id bigint, fp bigint, sketch binary, size bigint")
    nodes = cut_lineage(profiles.withColumnRenamed("doc_id", "node").dropDuplicates(["node"]))
    points = cut_lineage(nodes.groupBy("fp", "sketch").agg(F.min("node").alias("node")).select("node", "fp", "sketch"))
    tasks = _dealt(points, budget, group_rows)
    least = int(SKETCH * max(0.0, similarity - SLACK))
    pairs = tasks.groupBy("rot", "top", "i", "j").applyInArrow(_akin(budget, least), "a bigint, b bigint")
    twins = nodes.select("node", "fp", "sketch").join(points.withColumnRenamed("node", "b"), ["fp", "sketch"]).where("node <> b").select(F.col("node").alias("a"), "b")
    kin = cut_lineage(components(pairs.unionByName(twins)))
    bytes_ = F.ceil(F.sum("size") / BLOCK_HASHES)
    members = nodes.join(kin.withColumnRenamed("root", "family"), "node")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), bytes_, F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = cut_lineage(members.join(sizes, "family").select("family", "node", "fp", "size", "blocks", own.alias("own"), F.col("node").alias("label")))
    hashed = texts.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_digested(words), "doc_id bigint, hashes array<bigint>")
    hashed = cut_lineage(hashed.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "node"))

    def links(dealt: DataFrame) -> DataFrame:
        total = dealt.agg(F.sum("size")).first()[0] or 0
        task = F.pmod(F.xxhash64("family", "i", "j"), F.lit(max(partitions(docs), -(-total // TASK_HASHES))))
        rows = dealt.join(hashed, "node").select(task.alias("task"), "family", "i", "j", "side", "node", "fp", "label", "hashes")
        return rows.groupBy("task").applyInArrow(_verified(budget, similarity), "a bigint, b bigint")

    def joined(groups: DataFrame, found: DataFrame) -> DataFrame:
        classes = components(found).select(F.col("node").alias("label"), "root")
        return cut_lineage(groups.join(classes, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root").select(groups.columns))

    alone = [F.col("own").alias("i"), F.col("own").alias("j"), F.lit(0).alias("side")]
    # a block is judged in one task, which names the smallest text of each of its groups
    found = links(members.select("*", *alone)).select(F.col("a").alias("node"), F.col("b").alias("low"))
    groups = cut_lineage(members.join(found, "node", "left").withColumn("label", F.coalesce("low", "node")).drop("low").select(members.columns))
    several = groups.where("blocks > 1")
    if not several.isEmpty():
        # one text of each group of a block stands for it, in blocks of their own
        heads = several.groupBy("family", "own", "label").agg(F.min(F.struct("node", "fp", "size")).alias("h")).select("family", "label", "h.*")
        shares = heads.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), bytes_).cast("int").alias("blocks"))
        dealt = heads.join(shares, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        several = joined(several, links(dealt.select("*", *alone)))
        open_ = several.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("family")
        rest = cut_lineage(several.join(open_, "family", "left_semi"))
        if not rest.isEmpty():
            several = joined(several, links(_pairs_of_blocks(rest, "own", "blocks").where("i < j")))
        groups = groups.where("blocks = 1").unionByName(several)
    return nodes.select("node").join(groups.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def deduplicate(docs: DataFrame, words: int = 5, budget: int = 12, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of similar texts the one with the smallest doc_id.

    See :func:`similar_groups`. Null ids come after all others; of rows with one id the text with the smaller hash stays,
    and of repeated rows one. Null and blank texts have no shingles and are similar to each other.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(row).select("doc", F.xxhash64(F.col("doc.text").cast("string")).alias("node"), F.coalesce(F.col("doc.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("low"), F.xxhash64(F.lit(1), F.col("doc.text").cast("string")).alias("check"))
    first = keyed.groupBy("node", "check").agg(F.min("low").alias("low"))
    groups = similar_groups(docs, words, budget, similarity)
    # another text with the hash of a node is a group of its own
    nth = F.row_number().over(Window.partitionBy("node").orderBy("check"))
    first = first.withColumn("nth", nth).join(groups, "node").withColumn("label", F.struct("label", F.when(F.col("nth") > 1, F.col("check")).alias("check")))
    stays = first.groupBy("label").agg(F.min(F.struct("low", "node", "check")).alias("stays")).select("stays.*")
    return keyed.join(stays, ["low", "node", "check"], "left_semi").dropDuplicates(["low", "node", "check"]).select("doc.*")
