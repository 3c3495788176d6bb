"""Hard negatives from rotated one-bit codes.

Every vector is rotated (random signs and Hadamard transforms) and stored as a chain of one-bit codes: the signs of the
rotated vector, then the signs of what the code before leaves over, rotated anew, each with its alignment (the
least-squares length of the rest along its code) and the length of the new rest. An anchor is rotated alike and cut into
bit planes, so that its inner product with a code is a few popcounts. Estimate and truth differ by the products with the
two rests, which the Cauchy-Schwarz inequality bounds for certain: each pair has an interval that holds its score.
Intervals narrow from code to code, and pairs whose interval cannot matter any more are left out at once; those that stay
are scored in integers.

Anchors meet all rows in blocks: a task holds a shard of vectors and a block of anchors, both of bounded size. A few
anchors ask the codes of a chain one by one. For many, each vector's chain is summed up once, in the frame of its last
code, and the estimates of a slice of vectors for a group of anchors are one matrix product; the interval is that of the
whole chain, with a bound of what the product rounds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from brierworks.llm.common import NO_ID, seeded, worker_memory
from brierworks.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CODES = 6
PLANES = 8
SHARD_VALUES = 1 << 21
ANCHORS_A_TASK = 16_384
ENCODED_VALUES = 1 << 20
FEW = 8  # anchors for which summing up a shard's chains costs more than it saves
GROUP, SLICE, FIRST = 512, 4096, 512  # anchors and vectors of a matrix product, vectors of the first one
DENSE = 512  # the widest rotation that is kept as a matrix

STORED = "vec_id bigint, label bigint, dim int, x binary, row bigint, code binary, align binary, rest binary"
WANTED = "array<struct<row: bigint, vec_id: bigint, score: bigint>>"
HIT = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, row bigint, vec_id bigint, score bigint"


def rotated(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Rows under a fixed rotation, filled with zeros to a power of two of at least 64 components."""
    width = max(64, 1 << (x.shape[1] - 1).bit_length())
    if width > DENSE:
        return turned(x, width, seed)
    kept, key = worker_memory(), ("rotation", width, seed)
    if key not in kept:
        kept[key] = turned(np.eye(width), width, seed)
    return x @ kept[key][: x.shape[1]]


def turned(x: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Rows under the random signs and Hadamard transforms of a rotation."""
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for turn in (1, 2):
        out *= np.where(seeded(width, 2 * seed + turn) >> np.uint64(63), 1.0, -1.0)
        step = 1
        while step < width:
            pair = out.reshape(len(x), width // (2 * step), 2, step)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(bits, axis=1).view(np.uint64)


def encode(x: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words (rows x codes x words), alignments and lengths of the rests (rows x codes)."""
    rest, words, align, left = x, [], [], []
    for j in range(codes):
        rest = rotated(rest, j)
        plus = rest >= 0
        length = np.abs(rest).mean(axis=1)
        rest = rest - np.where(plus, length[:, None], -length[:, None])
        words.append(packed(plus))
        align.append(length)
        left.append(np.sqrt((rest * rest).sum(axis=1)))
    return np.stack(words, axis=1), np.stack(align, axis=1), np.stack(left, axis=1)


def summed(words: np.ndarray, align: np.ndarray) -> np.ndarray:
    """What the codes of each chain add up to, in the frame of the last code."""
    out = np.zeros((len(words), 64 * words.shape[2]))
    for j in range(words.shape[1]):
        plus = np.unpackbits(np.ascontiguousarray(words[:, j]).view(np.uint8), axis=1).astype(bool)
        out = (rotated(out, j) if j else out) + np.where(plus, align[:, j, None], -align[:, j, None])
    return out


class Planes:
    """A rotated anchor as bit planes: its components in steps of equal size, and the length of what that leaves out."""

    def __init__(self, turned: np.ndarray, planes: int):
        self.low = float(turned.min())
        self.step = float(turned.max() - self.low) / ((1 << planes) - 1) or 1.0
        level = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.planes = [packed(((level >> b) & 1).astype(bool)[None])[0] for b in range(planes)]
        self.total, self.width = int(level.sum()), len(turned)
        left = turned - (self.low + self.step * level)
        self.left = float(np.sqrt(left @ left))

    def product(self, code: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products with codes of +1 and -1; ``ones`` counts their set bits."""
        level = np.zeros(len(code))
        for plane in reversed(self.planes):
            level *= 2
            for w in range(len(plane)):
                level += np.bitwise_count(code[:, w] & plane[w])
        return self.low * (2 * ones - self.width) + self.step * (2 * level - self.total)


class Codes:
    """The stored codes of a shard."""

    def __init__(self, x: np.ndarray, words: np.ndarray, align: np.ndarray, rest: np.ndarray):
        self.x = x
        self.align, self.rest = ([np.ascontiguousarray(c) for c in a.T] for a in (align, rest))
        self.words = [np.ascontiguousarray(words[:, j]) for j in range(words.shape[1])]
        self.ones = [np.bitwise_count(w).sum(axis=1).astype(np.int64) for w in self.words]
        self.length = np.sqrt((x * x).sum(axis=1))
        self.compared = self.scored = 0

    def survivors(self, q: np.ndarray, live: np.ndarray, keep, planes: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the ``live`` members that ``keep(lower, upper)`` leaves after every code, and their exact scores."""
        self.compared += len(live)
        estimate, error, turned, far = np.zeros(len(live)), np.zeros(len(live)), q[None], float(np.sqrt(q @ q))
        for j, words in enumerate(self.words):
            if not len(live):
                break
            turned = rotated(turned, j)
            anchor, align, rest = Planes(turned[0], planes), self.align[j][live], self.rest[j][live]
            estimate += align * anchor.product(words[live], self.ones[j][live])
            error += align * (anchor.left * np.sqrt(anchor.width))  # the code's length times what the planes leave out
            width = error + rest * far + 1e-9 * (1 + self.length[live] * far)
            stay = keep(estimate - width, estimate + width)
            live, estimate, error = live[stay], estimate[stay], error[stay]
        self.scored += len(live)
        if self.length[live].max(initial=0) * far < 2.0**52:
            return live, (self.x[live] @ q).astype(np.int64)
        return live, self.x[live].astype(np.int64) @ q.astype(np.int64)


def highest(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def first(score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` highest scores, ties to the smaller vec_id."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((row[near], vec_id[near], -score[near]))[:k]]
    return np.lexsort((row, vec_id, -score))[:k]


def best(k: int):
    """Keeps the pairs that may be among the ``k`` highest."""
    return lambda lower, upper: upper >= highest(lower, k)


def within(bands: list[tuple[int, int]], k: int):
    """Keeps the pairs that may be among the ``k`` highest of a band of scores, for any of the bands."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lower), bool)
        for low, high in bands:
            floor = max(low, highest(lower[(lower >= low) & (upper <= high)], k))
            out |= (lower <= high) & (upper >= floor)
        return out

    return keep


def band(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole numbers n with ``low * score <= 100 * n <= high * score``."""
    return -(-low * score // 100), high * score // 100


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true places of a matrix, eight at a time."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.divmod(np.flatnonzero(flat), mask.shape[1])
    near = (8 * np.flatnonzero(flat.view(np.uint64))[:, None] + np.arange(8)).reshape(-1)
    return np.divmod(near[flat[near]], mask.shape[1])


class Chains:
    """A shard whose chains are summed up, those with the longest rests first: they are the longest vectors too."""

    def __init__(self, x: np.ndarray, words: np.ndarray, align: np.ndarray, rest: np.ndarray, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray):
        order = np.argsort(-rest[:, -1], kind="stable")
        self.x, self.row, self.vec_id, self.label, self.rest = x[order], row[order], vec_id[order], label[order], rest[order, -1]
        whole = summed(words[order], align[order])
        self.codes, self.length = words.shape[1], np.sqrt((x * x).sum(axis=1)).max(initial=0.0)
        self.size, self.kind = self.length + self.rest.max(initial=0.0), np.float32 if self.length < 2.0**60 else np.float64
        self.whole = whole.astype(self.kind)

    def scores(self, q: np.ndarray, a: np.ndarray, m: np.ndarray, far: float) -> np.ndarray:
        """Inner products of anchors and members, pair by pair, in whole numbers."""
        most = self.length * max(far, 1.0)
        kind = np.float32 if most < 2.0**23 else np.float64 if most < 2.0**52 else np.int64  # exact in it, members and sums
        if self.x.dtype != kind:
            self.x = self.x.astype(kind)
        q, out, step = q.astype(kind, copy=False), np.empty(len(a), np.int64), max(1, ENCODED_VALUES // q.shape[1] // 8)
        for k in range(0, len(a), step):
            out[k : k + step] = np.einsum("ij,ij->i", q.take(a[k : k + step], axis=0), self.x.take(m[k : k + step], axis=0))
        return out

    def search(self, q: np.ndarray, fits, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, band, member and score of the ``k`` highest scores of each anchor in each of its bands.

        ``low`` and ``high`` have a row an anchor and a column a band; a band whose low is above its high is none.
        ``fits(a, m)`` says which anchors and members may meet.
        """
        far = np.sqrt((q * q).sum(axis=1))
        ask = q
        for j in range(self.codes):
            ask = rotated(ask, j)
        ask = ask.astype(self.kind)
        none = low > high
        floor, top = np.where(none, np.iinfo(np.int64).max, low), np.where(none, np.iinfo(np.int64).min, high).max(axis=1)
        rounds = (ask.shape[1] + 16) * float(np.finfo(self.kind).eps) * self.size + 1e-9 * self.length
        a, m, score = (np.zeros(0, np.int64) for _ in range(3))
        rank = np.zeros((0, low.shape[1]), np.int64)
        room, high_enough = np.empty(len(q) * SLICE, self.kind), np.empty(len(q) * SLICE, bool)
        s = end = 0
        while end < len(self.x):
            s, end = end, end + min(max(end, FIRST), SLICE)  # small slices first: what they hold narrows the later ones
            part = self.whole[s:end]
            estimate, mask = (v[: len(q) * len(part)].reshape(len(q), -1) for v in (room, high_enough))
            np.matmul(ask, part.T, out=estimate)
            width = far * (self.rest[s] + rounds) + 1e-9
            if not s:  # k members surely between a number and the lowest top of a band: no band needs less than that number
                may = fits(np.arange(len(q))[:, None], np.arange(estimate.shape[1])[None])
                least = np.nextafter((np.where(none, np.iinfo(np.int64).max, high).min(axis=1) - width).astype(self.kind), self.kind(-np.inf))
                may &= np.less_equal(estimate, least[:, None], out=mask)
                sure = np.where(may, estimate, self.kind(-np.inf))
                sure = np.pad(sure, ((0, 0), (0, -len(part) % 64)), constant_values=-np.inf) if len(part) % 64 else sure
                most = sure.reshape(len(q), 64, -1).max(axis=2)
                if k <= 64:
                    bound = np.partition(most, 64 - k, axis=1)[:, 64 - k].astype(np.float64) - width
                    floor = np.maximum(floor, np.where(np.isfinite(bound), np.floor(np.maximum(bound, -(2.0**62))), -(2.0**63)).astype(np.int64)[:, None])
            asked = np.nextafter((floor.min(axis=1) - width).astype(self.kind), self.kind(-np.inf))
            new_a, new_m = places(np.greater_equal(estimate, asked[:, None], out=mask))
            near = (estimate[new_a, new_m] <= (top + width)[new_a]) & fits(new_a, s + new_m)
            new_a, new_m = new_a[near], s + new_m[near]
            found = self.scores(q, new_a, new_m, far.max(initial=0.0))
            inside = ((found[:, None] >= floor[new_a]) & (found[:, None] <= high[new_a])).any(axis=1)
            if not inside.any():
                continue
            a, m, score = np.append(a, new_a[inside]), np.append(m, new_m[inside]), np.append(score, found[inside])
            order = np.lexsort((self.row[m], self.vec_id[m], -score, a))
            a, m, score = a[order], m[order], score[order]
            mine = (score[:, None] >= low[a]) & (score[:, None] <= high[a])
            count = np.cumsum(mine, axis=0)
            begin = np.searchsorted(a, a)
            rank = np.where(mine, count - (count[begin] - mine[begin]), 0)  # from 1; 0: not in this band
            last, band_of = np.nonzero(rank == k)
            floor[a[last], band_of] = np.maximum(floor[a[last], band_of], score[last])
            stay = ((rank > 0) & (rank <= k)).any(axis=1)
            a, m, score, rank = a[stay], m[stay], score[stay], rank[stay]
        at, band_of = np.nonzero((rank > 0) & (rank <= k))
        return a[at], band_of, m[at], score[at]


def in_bytes(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as their bytes."""
    values = np.ascontiguousarray(values)
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.reshape(-1))])


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the shortest type that holds them all."""
    most = np.abs(x).max(initial=0)
    return x.astype(next((k for k in (np.int8, np.int16, np.int32) if most <= np.iinfo(k).max), np.float64))


def flat_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row ends, from the first one's start."""
    column = column.cast(pa.large_binary()).combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def in_eights(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of equally many components of eight bytes."""
    return flat_bytes(column)[0].view(kind).reshape(len(column), -1)


def components(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows that ``narrow`` may have stored in different types."""
    data, ends = flat_bytes(column)
    size, out = np.diff(ends) // dim, np.empty((len(column), dim))
    for kind in (np.int8, np.int16, np.int32, np.float64):
        n = np.dtype(kind).itemsize
        mine = np.flatnonzero(size == n)
        if len(mine) == len(out):
            return data.view(kind).reshape(-1, dim).astype(np.float64)
        if len(mine):
            out[mine] = data[ends[mine][:, None] + np.arange(n * dim)].view(kind)
    return out


def _encoded(codes: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("e"))
            dims = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            usable = (dims > 0) & (bad[ends] == bad[ends - dims])
            for dim in np.unique(dims[usable]).tolist():
                mine = np.flatnonzero(usable & (dims == dim))
                rows = max(1, ENCODED_VALUES // max(64, dim))
                for k in range(0, len(mine), rows):
                    some = mine[k : k + rows]
                    x = np.clip(np.floor(values[(ends - dims)[some][:, None] + np.arange(dim)] * scale), -(2.0**63), 2.0**63) + 0.0
                    words, align, rest = encode(x, codes)
                    new = {"dim": pa.array(np.full(len(x), dim), pa.int32()), "x": in_bytes(narrow(x)), "code": in_bytes(words.reshape(len(x), -1)), "align": in_bytes(align), "rest": in_bytes(rest)}
                    kept = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_pydict({c: new[c] if c in new else kept.column(kept.schema.get_field_index(c)) for c in (f.split()[0] for f in STORED.split(", "))})

    return run


def _met(mode: str, k: int, planes: int, low: int, high: int):
    """A block of anchors against a shard: each anchor's highest scores, or those in the bands of its positives."""

    def run(group: pa.Table) -> pa.Table:
        member = group.column("side").to_numpy() == 0
        if member.all() or not member.any():
            return hits(*[()] * 8)
        stored = group.filter(pa.array(member)).sort_by("row")
        asked = group.filter(pa.array(~member))
        dim = asked.column("dim")[0].as_py()
        row, vec_id, label = (stored.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        align, rest, words = (in_eights(stored.column(c), t) for c, t in (("align", np.float64), ("rest", np.float64), ("code", np.uint64)))
        words = words.reshape(len(row), align.shape[1], -1)
        x, q = components(stored.column("x"), dim), components(asked.column("x"), dim)
        if len(q) < FEW:
            return one_by_one(Codes(x, words, align, rest), row, vec_id, label, q, asked)
        return together(Chains(x, words, align, rest, row, vec_id, label), q, asked)

    def one_by_one(shard: Codes, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for q, own, own_id, own_label, wants in zip(x, *(asked.column(c).to_pylist() for c in ("row", "vec_id", "label", "wants"))):
            if mode == "positives":
                live, score = shard.survivors(q, np.flatnonzero((label == own_label) & (row != own)), best(k), planes)
                top = first(score, vec_id[live], row[live], k)
                out += [(own, own_id, None, None, None, *r) for r in zip(row[live][top].tolist(), vec_id[live][top].tolist(), score[top].tolist())]
                continue
            bands = [(w, *band(w["score"], low, high)) for w in wants]
            bands = [b for b in bands if b[1] <= b[2]]
            if not bands:
                continue
            live, score = shard.survivors(q, np.flatnonzero(label != own_label), within([b[1:] for b in bands], k), planes)
            for w, a, b in bands:
                mine = np.flatnonzero((score >= a) & (score <= b))
                mine = mine[first(score[mine], vec_id[live][mine], row[live][mine], k)]
                out += [(own, own_id, w["row"], w["vec_id"], w["score"], *r) for r in zip(row[live][mine].tolist(), vec_id[live][mine].tolist(), score[mine].tolist())]
        return hits(*(list(zip(*out)) or [()] * 8))

    def together(shard: Chains, x: np.ndarray, asked: pa.Table) -> pa.Table:
        own, own_id, own_label = (asked.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        asks = asked.column("wants").combine_chunks()
        asks = asks if isinstance(asks, pa.Array) else asks.chunk(0)
        count = pc.list_value_length(asks).to_numpy().astype(np.int64)
        start, wanted = np.cumsum(count) - count, [asks.flatten().field(c).to_numpy() for c in ("row", "vec_id", "score")]
        bands = np.array([band(s, low, high) for s in wanted[2].tolist()], np.int64).reshape(-1, 2)
        edge, out = np.iinfo(np.int64), []
        for g in range(0, len(x), GROUP):
            one, ids = own[g : g + GROUP], own_id[g : g + GROUP]
            if mode == "positives":
                lows, highs = np.full((len(one), 1), edge.min), np.full((len(one), 1), edge.max)
                fits = lambda a, m, of=own_label[g : g + GROUP], one=one: (shard.label[m] == of[a]) & (shard.row[m] != one[a])
            else:
                place = np.arange(count[g : g + GROUP].max())[None]
                there, place = place < count[g : g + GROUP, None], place + start[g : g + GROUP, None]
                lows, highs = np.ones(there.shape, np.int64), np.zeros(there.shape, np.int64)
                lows[there], highs[there] = bands[place[there]].T
                fits = lambda a, m, of=own_label[g : g + GROUP]: shard.label[m] != of[a]
            a, b, m, score = shard.search(x[g : g + GROUP], fits, lows, highs, k)
            for_what = [w[place[a, b]] for w in wanted] if mode == "negatives" else [[None] * len(a)] * 3
            out.append(hits(one[a], ids[a], *for_what, shard.row[m], shard.vec_id[m], score))
        return pa.concat_tables(out)

    def hits(*columns) -> pa.Table:
        return pa.table({c.split()[0]: pa.array(v if isinstance(v, np.ndarray) else list(v), pa.int64()) for c, v in zip(HIT.split(", "), columns)})

    return run


def _tasks(members: DataFrame, anchors: DataFrame, by: list[str], shard_values: int, anchors_a_task: int) -> DataFrame:
    """Every anchor with every shard of its group; large groups have several shards and blocks."""
    rows = F.greatest(F.lit(256), F.floor(F.lit(shard_values) / F.greatest(F.lit(64), F.max("dim"))))
    shards = members.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("shards"))
    blocks = anchors.groupBy(*by).agg(F.ceil(F.count("*") / F.least(F.lit(anchors_a_task), rows)).cast("int").alias("blocks"))
    large = shards.join(blocks, by, "left").fillna(0, ["blocks"]).where("shards > 1 or blocks > 1")
    # few rows: each stands for more than a shard or a block; other groups have one of each
    known = lambda t: t.join(F.broadcast(large), by, "left").fillna(1, ["shards", "blocks"]).where("blocks > 0")
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns, no_code = ["vec_id", "label", "dim", "x", "row"], [F.lit(None).cast("binary").alias(c) for c in ("code", "align", "rest")]
    left = known(members).select(*columns, "code", "align", "rest", F.array().cast(WANTED).alias("wants"), F.lit(0).alias("side"), own("shards").alias("shard"), upto("blocks").alias("block"))
    mine = known(anchors).select(*columns, *no_code, "wants", F.lit(1).alias("side"), upto("shards").alias("shard"), own("blocks").alias("block"))
    return left.unionByName(mine).groupBy(*by, "shard", "block")


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, codes: int = CODES, planes: int = PLANES, shard_values: int = SHARD_VALUES, anchors_a_task: int = ANCHORS_A_TASK) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, embedding and label; other columns are ignored. Anchors are rows whose vec_id is divisible by
    ``every``. An anchor's positives are the ``positives`` other rows of its label with the highest scores, ties to the
    smaller vec_id; its negatives for a positive are the first ``negatives`` rows of other labels, in the same order, whose
    score is ``low`` to ``high`` percent of the positive's. A score is the inner product of the components
    floor(scale * x), exact while squared lengths stay below 2**62.

    Rows with a null label, a null or empty vector, or a null or non-finite component take no part; vectors of different
    length do not meet. Repeated rows count one by one, as anchors too. A null vec_id is no anchor, comes last among ties
    and is returned as null. Anchors without positives, and positives without a score in their band, give no rows.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    table = good.where("label is not null and e is not null").select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "label", "e", F.monotonically_increasing_id().alias("row"))
    stored = cut_lineage(table.mapInArrow(_encoded(codes, scale), STORED))  # from here on, rows keep their numbers
    anchors = stored.where((F.col("vec_id") % every == 0) & (F.col("vec_id") < NO_ID)).select("vec_id", "label", "dim", "x", "row")
    order = [F.desc("score"), "vec_id", "row"]
    asked = anchors.withColumn("wants", F.array().cast(WANTED))
    near = _tasks(stored, asked, ["dim", "label"], shard_values, anchors_a_task).applyInArrow(_met("positives", positives, planes, low, high), HIT)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("rank") <= positives)
    wants = cut_lineage(top.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("row", "vec_id", "score")).alias("wants")))
    hits = _tasks(stored, anchors.join(wants, "row"), ["dim"], shard_values, anchors_a_task).applyInArrow(_met("negatives", negatives, planes, low, high), HIT)
    place = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    found = hits.withColumn("rank", place).where(F.col("rank") <= negatives)
    return found.select("anchor_id", known(F.col("positive_id")).alias("positive_id"), "rank", known(F.col("vec_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
