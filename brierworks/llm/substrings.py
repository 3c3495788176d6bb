"""Exact substring deduplication over fixed-length token windows.

A window is ``window`` consecutive words. Every window gets a Rabin-Karp hash (96 bits) and every window that may repeat
is counted in Spark; windows whose sequence also starts earlier are merged into maximal removal intervals.

Most windows are unique, and shuffling a hash for each of them would move several times the input. So there are two
rounds of the same exchange:

1. each window is represented by the smallest Rabin-Karp hash among its half-length sub-windows. Equal windows have equal
   representatives, and only about one word in six starts one. Representatives that occur at one place only prove the
   windows around them unique;
2. for the remaining windows, the full hash with its place. The smallest place of a hash is its first occurrence; all
   others are repeats.

A task combines its own rows before the exchange: of each value, it sends one entry and settles its other rows itself,
so a passage that a third of all documents share costs one entry per flush and value. Entries travel packed, a row for
each flush and bucket.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from brierworks.llm.common import NO_ID, ROLL, ROLL_2, byte_values, mix, partitions, prefix_sums, rolling, span_hashes, spans, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FLUSH = 1 << 20
BUCKETS = 256  # at least; more where the session has more shuffle partitions
BUCKET_TEXT = 32 << 20  # bytes of text whose windows a bucket takes on average; a task holds one bucket at a time
TOP = np.uint64((1 << 64) - 1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; signed integers, which rise slowly, are stored as compressed differences."""
    out = []
    for a in arrays:
        if a.dtype in (np.uint64, np.uint32):
            body, kind = a.tobytes(), 0 if a.dtype == np.uint64 else 3
        else:
            body, kind = zlib.compress(np.diff(a, prepend=a.dtype.type(0)).tobytes(), 1), 1 if a.dtype == np.int64 else 2
        out.append(struct.pack("<BI", kind, len(body)) + body)
    return b"".join(out)


def unpacked(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        kind, size = struct.unpack_from("<BI", body, at)
        part = body[at + 5 : at + 5 + size]
        at += 5 + size
        out.append(np.frombuffer(part, np.uint64 if kind == 0 else np.uint32) if kind in (0, 3) else np.cumsum(np.frombuffer(zlib.decompress(part), np.int64 if kind == 1 else np.int32)).astype(np.int64))
    return out


def _sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbours; as many results as whole ranges."""
    best = np.minimum if least else np.maximum
    step, reach = 1, a
    while step * 2 <= width:
        reach = best(reach[:-step], reach[step:])
        step *= 2
    rest = width - step
    return best(reach[: len(reach) - rest], reach[rest:]) if rest else reach


class Windows:
    """Words of a slice of texts with the hashes of their windows."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, window: int, values: np.ndarray):
        self.begin, self.end, self.first = spans(data, starts)
        n, part = len(self.begin), (window + 1) // 2
        self.words = span_hashes(data, self.begin, self.end, values)
        self.doc = np.repeat(np.arange(len(starts)), np.diff(self.first))
        self.count = max(0, n - window + 1)
        at = np.arange(self.count)
        self.valid = self.doc[at] == self.doc[at + window - 1] if self.count else np.zeros(0, bool)
        self.reach = window - part + 1
        if self.count:
            sums = prefix_sums(self.words)
            i = np.arange(n - part + 1)
            self.parts = mix(rolling(sums, i, i + part))
            self.least = _sliding(self.parts, self.reach, True)
        else:
            self.parts = self.least = np.zeros(0, np.uint64)

    def representatives(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each sub-window that represents some window."""
        if not self.valid.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pad = np.zeros(self.reach - 1, np.uint64)
        most = _sliding(np.concatenate([pad, np.where(self.valid, self.least, np.uint64(0)), pad]), self.reach, False)
        p = np.flatnonzero((most == self.parts) & (self.parts > 0))
        return self.doc[p], self.parts[p]

    def hashes(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        one = rolling(prefix_sums(self.words), at, at + window)
        two = rolling(prefix_sums(mix(self.words + np.uint64(ROLL)), ROLL_2), at, at + window, ROLL_2)
        return mix(one), (mix(two) >> np.uint64(32)).astype(np.uint32)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def _rows(bucket: list, body: list, k: list, ver: list, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "body": pa.array(body, pa.binary()), "k": pa.array(k, pa.int64()), "ver": pa.array(ver, pa.int64()), "found": pa.array(found, pa.binary())})


EXCHANGE = "bucket int, body binary, k bigint, ver bigint, found binary"
REPLY = "k bigint, ver bigint, found binary"


def _answers(buckets: int, k: np.ndarray, ver: np.ndarray, values: np.ndarray) -> tuple[list, ...]:
    """Values found for each document, as rows that pass through the exchange."""
    order = np.lexsort((values, ver, k))
    k, ver, values = k[order], ver[order], values[order]
    heads = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (ver[1:] != ver[:-1]))) if len(k) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(k))
    return (k[heads] % buckets).tolist(), [None] * len(heads), k[heads].tolist(), ver[heads].tolist(), [values[a:b].tobytes() for a, b in zip(heads, tails)]


def _texts(batches: Iterator[pa.RecordBatch], window: int):
    """Slices of the texts with their keys."""
    values = byte_values(False)
    for batch in batches:
        k, ver = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k", "ver"))
        doc = batch.column(batch.schema.get_field_index("doc"))
        flat = pa.RecordBatch.from_pydict({"text": pc.struct_field(doc, "text").cast(pa.large_string()), "id": pc.fill_null(pc.struct_field(doc, "doc_id").cast(pa.int64()), NO_ID)})
        order = flat.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, starts, _ in text_slices(flat):
            yield batch, i, j, k[i:j], ver[i:j], order[i:j], data, Windows(data, starts, window, values)


def _send_representatives(window: int, buckets: int):
    def flush(keys, hashes) -> pa.RecordBatch:
        k, h = np.concatenate(keys), np.concatenate(hashes)
        order = np.lexsort((k, h))
        k, h = k[order], h[order]
        heads = _groups(h)
        size = np.diff(np.append(heads, len(h)))
        many = np.repeat(size > 1, size)
        twice = np.append(False, (k[1:] == k[:-1]) & (h[1:] == h[:-1]))
        known = many & ~twice
        bucket, body, rk, rv, found = _answers(buckets, k[known], np.zeros(int(known.sum()), np.int64), h[known])
        single, shared = heads[size == 1], heads[size > 1]
        b1, b2 = _bucket(h[single], buckets), _bucket(h[shared], buckets)
        order = np.lexsort((k[single], b1))
        single, b1 = single[order], b1[order]
        for b in np.unique(np.append(b1, b2)):
            mine = single[np.searchsorted(b1, b) : np.searchsorted(b1, b, "right")]
            bucket.append(int(b))
            body.append(packed(h[mine], k[mine], h[shared[np.searchsorted(b2, b) : np.searchsorted(b2, b, "right")]]))
            rk.append(None), rv.append(None), found.append(None)
        return _rows(bucket, body, rk, rv, found)

    def run(batches):
        keys, hashes, held = [], [], 0
        for _, _, _, k, _, _, _, w in _texts(batches, window):
            doc, h = w.representatives()
            keys.append(k[doc]), hashes.append(h)
            held += len(h)
            if held >= FLUSH:
                yield flush(keys, hashes)
                keys, hashes, held = [], [], 0
        if held:
            yield flush(keys, hashes)

    return run


def _split(group: pa.Table) -> tuple[list[list[np.ndarray]], pa.Table]:
    """Packed entries of a bucket, and the rows that only pass through."""
    body = group.column("body")
    passing = group.filter(pc.is_null(body)).select(["k", "ver", "found"])
    return [unpacked(b) for b in body.drop_null().to_pylist()], passing


def _reply(passing: pa.Table, k, ver, values) -> pa.Table:
    _, _, k, ver, found = _answers(1, k, ver, values)
    fresh = pa.table({"k": pa.array(k, pa.int64()), "ver": pa.array(ver, pa.int64()), "found": pa.array(found, pa.binary())})
    return pa.concat_tables([passing.cast(fresh.schema), fresh])


def _repeated_representatives(group: pa.Table) -> pa.Table:
    entries, passing = _split(group)
    h = np.concatenate([e[0] for e in entries] or [np.zeros(0, np.uint64)])
    k = np.concatenate([e[1] for e in entries] or [np.zeros(0, np.int64)])
    shared = np.unique(np.concatenate([e[2] for e in entries] or [np.zeros(0, np.uint64)]))
    order = np.argsort(h, kind="stable")
    h, k = h[order], k[order]
    heads = _groups(h)
    size = np.diff(np.append(heads, len(h)))
    again = np.repeat((size > 1) | np.isin(h[heads], shared), size) if len(h) else np.zeros(0, bool)
    return _reply(passing, k[again], np.zeros(int(again.sum()), np.int64), h[again])


def _send_windows(window: int, buckets: int):
    def flush(parts) -> pa.RecordBatch:
        k, ver, order_, at, one, two = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, order_, two, one))
        k, ver, order_, at, one, two = (x[order] for x in (k, ver, order_, at, one, two))
        heads = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        lead = np.repeat(heads, np.diff(np.append(heads, len(one))))
        later = (order_ != order_[lead]) | (at != at[lead])
        bucket, body, rk, rv, found = _answers(buckets, k[later], ver[later], at[later].astype("<i4"))
        keep = np.flatnonzero(~later)
        b = _bucket(one[keep], buckets)
        order = np.lexsort((at[keep], ver[keep], order_[keep], b))
        keep, b = keep[order], b[order]
        edges = np.append(_groups(b), len(b))
        for s, e in zip(edges[:-1], edges[1:]):
            x = keep[s:e]
            new = np.append(True, (order_[x][1:] != order_[x][:-1]) | (ver[x][1:] != ver[x][:-1]))
            own = np.flatnonzero(new)
            bucket.append(int(b[s]))
            body.append(packed(one[x], two[x], order_[x][own], ver[x][own].view(np.uint64), own.astype(np.int32), at[x].astype(np.int32)))
            rk.append(None), rv.append(None), found.append(None)
        return _rows(bucket, body, rk, rv, found)

    def run(batches):
        parts, held = [], 0
        for batch, i, j, k, ver, order_, _, w in _texts(batches, window):
            lists = batch.column(batch.schema.get_field_index("found")).slice(i, j - i).to_pylist()
            picked = []
            for d, found in enumerate(lists):
                a, b = int(w.first[d]), int(w.first[d + 1]) - window + 1
                if found and b > a:
                    again = np.unique(np.frombuffer(b"".join(found), np.uint64))
                    near = np.searchsorted(again, w.least[a:b]).clip(max=len(again) - 1)
                    picked.append(a + np.flatnonzero(again[near] == w.least[a:b]))
            at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
            if not len(at):
                continue
            doc = w.doc[at]
            parts.append((k[doc], ver[doc], order_[doc], at - w.first[doc], *w.hashes(at, window)))
            held += len(at)
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _later_windows(group: pa.Table) -> pa.Table:
    entries, passing = _split(group)
    if not entries:
        return _reply(passing, *(np.zeros(0, t) for t in ("i8", "i8", "<i4")))
    one, two, at = (np.concatenate([e[i] for e in entries]) for i in (0, 1, 5))
    sizes = [np.diff(np.append(e[4], len(e[0]))) for e in entries]
    order_ = np.concatenate([np.repeat(e[2], s) for e, s in zip(entries, sizes)])
    ver = np.concatenate([np.repeat(e[3].view(np.int64), s) for e, s in zip(entries, sizes)])
    order = np.lexsort((at, order_, two, one))
    one, two, at, order_, ver = (x[order] for x in (one, two, at, order_, ver))
    heads = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    lead = np.repeat(heads, np.diff(np.append(heads, len(one))))
    later = (order_ != order_[lead]) | (at != at[lead])
    order_, ver, at = order_[later], ver[later], at[later]
    return _reply(passing, np.where(order_ == NO_ID, ver, order_), ver, at.astype("<i4"))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(batch.schema.get_field_index("doc"))
            vers = batch.column(batch.schema.get_field_index("ver")).to_pylist()
            lists = batch.column(batch.schema.get_field_index("found"))
            flat = pa.RecordBatch.from_pydict({"text": pc.struct_field(doc, "text").cast(pa.large_string())})
            for i, j, data, starts, ends in text_slices(flat):
                raw = data.tobytes()
                n_words, n_removed, kept, intervals = [], [], [], []
                for s, e, ver, found in zip(starts.tolist(), ends.tolist(), vers[i:j], lists.slice(i, j - i).to_pylist()):
                    words = raw[s:e].split()
                    n, gone = len(words), []
                    spots = [x["found"] for x in found or () if x["ver"] == ver]
                    if spots:
                        at = np.unique(np.frombuffer(b"".join(spots), "<i4")).astype(np.int64)
                        fresh = np.append(True, at[1:] > at[:-1] + window)
                        first = at[fresh]
                        last = np.append(at[np.flatnonzero(fresh)[1:] - 1], at[-1]) + window
                        gone = list(zip(first.tolist(), last.tolist()))
                        step = np.zeros(n + 1, np.int64)
                        step[first] += 1
                        step[last] -= 1
                        words = list(compress(words, (np.cumsum(step[:n]) == 0).tolist()))
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    kept.append(b" ".join(words).decode())
                    intervals.append([{"first": a, "last": b - 1} for a, b in gone])
                spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                yield pa.RecordBatch.from_pydict({"doc": doc.slice(i, j - i), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()), "intervals": pa.array(intervals, spans_type)})

    return run


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """For each row its columns as the struct ``doc``, n_words, n_removed, ``kept`` (the words left, joined by one blank)
    and ``intervals`` (first and last word of each maximal run of removed words).

    A word goes if a window over it repeats one that starts earlier: in a smaller doc_id, or earlier in the same
    document. Texts that are null, empty or shorter than a window lose nothing; null gives no words. Rows of one id
    count as one document, so a repeated row keeps what its twin keeps; all null ids count as one document after all
    others. Columns of any name may come along.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, 4 * partitions(docs), -(-size // BUCKET_TEXT))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("doc")).withColumn("ver", F.xxhash64(F.col("doc.doc_id").cast("long"), F.col("doc.text")))
    keyed = keyed.withColumn("k", F.coalesce(F.col("doc.doc_id").cast("long"), "ver")).select("k", "ver", "doc")
    slim = keyed.select("k", "ver", F.struct("doc.doc_id", "doc.text").alias("doc"))
    sent = slim.mapInArrow(_send_representatives(window, buckets), EXCHANGE)
    again = sent.groupBy("bucket").applyInArrow(_repeated_representatives, REPLY).groupBy("k").agg(F.collect_list("found").alias("found"))
    dealt = keyed.repartition("k")
    places = dealt.join(again, "k").mapInArrow(_send_windows(window, buckets), EXCHANGE)
    later = places.groupBy("bucket").applyInArrow(_later_windows, REPLY).groupBy("k").agg(F.collect_list(F.struct("ver", "found")).alias("found"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = f"doc struct<{fields}>, n_words bigint, n_removed bigint, kept string, intervals array<struct<first: bigint, last: bigint>>"
    return dealt.join(later, "k", "left").mapInArrow(_cut(window), out)
