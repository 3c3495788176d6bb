"""Helpers of the corpus operators: byte-level text kernels for workers and small frame utilities.

Worker code sees the texts of an Arrow batch as one byte array and handles it a slice at a time, so its memory follows
the slice and the longest single text, never the batch or the partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # worker code travels with the job

SLICE_BYTES = 1 << 20
ROLL = 0x9E3779B97F4A7C15
ROLL_2 = 0xC2B2AE3D27D4EB4F
NO_ID = (1 << 63) - 1  # stands for a null id where ids are ordered: after all others


def worker_memory() -> dict:
    """What a Python worker keeps between tasks (tables, vocabularies)."""
    return sys.__dict__.setdefault("_brierworks_llm", {})


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(ROLL))


def byte_values(lower: bool) -> np.ndarray | None:
    """What each byte counts as in a span hash: itself, or with ``lower`` A-Z as a-z."""
    if not lower:
        return None
    values = np.arange(256, dtype=np.uint8)
    values[65:91] = values[97:123]
    return values


def powers(n: int, base: int = ROLL) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of them."""
    kept = worker_memory()
    if base not in kept or len(kept[base][0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        kept[base] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
    return kept[base]


def prefix_sums(values: np.ndarray, base: int = ROLL) -> np.ndarray:
    """Running sums of ``values[i] * base**i``, from which every span's rolling hash follows."""
    up, _ = powers(len(values) + 1, base)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def rolling(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = ROLL) -> np.ndarray:
    """Rabin-Karp hash of each span [begin, end), whatever its place."""
    _, down = powers(len(sums), base)
    return (sums[end] - sums[begin]) * down[begin]


SHORT = 64
TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray | None) -> np.ndarray:
    """A 64-bit hash of each byte span: short ones eight bytes at a time, each step a full mix, others by XXH64."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data if values is None else values[data]
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - begin
    h = mix(size.astype(np.uint64) * np.uint64(ROLL_2) + np.uint64(ROLL))
    live = np.flatnonzero(size <= SHORT)
    for k in range(0, SHORT, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = mix(h[live] * np.uint64(ROLL) ^ eight[begin[live] + k] & TAILS[np.minimum(size[live] - k, 8)])
    for k in np.flatnonzero(size > SHORT).tolist():
        h[k] = xxhash.xxh64_intdigest(padded[begin[k] : end[k]], seed=7)
    return h


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether the spans of ``size`` bytes that begin at ``a`` and ``b`` are equal, all of them."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero((size <= SHORT) & (a != b))
    for k in range(0, SHORT, 8):
        live = live[size[live] > k]
        if ((eight[a[live] + k] ^ eight[b[live] + k]) & TAILS[np.minimum(size[live] - k, 8)]).any():
            return False
    return all(np.array_equal(data[a[k] : a[k] + size[k]], data[b[k] : b[k] + size[k]]) for k in np.flatnonzero((size > SHORT) & (a != b)).tolist())


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of a word: all but blank, tab, line and page breaks.
WORD = ~byte_table((9, 13), (32, 32))


def spans(data: np.ndarray, starts: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of ``inside`` bytes that stays in one text, and each text's first run."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) + 1, np.int64)
    word = inside[data]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~word[:-1]
    fresh[starts] = True
    begin = np.flatnonzero(word & fresh[:n])
    over = np.ones(n + 1, bool)
    over[:n] = ~word
    over[starts] = True
    end = np.flatnonzero(word & over[1:]) + 1
    return begin, end, np.searchsorted(begin, np.append(starts, n))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows [i, j) of a batch with their UTF-8 bytes and each text's start and end; a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def table_of(batch: pa.RecordBatch, i: int, j: int, names: list[str], **more) -> pa.RecordBatch:
    """Rows [i, j) of the named columns with new ones."""
    cut = batch.slice(i, j - i)
    columns = {name: cut.column(cut.schema.get_field_index(name)) for name in names}
    columns |= {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in more.items()}
    return pa.RecordBatch.from_pydict(columns)


def ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The id as bigint and the text, whatever else the table has."""
    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def order_id(key: str = "doc_id") -> Column:
    """An id that sorts and joins as others do: null stands last."""
    return F.coalesce(F.col(key), F.lit(NO_ID))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod4(key: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 4; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4


def held_out(key: str = "doc_id") -> Column:
    return crc_mod4(key) == 2


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store; nothing happens where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
