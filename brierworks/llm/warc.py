"""WARC archives of captures, and the merged index of what they hold.

Captures are written with Spark's own text sink, as gzip-compressed WARC/1.1 files in which each task's captures are
sorted by URL key and time. Reading parses every record by its Content-Length. The index of all archives is an external
merge: a range partitioning gives each task an interval of keys, in which it merges the sorted runs of all archives with
a loser tree; so captures come out globally ordered.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brierworks.llm.common import NO_ID, partitions, remove_folder
from brierworks.session import cut_lineage, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2000-01-01T00:00:00Z"
SEPARATOR = b"\r\n\r\n"
RANGE_ROWS = 250_000  # index rows that a task merges, some 300 MB as Python values

RECORD = "run string, place bigint, record_id string, record_type string, target_uri string, captured string, payload_digest string, payload_bytes bigint, refers_to string, intact boolean"


def base32(hexadecimal: Column) -> Column:
    """Base32 of 20 bytes given as hexadecimal digits: 10 of those are 8 digits to the base of 32."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def url_key(url: Column) -> Column:
    """Sort key of a URL: reversed host, then path and query, in lower case; null as the empty URL."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """url_key, captured and the text of each page's record."""
    captured = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + F.abs(F.coalesce("page_id", F.lit(0))) % 3_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"sha1": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    base = base.withColumn("digest", base32(F.col("sha1"))).drop("sha1")
    first = base.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(F.coalesce("page_id", F.lit(NO_ID))).alias("first"))
    typed = base.join(first, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("first") != F.coalesce("page_id", F.lit(NO_ID)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return typed.withColumn("captured", captured).select(url_key(F.col("url")).alias("url_key"), "captured", "page_id", F.concat(head, F.lit("\r\n\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """One WARC record per row of ``pages`` (page_id, url, html), in ``folder``.

    Of records whose payloads are equal and at least ``min_bytes`` long, those with the smallest page_id are responses
    and the others revisits that refer to it; a null page_id comes after all others. A null html is an empty payload, a
    null url an empty one. Repeated rows have a record each. A capture's date is derived from its page_id.
    """
    records = _records(pages, min_bytes).sortWithinPartitions("url_key", "captured", F.col("page_id").asc_nulls_last())
    records.select("value").write.option("lineSep", SEPARATOR.decode()).option("compression", "gzip").text(folder)


def _reader(pieces: Iterator[bytes]) -> Callable[[int], bytes]:
    """Reads ``n`` bytes of a file that comes in the pieces between its separators."""
    held = bytearray()

    def read(n: int) -> bytes:
        while len(held) < n and (piece := next(pieces, None)) is not None:
            held.extend(piece)
            held.extend(SEPARATOR)
        out = bytes(held[:n])
        del held[:n]
        return out

    return read


def parse(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive."""
    rest = b""
    while True:
        while (end := rest.find(SEPARATOR)) < 0:
            more = read(1 << 14)
            if not more:
                if rest.strip():
                    raise ValueError("archive ends inside a record header")
                return
            rest += more
        head, rest = rest[:end].decode().split("\r\n"), rest[end + 4 :]
        if not head[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head[1:])}
        size = int(fields["content-length"]) + 4
        if len(rest) < size:
            rest += read(size - len(rest))
        if rest[size - 4 : size] != SEPARATOR:
            raise ValueError("record is cut short")
        yield fields, rest[: size - 4]
        rest = rest[size:]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.bool_()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(names)
        return pa.RecordBatch.from_pydict({n: pa.array(list(c), t) for n, c, t in zip(names, columns, types)})

    pieces = ((p, v.as_py()) for batch in batches for p, v in zip(batch.column("path").to_pylist(), batch.column("value")))
    for path, own_pieces in groupby(pieces, itemgetter(0)):
        found = []
        for place, (f, block) in enumerate(parse(_reader(map(itemgetter(1), own_pieces)))):
            http, _, payload = block.partition(SEPARATOR)
            digest = f["warc-payload-digest"].removeprefix("sha1:")
            size = int(http.rsplit(b": ", 1)[1])
            intact = True
            if f["warc-type"] == "response":
                own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                intact = own == digest and size == len(payload)
                digest, size = own, len(payload)
            found.append((path, place, f["warc-record-id"], f["warc-type"], f.get("warc-target-uri", ""), f["warc-date"], digest, size, f.get("warc-refers-to"), intact))
            if len(found) >= 4096:
                yield rows(found)
                found = []
        yield rows(found)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``: where it is, its header fields, and the payload's digest and
    length, recomputed for responses; ``intact`` tells whether they agree with the header.

    Spark's text reader inflates an archive from its start and hands it over in the pieces between blank lines, in order
    and within one task, as compressed files are not split; so an archive may have any length, and a task holds one
    record and one batch of pieces.
    """
    files = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", SEPARATOR.decode()).text(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")).mapInArrow(_parsed, RECORD)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes on."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.tree = [-1] * self.k
        for run in range(self.k - 1, -1, -1):
            self._play(run)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a``'s next item comes before run ``b``'s; ended runs lose, equal items keep the order of runs."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self._next(a), self._next(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _next(self, run: int):
        return self.runs[run][self.at[run]] if run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            if self._before(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            if run < 0:
                return  # the other side of this match has not come yet
            node //= 2
        self.tree[0] = run

    def __iter__(self):
        while self.runs and (item := self._next(run := self.tree[0])) is not None:
            yield item
            self.at[run] += 1
            self._play(run)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    columns = [table.column(c).to_pylist() for c in ("run", "url_key", "captured", "record_id")]
    runs: dict[str, list] = {}
    for row, (run, key, captured, record) in enumerate(zip(*columns)):
        number = record[10:-1]
        runs.setdefault(run, []).append((key.encode(), captured, int(number) if number else NO_ID, row))
    order = [item[-1] for item in LoserTree(list(runs.values()))]
    yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=4096)


def capture_history(records: DataFrame, rows: int | None = None) -> DataFrame:
    """All captures ordered by URL key, time and id: runs of the archives merged within ranges of the key.

    A run's records arrive in the order in which its archive holds them, which is the order of the merge, so no task
    sorts by key. A task holds the index rows (not the payloads) of its range: about ``RANGE_ROWS`` of the ``rows`` there
    are, which are counted unless given, so ranges get more with the data, not larger.
    """
    rows = records.count() if rows is None else rows
    ranges = max(partitions(records), -(-rows // RANGE_ROWS))
    keyed = records.withColumn("url_key", url_key(F.col("target_uri")))
    dealt = keyed.repartitionByRange(ranges, "url_key", "captured", "record_id").sortWithinPartitions("run", "place")
    return dealt.mapInArrow(_merged, f"{RECORD}, url_key string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The capture history of archives that are written from ``pages``, read back and then removed."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, min_bytes)
    history = cut_lineage(capture_history(cut_lineage(read_archives(spark, folder))))
    remove_folder(spark, folder)
    return history
