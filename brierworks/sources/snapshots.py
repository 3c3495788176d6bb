"""SNK-01 on files with atomic publication: keyed tables whose readers see whole versions only.

A table is a folder ``<partition>=<value>/commit=<token>/`` of Parquet files and a folder ``_versions`` of manifests. A
manifest names the commit of every partition; it is published by one rename that fails if the version is taken. Files
are never changed: a merge writes new commits of the partitions it touches beside the old ones. So a write that stops
half-way is invisible, a reader keeps the version it has resolved, and of two writers that start from one version the
second merges again. What no manifest within a grace period names is removed by :func:`vacuum`.

The file system has to rename atomically (local disks, HDFS). A manifest has one line for each partition, not for each
file or row.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from brierworks.operators.ordering import join_keys, latest_per_key

COMMIT = "commit"
ATTEMPTS = 10


class Taken(Exception):
    """Another writer has published the version first."""


class _Store:
    """The files of a table, reached with Spark's own file system classes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm, self.path = spark, spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, pattern: str) -> list:
        return list(self.fs.globStatus(self.at(pattern)) or [])

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file under a name that must be free; it appears whole or not at all."""
        hidden = f"_versions/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(hidden))
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        option = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            context.rename(self.fs.makeQualified(self.at(hidden)), self.fs.makeQualified(self.at(name)), options)
        except Py4JJavaError as refused:
            self.fs.delete(self.at(hidden), False)
            if "FileAlreadyExists" not in str(refused.java_exception.getClass().getName()):
                raise
            raise Taken(name) from None


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, oldest first."""
    found = _Store(spark, path).names("_versions/*.json")
    return sorted(int(s.getPath().getName().split(".")[0]) for s in found)


def manifest(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    """The commit of each partition folder in a version; nothing in version 0."""
    return json.loads(_Store(spark, path).read(f"_versions/{version:010d}.json")) if version else {}


def current(spark: SparkSession, path: str) -> int:
    return max(versions(spark, path), default=0)


def read(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """A version of the table, the newest by default; no rows where nothing has been published."""
    held = manifest(spark, path, current(spark, path) if version is None else version)
    empty = spark.createDataFrame([], schema)
    if not held:
        return empty
    folders = [f"{path.rstrip('/')}/{folder}/{COMMIT}={token}" for folder, token in sorted(held.items())]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*empty.columns)


def replace_partitions(spark: SparkSession, path: str, rows: DataFrame, partition: str, base: int) -> int:
    """Publish ``rows`` as the whole content of the partitions they fall in, on top of version ``base``.

    Returns the new version. Raises :class:`Taken` if somebody else has published a version since ``base``; the files
    written then are not named by any manifest.
    """
    token = f"{base + 1:010d}-{uuid.uuid4().hex[:12]}"
    writer = rows.withColumn(COMMIT, F.lit(token)).hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition, COMMIT).parquet(path)  # folders of this token only: nothing that exists is replaced
    store = _Store(spark, path)
    written = {s.getPath().getParent().getName(): token for s in store.names(f"{partition}=*/{COMMIT}={token}")}
    store.publish(f"_versions/{base + 1:010d}.json", json.dumps(manifest(spark, path, base) | written, sort_keys=True, indent=0))
    return base + 1


def merge(spark: SparkSession, path: str, src: DataFrame, keys: list[str], partition: str, order: list[str], mode: str = "overwrite") -> int:
    """SNK-01 / SNK-02: merge rows by key and publish the result; returns the version that holds them.

    The newest source row per key wins, unless the stored row is newer by ``order``; with ``coalesce`` it keeps stored
    values where its own are NULL. Rows that change nothing are left out, and a batch that changes nothing publishes no
    version, so batches may arrive late or twice. Only partitions that receive a change are read and written. ``keys``
    hold the partition column or determine it.
    """
    from brierworks.session import cut_lineage
    from brierworks.sources.tables import upsert

    newest = cut_lineage(latest_per_key(src, keys, [F.col(c).desc_nulls_last() for c in order]))
    for _ in range(ATTEMPTS):
        base = current(spark, path)
        merged = newest
        if base:
            old = read(spark, path, newest.schema, base)
            touched = old.join(newest.select(partition).distinct(), partition, "left_semi")
            others = [c for c in newest.columns if c not in keys]
            new = {c: F.coalesce(c, f"_h.{c}") if mode == "coalesce" else F.col(c) for c in others}
            stamp = touched.select(*keys, F.struct(*others).alias("_h"))
            held = F.col("_h").isNull()
            later = F.struct(*order) >= F.struct(*[F.col(f"_h.{c}") if c in others else F.col(c) for c in order])
            same = F.struct(*[new[c].alias(c) for c in others]).eqNullSafe(F.col("_h")) if others else F.lit(True)
            fresh = join_keys(newest, stamp, keys, "left").where(held | (later & ~same))
            fresh = cut_lineage(fresh.select(*newest.columns))
            if fresh.isEmpty():
                return base
            merged = upsert(old.join(fresh.select(partition).distinct(), partition, "left_semi"), fresh, keys, mode).select(*newest.columns)
        elif newest.isEmpty():
            return base
        try:
            return replace_partitions(spark, path, merged, partition, base)
        except Taken:
            continue
    raise RuntimeError(f"{ATTEMPTS} other versions of {path} were published meanwhile")


def vacuum(spark: SparkSession, path: str, grace_seconds: float = 7 * 86_400) -> list[str]:
    """Remove manifests that were replaced longer than the grace period ago, and commits that no remaining manifest names
    and that are older than the grace period (a write that is under way is younger). Returns what was removed."""
    store, edge, gone = _Store(spark, path), (time.time() - grace_seconds) * 1000, []
    listed = sorted(store.names("_versions/*.json"), key=lambda s: s.getPath().getName())
    keep = [s for k, s in enumerate(listed) if k == len(listed) - 1 or listed[k + 1].getModificationTime() > edge]
    named = {f"{folder}/{COMMIT}={token}" for s in keep for folder, token in json.loads(store.read(f"_versions/{s.getPath().getName()}")).items()}
    kept = {s.getPath().getName() for s in keep}
    for s in listed:
        if s.getPath().getName() not in kept:
            gone.append(f"_versions/{s.getPath().getName()}")
    for s in store.names(f"*=*/{COMMIT}=*"):
        name = f"{s.getPath().getParent().getName()}/{s.getPath().getName()}"
        if name not in named and s.getModificationTime() <= edge:
            gone.append(name)
    for name in gone:
        store.fs.delete(store.at(name), True)
    return gone
