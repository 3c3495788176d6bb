"""Tables with atomic publication: half writes, repeats, late rows, two writers, old versions and their removal."""

import pytest
from pyspark.sql import functions as F

from brierworks.sources import snapshots as S

SCHEMA = "k int, v string, at int, d int"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(spark, path, version=None):
    return sorted(map(tuple, S.read(spark, path, SCHEMA, version).collect()))


def put(spark, path, rows, **more):
    return S.merge(spark, path, make(spark, rows), ["k", "d"], "d", ["at"], **more)


def test_merge_by_key(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert content(spark, path) == [] and put(spark, path, []) == 0
    assert put(spark, path, [(1, "a", 1, 1), (1, "old", 0, 1), (2, "b", 1, 1), (3, "c", 1, 2)]) == 1
    assert put(spark, path, [(1, "late", 0, 1), (2, "B", 1, 1), (4, "d", 0, 3)]) == 2
    assert content(spark, path) == [(1, "a", 1, 1), (2, "B", 1, 1), (3, "c", 1, 2), (4, "d", 0, 3)]
    assert content(spark, path, 1) == [(1, "a", 1, 1), (2, "b", 1, 1), (3, "c", 1, 2)]


def test_repeats_and_late_rows_publish_nothing(spark, tmp_path):
    path, rows = f"{tmp_path}/t", [(1, "a", 5, 1), (2, None, None, 1)]
    assert put(spark, path, rows) == 1
    files = sorted(p for p in (tmp_path / "t").rglob("*"))
    for batch in (rows, rows * 2, [(1, "older", 4, 1)], []):
        assert put(spark, path, batch) == 1
    assert sorted(p for p in (tmp_path / "t").rglob("*")) == files


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, "a", 1, 1), (2, "b", 1, 2)])
    put(spark, path, [(1, "A", 2, 1)])
    first, second = (S.manifest(spark, path, v) for v in (1, 2))
    assert first["d=2"] == second["d=2"] and first["d=1"] != second["d=1"]


def test_a_write_that_stops_half_way_is_invisible(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, "a", 1, 1)])
    reader = S.read(spark, path, SCHEMA)

    def crash(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as broken:
        broken.setattr(S._Store, "publish", crash)
        with pytest.raises(OSError):
            put(spark, path, [(1, "half", 2, 1), (2, "half", 2, 2)])
    assert len(list((tmp_path / "t").glob("d=1/commit=*"))) == 2  # the files are there, no manifest names them
    assert content(spark, path) == [(1, "a", 1, 1)] and S.current(spark, path) == 1
    assert put(spark, path, [(1, "half", 2, 1), (2, "half", 2, 2)]) == 2
    assert content(spark, path) == [(1, "half", 2, 1), (2, "half", 2, 2)]
    assert [r.v for r in reader.collect()] == ["a"]  # a reader keeps the version it began with


def test_failing_tasks_leave_the_table_as_it_was(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, "a", 1, 1)])
    bad = make(spark, [(k, "x", 2, k % 3) for k in range(30)]).withColumn("v", F.when(F.col("k") == 29, F.raise_error(F.lit("bad row"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="bad row"):
        S.merge(spark, path, bad, ["k", "d"], "d", ["at"])
    assert content(spark, path) == [(1, "a", 1, 1)]


def test_two_writers_from_one_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, "a", 1, 1)])
    with pytest.raises(S.Taken):
        S.replace_partitions(spark, path, make(spark, [(9, "lost", 9, 1)]), "d", 0)
    assert content(spark, path) == [(1, "a", 1, 1)]
    real, raced = S.replace_partitions, []

    def race(*args):
        if not raced:  # somebody else publishes while the first merge is being written
            raced.append(1)
            real(spark, path, make(spark, [(1, "a", 1, 1), (2, "other", 1, 1)]), "d", 1)
        return real(*args)

    monkeypatch.setattr(S, "replace_partitions", race)
    assert put(spark, path, [(3, "mine", 1, 1)]) == 3
    assert content(spark, path) == [(1, "a", 1, 1), (2, "other", 1, 1), (3, "mine", 1, 1)]


def test_coalesce_keeps_values_and_null_keys_match(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(1, "a", 1, 1), (2, "b", 1, 1)])
    put(spark, path, [(1, None, 2, 1), (2, "B", 2, 1)], mode="coalesce")
    assert content(spark, path) == [(1, "a", 2, 1), (2, "B", 2, 1)]


def test_old_versions_go_after_the_grace_period(spark, tmp_path):
    path = f"{tmp_path}/t"
    for at in (1, 2, 3):
        put(spark, path, [(1, f"v{at}", at, 1), (2, "same", 1, 2)])
    assert S.vacuum(spark, path) == [] and S.versions(spark, path) == [1, 2, 3]
    gone = S.vacuum(spark, path, 0)
    assert S.versions(spark, path) == [3] and len(gone) == 4
    assert content(spark, path) == [(1, "v3", 3, 1), (2, "same", 1, 2)]


def test_partition_filters_reach_the_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, [(k, "x", 1, k % 5) for k in range(50)])
    days = spark.createDataFrame([(3, "wanted")], "d int, note string")
    plan = S.read(spark, path, SCHEMA).join(days.where("note = 'wanted'").hint("broadcast"), "d")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in text and "dynamicpruning" in text
    assert plan.count() == 10
