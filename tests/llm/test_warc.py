"""Archives: exact round trip, revisits, global order; the loser tree against sorting."""

import base64
import hashlib
import random

import pytest

from brierworks.llm import queries, warc


def want(rows, min_bytes=0):
    first = {}
    place = lambda i: (i is None, i or 0)
    for i, _, html in rows:
        if len((html or "").encode()) >= min_bytes:
            first[html or ""] = min(first.get(html or "", place(i)), place(i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = (html or "") in first and first[html or ""] != place(i)
        out.append((f"<urn:page:{'' if i is None else i}>", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", f"<urn:page:{first[html or ''][1]}>" if again else None))
    return sorted(out, key=str)


def pages():
    rng = random.Random(4)
    bodies = [None, "", "é", "\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "<p>\n</p>\r\n", "x" * 300000]
    rows = [(i, f"http://h{rng.randint(0, 5)}.example.com:80/p{rng.randint(0, 9)}?q=É", rng.choice(bodies) if rng.random() < 0.5 else f"<html>{rng.random()}</html>") for i in range(120)]
    return rows + [(7, rows[7][1], rows[7][2]), (None, None, "é"), (None, "no scheme", "only null"), (500, "http://a/\r\nX: y", "q")]


def test_round_trip(spark):
    for min_bytes in (0, 3):
        rows = pages()
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, first int").repartition(6)
        got = warc.round_trip(df, min_bytes).collect()
        assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows, min_bytes)
        assert all(r.intact for r in got)
        keys = [(r.url_key.encode(), r.captured) for r in got]
        assert keys == sorted(keys)


def test_separators_at_every_place(spark):
    """Payloads that hold the separator or parts of it, at their ends and across the reader's buffers."""
    ends = ["\r\n", "\r\n\r\n", "\r", "\n\r\n", "\r\n\r", "\r\n\r\n\r\n", "\r\r\n\r\n"]
    bodies = [a + m + b for a in ["", *ends] for m in ("", "x", "\r\n\r\n" * 3, "y" * 65_530) for b in ["", *ends]]
    rows = [(i, "http://a/", b) for i, b in enumerate(bodies)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)).collect()
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    assert all(r.intact for r in got)


def test_ranges_follow_the_rows(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(pages(), "page_id bigint, url string, html string").repartition(3)
    warc.write_archives(df, f"{tmp_path}/w")
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    history = warc.capture_history(warc.read_archives(spark, f"{tmp_path}/w"))
    assert history.rdd.getNumPartitions() == -(-df.count() // 7)
    keys = [(r.url_key.encode(), r.captured) for r in history.collect()]
    assert len(keys) == df.count() and keys == sorted(keys)


def test_damaged_archive(spark, tmp_path):
    import gzip

    warc.write_archives(spark.createDataFrame(pages()[:5], "page_id bigint, url string, html string").coalesce(1), f"{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.gz")
    whole = gzip.decompress(file.read_bytes())
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.gz").write_bytes(gzip.compress(whole[:-40]))
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, f"{tmp_path}/cut").collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = queries.op6_warc(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((f"<urn:page:{r.page_id}>", r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else f"<urn:page:{r.refers_to}>") for r in got), key=str) == want(rows)


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
