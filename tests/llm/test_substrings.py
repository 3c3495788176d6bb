"""Repeated windows against a plain dictionary of windows."""

import random

import pytest

from brierworks.llm import substrings


def slow(rows, window):
    seen = {}
    parts = [(d, (t or "").encode().split()) for d, t in rows]
    place = lambda d, i: (d is None, d or 0, i)
    for d, w in parts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = min(seen.get(key, place(d, i)), place(d, i))
    out = []
    for d, w in parts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < place(d, i):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [20, 5, 3])
def test_against_dictionary(spark, monkeypatch, window):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(400)] + ["é", "日本", "W1"]
    passages = [[rng.choice(words) for _ in range(rng.randint(window, 60))] for _ in range(6)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(1, 60))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (5, rows[5][1]), (6, rows[7][1]), (None, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (210, None), (211, ""), (212, "one"), (None, None), (213, " ".join(["a"] * 500)), (214, " ".join(words) * 40)]
    df = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, kept string, k int").repartition(5)
    got = substrings.remove_repeats(df, window).collect()
    assert sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == slow(rows, window)
    for r in got:
        assert sum(x["last"] - x["first"] + 1 for x in r.intervals) == r.n_removed
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.intervals, r.intervals[1:])) or len(r.intervals) < 2


def test_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 50)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(120))) for i in range(40)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 6).collect()
    assert sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == slow(rows, 6)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_buckets_follow_the_text(spark, monkeypatch):
    """With few bytes a bucket there are more buckets than rows in a flush; the answer stays."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 80)))) for i in range(30)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    seen = []
    real = substrings._send_windows
    monkeypatch.setattr(substrings, "BUCKET_TEXT", 2)
    monkeypatch.setattr(substrings, "_send_windows", lambda window, buckets: seen.append(buckets) or real(window, buckets))
    got = [(r.doc["doc_id"], r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, 4).collect()]
    assert sorted(got, key=str) == [(d, n, g, k) for d, n, g, k in slow(rows, 4)]
    assert seen == [-(-sum(len(t or "") for _, t in rows) // 2)] and seen[0] > substrings.BUCKETS
