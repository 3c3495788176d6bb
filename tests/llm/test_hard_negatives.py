"""Hard negatives against plain loops, the intervals of the codes, and the edge cases."""

import time

import numpy as np
from hypothesis import given, settings, strategies as st

from brierworks.llm import hard_negatives as h

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, score string, x int, rank int"


def plain(rows, every=50, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) by loops over all pairs."""
    big = 1 << 63
    v = []
    for r, (i, e, label) in enumerate(rows):
        if e and label is not None and all(c is not None and np.isfinite(c) for c in e):
            v.append((big if i is None else i, r, label, [int(np.floor(256 * float(np.float32(c)))) for c in e]))
    out = []
    for i, r, label, x in v:
        if i == big or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, s, other) for j, s, other, y in v if s != r and len(x) == len(y)]
        for p in sorted(c for c in scored if c[3] == label)[:positives]:
            fit = sorted(c for c in scored if c[3] != label and 50 * -p[0] <= 100 * -c[0] <= 95 * -p[0])
            out += [(i, p[1], k + 1, n[1], -p[0], -n[0]) for k, n in enumerate(fit[:negatives])]
    return [(a, None if p == big else p, k, None if n == big else n, s, t) for a, p, k, n, s, t in out]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], SCHEMA)
    got = h.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    return sorted(map(tuple, got), key=str)


def test_against_loops_in_several_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 24))
    rows = [(k // 2 if k % 9 == 0 else k, list(map(float, centres[k % 4] + rng.standard_normal(24))), int(rng.integers(0, 3))) for k in range(700)]
    assert mined(spark, rows, shard_values=1 << 11, anchors_a_task=4) == sorted(plain(rows), key=str)


def test_edges(spark):
    one, two, far = [1.0, 0.5], [0.9, 0.5], [-1.0, 0.0]
    rows = [(0, one, 1), (0, one, 1), (None, one, 1), (None, two, 2), (3, two, 2), (4, far, 2), (50, far, 1), (50, None, 1), (100, one, None), (150, [], 1), (200, [None, 1.0], 1), (250, [float("nan"), 1.0], 1), (300, [1.0], 1), (350, [1.0, 1.0, 1.0], 7), (400, [0.0, 0.0], 1), (401, [0.0, 0.0], 3)]
    want = plain(rows)
    assert want and mined(spark, rows) == sorted(want, key=str)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_many_copies_of_a_vector(spark):
    rows = [(k, [0.5, 0.25, float(k % 2)], 0) for k in range(1500)] + [(2000 + k, [0.4, 0.2, 0.9], 1) for k in range(60)]
    got = mined(spark, rows, every=500, shard_values=1 << 10)
    assert got == sorted(plain(rows, every=500), key=str) and got


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 130), st.sampled_from([1, 3, 6]), st.sampled_from([2, 8]))
def test_intervals_hold_the_score(seed, dim, codes, planes):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.standard_normal((20, dim)) * rng.choice([0.2, 50, 3000]))
    shard = h.Codes(x, *h.encode(x, codes))
    seen = []

    def keep(lower, upper):
        seen.append((lower, upper))
        return np.ones(len(lower), bool)

    live, score = shard.survivors(x[0], np.arange(20), keep, planes)
    assert score.tolist() == (x.astype(np.int64) @ x[0].astype(np.int64)).tolist() and len(seen) == codes
    for lower, upper in seen:
        assert (lower <= score).all() and (score <= upper).all()


def test_codes_leave_out_most_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], np.float64))
    shard = h.Codes(x, *h.encode(x, h.CODES))
    for q in x[::200]:
        shard.survivors(q, np.arange(len(x)), h.best(5), h.PLANES)
    assert shard.scored < 0.25 * shard.compared


def test_many_anchors_against_loops(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((5, 24))
    near = lambda k: list(map(float, (centres[k % 5] + rng.standard_normal(24)) * (400.0 if k % 97 == 0 else 1.0)))
    rows = [(k // 2 if k % 9 == 0 else k, near(k), int(rng.integers(0, 3))) for k in range(500)]
    rows += [(600 + k, rows[k % 3][1], k % 2) for k in range(40)]  # copies, in and out of their label
    rows += [(700, [float("inf"), *[1.0] * 23], 1), (702, [0.0] * 24, 1), (704, None, 1), (706, [None] * 24, 1), (None, near(1), 2), (None, near(2), 1), (708, near(3), None)]
    rows += [(710 + 2 * k, list(map(float, rng.standard_normal(70) + 1)), k % 2) for k in range(30)] + [(801, near(4), 8)]  # no anchor has label 8
    want = sorted(plain(rows, every=2), key=str)
    assert mined(spark, rows, every=2) == want and len(want) > 1000
    assert mined(spark, rows, every=2, shard_values=1 << 11, anchors_a_task=50) == want


def searched(chains, q, fits, low, high, k):
    got = [np.concatenate(v) for v in zip(*((a + g, b, chains.row[m], s) for g in range(0, len(q), h.GROUP) for a, b, m, s in [chains.search(q[g : g + h.GROUP], lambda a, m, g=g: fits(a + g, m), low[g : g + h.GROUP], high[g : g + h.GROUP], k)]))]
    return sorted(zip(*(c.tolist() for c in got)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 130), st.sampled_from([0.2, 50, 3000, 1e6, 1e8]), st.sampled_from([1, 3]), st.sampled_from([1, 6]))
def test_blocks_find_what_loops_find(seed, dim, size, k, codes):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.standard_normal((200, dim)) * size * rng.choice([0.01, 1], (200, 1)))
    x[rng.integers(0, 200, 30)] = x[0]
    q, label, of, row, vec_id = x[:20], rng.integers(0, 3, 200), rng.integers(0, 3, 20), np.arange(200), rng.integers(0, 50, 200)
    score = x[:20].astype(np.int64) @ x.astype(np.int64).T
    top = np.sort(np.where(label == of[:, None], score, 0), axis=1)[:, -4:]
    low, high = (np.array([[h.band(s, 50, 95)[side] for s in some] for some in top.tolist()], np.int64) for side in (0, 1))
    kept = h.SLICE, h.FIRST
    h.SLICE, h.FIRST = 48, 16
    try:
        chains = h.Chains(x, *h.encode(x, codes), row, vec_id, label)
        got = searched(chains, q, lambda a, m: chains.label[m] != of[a], low, high, k)
    finally:
        h.SLICE, h.FIRST = kept
    want = []
    for a in range(20):
        for b in range(4):
            fit = sorted((-int(score[a, r]), int(vec_id[r]), r) for r in range(200) if label[r] != of[a] and low[a, b] <= score[a, r] <= high[a, b])
            want += [(a, b, r, -s) for s, _, r in fit[:k]]
    assert got == sorted(want)


def test_zero_anchors_leave_long_members_whole():
    x = np.array([[2.0**25 + 1, 1.0], [3.0, 2.0], [0.0, 0.0]])
    chains = h.Chains(x, *h.encode(x, h.CODES), np.arange(3), np.arange(3), np.arange(3))
    low, high = np.full((1, 1), -(2**62)), np.full((1, 1), 2**62)
    for q, want in ((x[2:], [0, 0, 0]), (x[1:2], [3 * (2**25 + 1) + 2, 13, 0])):
        _, _, m, score = chains.search(q, lambda a, m: (a >= 0) & (m >= 0), low, high, 3)
        assert dict(zip(chains.row[m].tolist(), score.tolist())) == dict(enumerate(want))


def test_anchors_meet_a_shard_in_matrix_products():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8192, 64))
    x = np.floor(256 * x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    words, align, rest = h.encode(x, h.CODES)
    row, q = np.arange(len(x)), x[::16]
    shard, chains = h.Codes(x, words, align, rest), h.Chains(x, words, align, rest, row, row, row)
    low, high = np.full((len(q), 1), np.iinfo(np.int64).min), np.full((len(q), 1), np.iinfo(np.int64).max)
    took = []
    for _ in range(3):
        began = time.process_time()
        alone = [(a, 0, int(r), int(s)) for a in range(16) for live, score in [shard.survivors(q[a], row[row != 16 * a], h.best(5), h.PLANES)] for r, s in [(live[i], score[i]) for i in h.first(score, live, live, 5)]]
        between = time.process_time()
        found = searched(chains, q, lambda a, m: chains.row[m] != 16 * a, low, high, 5)
        took.append((time.process_time() - between) / len(q) / (between - began) * 16)
    assert found[:80] == sorted(alone)
    assert min(took) < 0.25, "an anchor in a block takes a small part of what it takes alone"
