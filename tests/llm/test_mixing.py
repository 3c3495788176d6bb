"""Targets against repeated resharing, totals near targets, and equal results of equal runs."""

import random

import numpy as np

from brierworks.llm import mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        out = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return fixed | out
        fixed |= {s: most * sizes[s] for s in over}


def check(rows):
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in rows:
        s = r.doc.source
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.size * r.copies
        target[s] = r.target
        largest[s] = max(largest.get(s, 0), r.size)
        assert r.size == len((r.doc.text or "").encode().split()) and 0 <= r.copies <= 2
    want = slow_targets(sizes)
    for s in sizes:
        assert all(r.source_size == sizes[s] for r in rows if r.doc.source == s)
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1e-6


def documents(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "B", "é", "zz", None, "\U0001f600", "￿"]), " \t".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def test_mix(spark):
    rows = documents(600, 1) + [(900, "a", None), (901, None, ""), (None, "a", "x y"), (None, "a", "x y"), (5, "tiny", "q " * 3000), (902, "none", "")]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id bigint, source string, text string, p double, size int")
    one = mixing.mix(df).collect()
    assert len(one) == len(rows)
    check(one)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, again))


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_BITS", 2)
    df = spark.createDataFrame(documents(700, 2), "doc_id bigint, source string, text string")
    check(mixing.mix(df).collect())


def test_empty_tables(spark):
    schema = "doc_id bigint, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, "a", None), (2, "b", " ")], schema)).collect()
    assert [(r.size, r.target, r.copies) for r in rows] == [(0, 0.0, 0)] * 2


def test_expectations_hold():
    rng = np.random.default_rng(4)
    size, p = [3.0, 10.0, 1.0, 7.0, 2.0], [0.3, 0.5, 0.9, 0.2, 0.6]
    runs = [mixing.pivot(size, p, rng.random(5)) for _ in range(20000)]
    assert np.allclose(np.mean(runs, axis=0), p, atol=0.02)
    for out in runs[:200]:
        assert sum(0 < x < 1 for x in out) <= 1
        assert abs(sum(a * b for a, b in zip(size, out)) - sum(a * b for a, b in zip(size, p))) < 1e-9
