"""Top-k and embedding duplicates against brute force."""

import math

import numpy as np
import pytest

from brierworks.llm import embedding_dedup, topk

NAN, INF = float("nan"), float("inf")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def slow_top(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if usable(v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q is None or q % every:
            continue
        scored = [(-sum(s * t for s, t in zip(x, y)), i is None, i or 0) for b, (i, y) in enumerate(good) if b != a and len(y) == len(x)]
        for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, None if none else i, -s))
    return sorted(out, key=str)


def vectors(n, dim, seed, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(groups)] + rng.standard_normal(dim) * rng.choice([0.01, 0.05, 0.5])
        rows.append((i, [float(x) for x in np.float32(v)]))
    return rows


@pytest.mark.parametrize("node_rows", [16384, 40])
def test_top_k(spark, monkeypatch, node_rows):
    monkeypatch.setattr(topk, "SHARD_VALUES", 1600)
    monkeypatch.setattr(topk, "QUERIES_A_TASK", 8)
    rows = vectors(400, 8, 1)
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(50, rows[50][1]), (None, rows[50][1]), (None, rows[3][1])]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [NAN] * 8), (2150, [INF] * 8), (2200, []), (2201, []), (2250, [1.0, 2.0]), (2300, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id bigint, embedding array<float>, row int")
    got = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 5, 50, 256, node_rows).collect()), key=str)
    assert got == slow_top(rows, 5, 50)


def test_pages_are_skipped():
    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (20, 6))
    x = (centres[rng.integers(20, size=4000)] + rng.integers(-3, 4, (4000, 6))).astype(float)
    shard = topk.Shard(np.arange(4000), np.arange(4000), x, float((x * x).sum(axis=1).max()))
    calls = []
    plain = shard.score
    shard.score = lambda rows, q: calls.append(len(rows)) or plain(rows, q)
    for q in range(0, 4000, 400):
        got = sorted(shard.search(x[q], q, 5, -np.inf), reverse=True)
        want = sorted(((int(x[i] @ x[q]), -i, i) for i in range(4000) if i != q), reverse=True)[:5]
        assert got == want
    assert sum(calls) < 10 * 4000 / 2


def slow_links(rows, threshold):
    n = len(rows)
    links = [[] for _ in rows]
    ok = [usable(v) and len(v) and any(v) and label is not None for _, v, label in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), low, rows[j][0] is not None and rows[j][0] == low)
    return sorted(out, key=str)


@pytest.mark.parametrize("cell_rows,block", [(4096, 1024), (30, 16)])
def test_near_duplicates(spark, cell_rows, block):
    rows = [(i, v, i % 2 if i % 11 else None) for i, v in vectors(300, 6, 2, 12)]
    rows += [(500 + i, rows[7][1], 1) for i in range(40)] + [(7, rows[7][1], 1), (None, rows[9][1], 1), (None, [5.0, 5.0, 0.0, 0.0, 0.0, 1.0], 1)]
    rows += [(900, None, 1), (901, [0.0] * 6, 1), (902, [NAN] * 6, 1), (903, [None] * 6, 1), (904, [], 1), (905, [1.0], 1), (906, [2.0], 1), (907, [1e-30] * 6, 0), (908, [3e-30] * 6, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, row int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.98, cell_rows, block).collect()), key=str)
    assert got == slow_links(rows, 0.98)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert topk.top_k(df).count() == 0
    assert embedding_dedup.near_duplicates(df).count() == 0
