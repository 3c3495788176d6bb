"""Fingerprints and links of the SimHash operator against plain loops."""

import random

import numpy as np
import pytest
import xxhash

from brierworks.llm import simhash


def slow_print(text, words):
    parts = [w for w in (text or "").encode().lower().split()]
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(rows, budget=4):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= budget:
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(doc, low.get(root(i), doc))
    return [low.get(root(i)) for i in range(len(rows))]


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of it again and again".split()
    rows = [(i, " ".join(base[: 6 + i])) for i in range(12)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "One"), (54, "one"), (None, "one"), (None, None), (3, rows[3][1]), (60, "é" * 3 + " Ü " + "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnsRenamed({}).selectExpr("doc_id", "text", "'k' AS fp", "1 AS component_id", "0 AS rot")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df, 4, 4).collect()), key=str)
    prints = [(d, slow_print(t, 4)) for d, t in rows]
    want = sorted(((d is None, d or 0, f, c) for (d, f), c in zip(prints, slow_classes(prints))), key=str)
    assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("group_rows", [1 << 15, 40])
def test_links_keep_every_class(spark, group_rows):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for seed in list(prints)[:6]:
        for _ in range(40):
            x = seed
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            prints.add(x)
    rows = [(i, x) for i, x in enumerate(sorted(prints))]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for _, x in rows], "fp bigint")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.fingerprint_links(df, 4, group_rows).collect()]
    at = {x: i for i, x in rows}
    assert all((a ^ b) and a in at and b in at for a, b in links)
    parent = simhash.forest(len(rows), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    assert parent.tolist() == slow_classes(rows)
