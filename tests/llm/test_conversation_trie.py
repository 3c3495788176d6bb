"""The conversation trie against plain loops: bands, blocks, long conversations and the edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from brierworks.llm import conversation_trie as t

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_convs int, depth string, k1 int, last int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        value = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += value
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if whole[c] == p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7, "x", 8, 9) for r in rows], SCHEMA)
    return sorted(map(tuple, t.conversation_trie(df, **more).select(*COLUMNS).collect()), key=str)


def talk(seed, convs, deepest, words="ab"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-convs, 2 * convs), convs):
        rows += [(c, k, rng.choice(["user", None]), rng.choice(words) * (1 + k % 3)) for k in range(rng.randint(1, deepest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band", [2, 3, 8])
def test_bands(spark, band):
    rows = talk(band, 60, 30)
    assert built(spark, rows, band=band) == plain(rows)


def test_blocks_of_depths(spark, monkeypatch):
    rows = talk(11, 25, 40, "a")
    monkeypatch.setattr(t.prefix_keys, "__defaults__", (4,))
    monkeypatch.setattr(t.prefix_trie, "__defaults__", (3, 4))
    assert built(spark, rows, band=3) == plain(rows)


def test_a_conversation_with_most_turns(spark):
    rows = talk(5, 20, 6) + [(1000, k // 3 if k % 7 else None, "user", f"é{k}") for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    short, by_blocks = t.number_turns(df), t.number_turns(df, long=100)
    key = ["conv_id", "pos", "c1", "c2", "bytes"]
    assert sorted(map(tuple, short.select(*key).collect())) == sorted(map(tuple, by_blocks.select(*key).collect()))
    assert short.count() == len(rows)
    ends = [r for r in t.conversation_trie(df).collect() if r.conv_id == 1000]
    h = zlib.crc32(b"1000") % 9
    assert max(r.depth for r in ends) == 900 and h is not None


def test_many_conversations_end_in_one_node(spark):
    rows = [(c, 0, "user", "hello") for c in range(-700, 700)]
    assert built(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, 0, "user", ""), (5, 0, "user", ""), (6, 1, "a:", "b"), (6, 2, "a", ":b"), (7, 1, "", "a:b"), (9223372036854775807, 0, "user", "x" * 100_000), (-9223372036854775807, 3, "ü", "ü"), (8, 4, "user", "only")]
    assert built(spark, rows) == plain(rows)
    assert built(spark, []) == [] and built(spark, rows[:1]) == []
    assert built(spark, [(8, 4, "user", "only")]) == plain([(8, 4, "user", "only")])
