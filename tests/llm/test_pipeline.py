"""Each stage of the pipeline against plain loops, and the whole on given and on odd tables."""

import random

import pytest

import corpus_pipeline as pipeline
from brierworks.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def slow_groups(texts, words, budget, similarity):
    nodes = sorted(set(texts), key=str)
    prints = [simhash.fingerprint((t or "").encode(), words) & (2**64 - 1) for t in nodes]
    sets = [simhash.shingles(t, words) for t in nodes]
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return {t: root(i) for i, t in enumerate(nodes)}


def edited(rng, words, share):
    return [rng.choice("pqrstuvw") * 3 if rng.random() < share else w for w in words]


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(8):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([15, 60, 200]))]
        rows += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.03]))) for _ in range(12)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(rng.sample(rows, len(rows)))]


@pytest.mark.parametrize("seed,group_rows,block", [(1, 1 << 15, 256), (2, 16, 4)])
def test_near_duplicate_groups(spark, seed, group_rows, block):
    rows = near_copies(seed) + [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, " ", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.node: r.label for r in simhash.similar_groups(df, 5, 12, 0.8, group_rows, block).collect()}
    node = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    want = slow_groups([r[1] for r in rows], 5, 12, 0.8)
    texts = sorted(want, key=str)
    assert all((got[node[a]] == got[node[b]]) == (want[a] == want[b]) for a in texts for b in texts)
    assert len(set(want.values())) < 0.6 * len(texts)


def test_one_of_each_group_stays(spark):
    rows = near_copies(3)
    rows += [(None, rows[0][1], "en", "s", 1), (None, "only null id here", "en", "s", 1), (3, rows[3][1], "en", "s", 1), rows[5], (900, None, None, None, None), (901, None, None, None, None)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    want = slow_groups([r[1] for r in rows], 5, 12, 0.8)
    low = {}
    for r in rows:
        key = (r[0] is None, r[0] or 0)
        low[want[r[1]]] = min(low.get(want[r[1]], key), key)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(low.values())


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", None, 5), (None, "some plain words of text", "en", "a", 24), (4, "x " * 30000, "en", "b", 60000), (5, "some other words\nof a text", None, "a", 26), (5, "some other words\nof a text", None, "a", 26)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", kept string")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == before.columns
        if name == "language_id":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 4, 5, 5]
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 4, 5]
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert texts[5] == rows[5][1] and texts[4] == "x"
    assert docs.count() > 0


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_run(spark):
    pieces = pipeline.run(spark, SF).collect()
    assert len(pieces) > 50
    used = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096


def repeated_lines(seed):
    """Pairs of texts that share a passage and a line, the line standing once to eight times, some words edited."""
    rng = random.Random(seed)
    rows = []
    for g in range(200):
        base = [f"g{g}w{k}" for k in range(rng.choice([40, 100, 250]))]
        line = [f"g{g}l{k}" for k in range(8)]
        share, times = [(0, 8), (0, 3), (0.005, 4), (0.01, 4), (0.02, 2)][g % 5]
        rows += [" ".join(base + line * (1 if times == 3 else 2)), " ".join(edited(rng, base, share) + line * times)]
    return sorted(set(rows))


def test_recall_without_the_bit_gate(spark):
    texts = repeated_lines(5)
    got = {r.node: r.label for r in simhash.similar_groups(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    node = {r.text: r.h for r in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    sets = [simhash.shingles(t, 5) for t in texts]
    bands = {}
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if alike >= 0.8:
                band = "equal" if alike == 1 else 0.9 if alike >= 0.9 else 0.8
                bands.setdefault(band, []).append(got[node[texts[i]]] == got[node[texts[j]]])
            else:
                assert got[node[texts[i]]] != got[node[texts[j]]]
    assert all(bands["equal"]) and len(bands["equal"]) >= 40
    assert sum(bands[0.9]) >= 0.98 * len(bands[0.9]) and sum(bands[0.8]) >= 0.85 * len(bands[0.8])


def test_the_prediction_decides_the_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = [(9_000_001, "ἐν ἀρχῇ ἦν ὁ λόγος καὶ ὁ λόγος", None, "s", 1)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(strange, SCHEMA))
    kept = {r.doc_id for r in pipeline.keep_known_languages(spark, both, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect()}


def test_letters_stay_where_no_language_is_known(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1)], SCHEMA)
    assert [r.doc_id for r in pipeline.keep_known_languages(spark, docs, SF).collect()] == [1]
