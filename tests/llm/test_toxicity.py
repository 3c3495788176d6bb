"""Toxicity: held-out accuracy, the label model on simulated votes, the parts against plain loops, and the edge cases."""

import numpy as np

from brierworks.llm import queries, toxicity as t

SF = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 ... !!"), (None, "you are a moron"), (None, None), (5, "x" * 200_000 + " scum" * 50_000), (5, "x" * 200_000)]


def test_held_out_accuracy(spark):
    rows = queries.op13_toxicity(spark, SF).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 10_000
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    out = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    toxic, called = [p for p, y in out if y == 1], [y for p, y in out if p == 1]
    assert len(out) > 500 and sum(toxic) / len(toxic) > 0.88 and sum(called) / len(called) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(*r, 1, 0.5, "x") for r in ODD], "doc_id bigint, text string, toxic int, score double, term string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, None), (4, 0, 0), (None, 1, 1), (3, None, 1), (2, 7, 1), (1, 1, 1)], "doc_id bigint, toxic int, quality int")
    clean = spark.createDataFrame([(5, 1), (4, 0), (3, 0), (2, 0), (3, 0)], "doc_id bigint, toxic int")  # mostly clean: silence is clean
    for given, mostly_clean in ((labels, False), (clean, True), (labels.limit(0), True)):
        rows = t.score_toxicity(docs, given).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        silent = {r.score for r in rows if r.doc_id in (1, 2, 3)}
        assert len(silent) == 1 and (silent.pop() < 0.5 or not mostly_clean)
        assert all(r.held_out == (r.doc_id is None or r.doc_id in held) for r in rows)
        assert t.score_toxicity(docs.limit(0), given).count() == 0


def crc5(n):
    import zlib

    return zlib.crc32(str(n).encode()) % 5 == 0


held = [n for n in range(1, 6) if crc5(n)]


def test_lists_decide_without_labels(spark):
    docs = spark.createDataFrame([(k, "you pathetic worthless idiot" if k % 10 == 0 else "the cat sat on the mat") for k in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in t.score_toxicity(docs, labels).collect()}
    assert all(got[k] == (k % 10 == 0) for k in got)


def simulated(n, rng):
    """Votes of six voters of known accuracies; the last copies the one before it in nine of ten documents."""
    y = rng.random(n) < 0.2
    toxic, other = np.array([0.5, 0.4, 0.6, 0.3, 0.4]), np.array([0.02, 0.05, 0.1, 0.01, 0.1])
    votes = rng.random((n, 5)) < np.where(y[:, None], toxic, other)
    copy = np.where(rng.random(n) < 0.9, votes[:, 4], rng.random(n) < 0.1)
    return y, np.column_stack([votes, copy]).astype(float), toxic, other


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y, votes, toxic, other = simulated(200_000, rng)
    wrong = np.full(6, 0.2)  # a poor start that says nothing about the differences
    model = t.fit_label_model(len(y), votes.T @ votes, 0.2, wrong, 0.0, rounds=400)
    assert np.abs(model.toxic[:5] - toxic).max() < 0.05 and np.abs(model.other[:5] - other).max() < 0.02
    assert model.correlated[4, 5] and model.correlated.sum() == 2
    assert model.weight[4] < 0.7 and (model.weight[:4] == 1).all()
    sure = t.sigmoid(model.log_odds(votes)) > 0.5
    best = max((votes[:, k] == y).mean() for k in range(6))
    assert (sure == y).mean() > best


def test_pair_counts_cover_all_documents(spark):
    texts = ["You are stupid!!", None, "", "please, thanks", "stupid stupid trash", "SHOUT"] * 40
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id bigint, text string").repartition(7)
    terms = t.Terms.of(["stup*", "stup**", "trash"])
    voters = t.Voters([[k] for k in range(len(terms.names))])
    sent = spark.sparkContext.broadcast((terms, voters))
    rows = docs.select("text").mapInArrow(t._pair_counts(sent), "i int, j int, n bigint").groupBy("i", "j").sum("n").collect()
    got = {(r[0], r[1]): r[2] for r in rows}
    votes = np.zeros((len(texts), len(terms.names)))
    for row, x in zip(votes, texts):
        row[terms.found(x)] = 1
    want = votes.T @ votes
    assert got.pop((-1, -1)) == len(texts)
    assert got == {(i, j): want[i, j] for i in range(len(want)) for j in range(i, len(want)) if want[i, j]}


def test_terms_of_a_text():
    text = "Achlichung achlichkeit, was GUT! achli"
    every = t.terms_of(text.lower())
    assert {"achlichung", "achl*", "achl**", "achl%", "achlich**", "gut"} <= every and "achlichk**" not in every and "gut*" not in every
    names = sorted(every)
    terms = t.Terms.of(names)
    assert {terms.names[k] for k in terms.found(text)} >= every
    assert terms.found(None) == [] and terms.found("") == []


def test_linear_fit_is_a_minimum():
    rng = np.random.default_rng(1)
    x = rng.random((300, 7)) < 0.3
    target, weight = rng.random(300), rng.random(300) + 0.5
    w = t.fit_linear(x, target, weight)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (weight * (np.logaddexp(0, z) - target * z)).sum() + 0.15 * (v[:-1] ** 2).sum() + 5e-4 * v[-1] ** 2

    assert all(loss(w) <= loss(w + s * d) for d in np.eye(8) for s in (1e-3, -1e-3))
