"""Language identification and quality: held-out accuracy on the given tables, and the edge cases."""

import pytest

from brierworks.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 ... !!"), (None, "the thing and the other of it"), (None, None), (5, "x" * 200000), (5, "x" * 200000)]


def test_language_accuracy(spark):
    rows = queries.op8_langid(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    out = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(out) > 150 and sum(out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = [(100 + i, "the cat and the dog run to it of an" if i % 2 else "der hund und die katze ist nicht zu", "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame([(*r, None) for r in ODD] + docs, "doc_id bigint, text string, lang string").selectExpr("*", "'x' AS score", "1 AS doc")
    rows = langid.identify(df).collect()
    assert len(rows) == len(ODD) + 60
    for r in rows:
        if r.doc.text is None or r.doc.doc_id in (2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")
        if r.doc.lang:
            assert r.lang_pred == r.doc.lang
    bare = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "cast(null as string) AS lang")
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}
    assert langid.identify(bare.limit(0)).count() == 0


def test_quality_accuracy(spark):
    rows = queries.op1_quality(spark, SF).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and len(out) > 50 and sum(out) / len(out) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, None), (5, 1, None), (None, 1, 1), (3, None, 1), (2, 7, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == len(ODD)
    assert all(r.score == 0 for r in rows if r.doc_id in (1, 2))
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.0, 0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_votes_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    x, y, labels = rng.standard_normal((30, 5)), rng.standard_normal((50, 5)), rng.integers(0, 2, 50)
    x, y = quality._unit(x), quality._unit(y)
    for row, got in zip(x, quality.vote(x, y, labels, 7)):
        near = sorted(range(50), key=lambda i: -(row @ y[i]))[:7]
        w = [max(0, row @ y[i]) ** 8 for i in near]
        assert got == pytest.approx(sum(a * labels[i] for a, i in zip(w, near)) / sum(w))


def test_every_language_is_learned(spark):
    rng = __import__("random").Random(3)
    made = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(4))
    words = {f"l{k:02}": [made() for _ in range(12)] for k in range(80)}
    docs = [(100 * k + i, " ".join(rng.choice(own) for _ in range(30)), name) for k, (name, own) in enumerate(words.items()) for i in range(12 if k < 64 else 6)]
    rows = langid.identify(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()
    right = [r.lang_pred == r.doc.lang for r in rows]
    assert {r.lang_pred for r in rows} == set(words) and sum(right) > 0.98 * len(rows)


def test_the_sample_is_bounded_in_all(spark):
    assert langid.per_language(4) == 400 and langid.per_language(640) == 40 and langid.per_language(10**6) == langid.LANDMARKS_PER_LANGUAGE
    assert all(langid.per_language(n) * n <= langid.SAMPLE_ROWS for n in range(1, 6400))
