"""Base phrases against a word loop, and the method's own labels on planted texts."""

import random
import re

from brierworks.llm import licenses

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow(text):
    words = WORD.findall((text or "").encode().lower())
    starts, labels = [], set()
    for label, phrase in licenses.BASE:
        p = phrase.encode().split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_phrases(spark):
    rng = random.Random(2)
    bits = ["MIT", "license", "Apache", "general", "public", "License.", "mit-license", "é", "x" * 40, "GNU", "v2.0", "(license)", "\n", "日本", "mit license"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "..."), (None, "mit license"), (5, rows[5][1]), (903, "mit license " * 20000)]
    df = spark.createDataFrame([(*r, "mit") for r in rows], "doc_id bigint, text string, labels string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted(((d, *slow(t)) for d, t in rows), key=str)


def test_own_labels(spark):
    mit = next(t for label, t, _ in licenses.TEMPLATES if label == "mit")
    worn = mit.replace("obtaining", "getting").replace("associated", "related")
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "a b c " + mit + " the end"), (3, "x " + worn), (4, mit.replace("free of charge", "at no cost")), (5, "Licensed under CC BY-NC 4.0."), (6, mit[:40]), (7, "the the software permission")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["apache,apache-2.0", "mit", "mit", "", "cc-by-nc", "", ""]
    assert got[2].score == 1 and 0.7 <= got[3].score < 1 and got[4].score == 0
    assert got[2].matches[0].first == 3 and got[1].base_labels == "apache"


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_the_rest_of_the_file_does_not_matter(spark):
    mit = next(t for label, t, _ in licenses.TEMPLATES if label == "mit")
    worn = mit.replace("person", "body").replace("obtaining", "getting").replace("associated", "related").replace("documentation", "manuals")
    rows = [(1, worn), (2, "person obtaining associated documentation\n" + worn), (3, worn + "\n" + " documentation associated obtaining person" * 500)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {r.labels for r in got.values()} == {"mit"} and len({r.score for r in got.values()}) == 1


def test_every_match_of_long_templates(spark):
    """Against trying every place of every template."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            _, text, keys = rng.choice(licenses.TEMPLATES)
            parts += [w if rng.random() > 0.12 else rng.choice(["the", "software", "foo"]) for w in text.split()]
            parts += [rng.choice(["license", "of", "bar", "conditions"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    got = {r.doc_id: sorted((m.label, m.first, m.last) for m in r.matches) for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, text in rows:
        words, want = text.split(), []
        for label, t, keys in [(label, t, ()) for label, t in licenses.BASE] + licenses.TEMPLATES:
            t = t.split()
            for at in range(len(words) - len(t) + 1):
                here = [a == b for a, b in zip(words[at:], t)]
                spots = [(next(k for k in range(len(t)) if t[k : k + len(key.split())] == key.split()), len(key.split())) for key in keys]
                if all(here) if not keys else (sum(here) >= licenses.COVER * len(t) and all(all(here[k : k + n]) for k, n in spots)):
                    want.append((label, at, at + len(t) - 1))
        assert got[i] == sorted(want)
