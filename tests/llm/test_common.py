"""Word hashes, words built to collide under polynomial hashes, long texts, and modules on their own."""

import os
import subprocess
import sys

import numpy as np
import pytest

from brierworks.llm import common, packing, substrings

OPERATORS = "conversation_trie embedding_dedup hard_negatives langid licenses mixing packing quality simhash substrings topk toxicity warc".split()


def thue_morse(n, letters="ab"):
    """A word and its complement of equal length, with one polynomial hash modulo 2**64 for any odd base from 1,024 letters on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("lower", [False, True])
def test_span_hashes_tell_words_apart(lower):
    rng = np.random.default_rng(0)
    words = {bytes(rng.integers(65, 91 if k % 2 else 123, rng.integers(1, 90)).astype(np.uint8)) for k in range(5000)}
    words |= {w.encode() for n in (16, 64, 1024, 2048) for w in thue_morse(n)} | {b"a" * n for n in range(1, 200)} | {b"\0" * n for n in range(1, 80)}
    words = sorted(words)
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = end - [len(w) for w in words]
    h = common.span_hashes(data, begin, end, common.byte_values(lower))
    assert len(set(h.tolist())) == len({w.lower() for w in words} if lower else words)
    again = common.span_hashes(np.concatenate([data[5:], data]), begin + len(data) - 5, end + len(data) - 5, common.byte_values(lower))
    assert (h == again).all()


def test_same_spans():
    data = np.frombuffer(b"abcdefgh12 abcdefgh13 abcdefgh12" + b"x" * 100 + b"y" + b"x" * 100, np.uint8)
    at = lambda *x: np.array(x)
    assert common.same_spans(data, at(0, 3), at(22, 3), at(10, 40))
    assert not common.same_spans(data, at(0), at(11), at(10))
    assert common.same_spans(data, at(32), at(133), at(100)) and not common.same_spans(data, at(32), at(132), at(100))


def test_packing_of_words_that_collide():
    import public_tokenizers

    spec = open(public_tokenizers.path("word_bpe_49k.json")).read()
    one, two = thue_morse(1024)
    text = f"{one} some {two} text {one}".encode()
    tokens = packing.WordTokens(spec)
    data = np.frombuffer(text, np.uint8)
    begin, end, _ = common.spans(data, np.array([0]))
    ids, _ = tokens.encode(data, begin, end)
    assert ids.tolist() == tokens.tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_repeats_of_words_that_collide(spark):
    one, two = thue_morse(2048)
    around = [f"w{k}" for k in range(20)]
    texts = [" ".join(around[:10] + [middle] + around[10:]) for middle in (one, two)]
    got = {r.doc.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), window=20).collect()}
    assert got == {0: 0, 1: 0}


def test_a_long_text_leaves_little_behind():
    kept = common.worker_memory()
    data = np.frombuffer(b"some words of a long text " * 400_000, np.uint8)  # 10 MB
    begin, end, _ = common.spans(data, np.array([0]))
    before = sum(sum(t.nbytes for t in v) for k, v in kept.items() if isinstance(k, int))
    common.span_hashes(data, begin, end, common.byte_values(True))
    assert sum(sum(t.nbytes for t in v) for k, v in kept.items() if isinstance(k, int)) == before


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import importlib
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
op = importlib.import_module("brierworks.llm.{name}")
docs = spark.createDataFrame([(k, "some words of a text " * 9 + str(k), "en", "s" + str(k % 2)) for k in range(20)], "doc_id bigint, text string, lang string, source string")
vecs = spark.createDataFrame([(k, [float(k % 3), 1.0], k % 2) for k in range(60)], "vec_id bigint, embedding array<double>, label int")
labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id bigint, quality int, toxic int")
run = {{
    "conversation_trie": lambda: op.conversation_trie(docs.selectExpr("doc_id AS conv_id", "1 AS turn", "lang AS role", "text")),
    "embedding_dedup": lambda: op.near_duplicates(vecs), "hard_negatives": lambda: op.mine(vecs), "langid": lambda: op.identify(docs),
    "licenses": lambda: op.scan(docs), "mixing": lambda: op.mix(docs), "packing": lambda: op.pack(docs, {tokenizer!r}),
    "quality": lambda: op.score_quality(docs, labels), "simhash": lambda: op.deduplicate(docs), "substrings": lambda: op.remove_repeats(docs, window=20),
    "topk": lambda: op.top_k(vecs), "toxicity": lambda: op.score_toxicity(docs, labels),
    "warc": lambda: op.round_trip(docs.selectExpr("doc_id AS page_id", "concat('http://h/', doc_id) AS url", "text AS html")),
}}["{name}"]
print("rows", len(run().collect()))
"""


@pytest.mark.parametrize("name", OPERATORS)
def test_each_module_alone(name, tmp_path):
    """A fresh process outside the repository whose workers cannot import the package."""
    import public_tokenizers

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=repo, name=name, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout and int(done.stdout.split("rows ")[1]) > 0, done.stderr[-2000:]
