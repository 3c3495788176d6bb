"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are the shapes of a text (n-grams over letter case, digits, blanks and punctuation) and the way its words repeat.
Term weights use document frequencies of the whole corpus; a truncated singular value decomposition of a bounded
labelled sample gives the latent space. The labelled vectors, at most ``2 x SAMPLE_PER_LABEL``, are broadcast; every
document meets all of them in blocked cosine products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from brierworks.llm.common import byte_values, crc_mod4, held_out, ids, span_hashes, spans, table_of, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHAPES = 2048
WORDS = 8  # new word, seen before, same as 1 before, 2 before, ... 4 before, line seen before, new line
TERMS = SHAPES + WORDS
DIMENSIONS = 32
SAMPLE_PER_LABEL = 1500
NEIGHBOURS = 15
BLOCK = 512


def _classes() -> np.ndarray:
    table = np.full(256, 1, np.uint32)  # lower-case and all non-ASCII letters
    for c in range(128):
        letter = chr(c)
        if not ("a" <= letter <= "z"):
            table[c] = 2 if "A" <= letter <= "Z" else 3 if letter.isdigit() else 4 if letter in " \t\r\v\f" else c + 128
    return table


def terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Term frequencies of each text: two blocks of shares, each with root sum of squares one."""
    n = len(starts)
    shapes, words = np.zeros((n, SHAPES), np.float32), np.zeros((n, WORDS), np.float32)
    code = _classes()[data]
    two = code[:-1] * np.uint32(257) + code[1:] if len(code) > 1 else code[:0]
    three = two[:-1] * np.uint32(257) + code[2:] if len(two) > 1 else code[:0]
    spots = [(c * np.uint32(2654435761) + np.uint32(k * 977)) * np.uint32(2246822519) >> np.uint32(21) for k, c in enumerate((code, two, three))]
    for row, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        for k, spot in enumerate(spots):
            if e - s > k:
                shapes[row] += np.bincount(spot[s : e - k], minlength=SHAPES)
    begin, end, first = spans(data, starts)
    h = span_hashes(data, begin, end, byte_values(True))
    line = data != 10
    lb, le, lf = spans(data, starts, ~np.isin(np.arange(256), [10])) if line.any() else (begin[:0], end[:0], np.zeros(n + 1, np.int64))
    lh = span_hashes(data, lb, le, byte_values(False))
    for row in range(n):
        w, v = h[first[row] : first[row + 1]], lh[lf[row] : lf[row + 1]]
        if len(w):
            new = len(np.unique(w))
            words[row, :2] = new, len(w) - new
            for back in range(1, 5):
                words[row, 1 + back] = np.count_nonzero(w[back:] == w[:-back])
            words[row, :6] /= len(w)
            fresh = len(np.unique(v))
            words[row, 6:] = (len(v) - fresh) / len(v), fresh / len(v) * 0.1
    out = np.sqrt(np.hstack([shapes / np.maximum(shapes.sum(axis=1, keepdims=True), 1), words]))
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, df = 0, np.zeros(TERMS, np.int64)
    for batch in batches:
        for i, j, data, starts, ends in text_slices(batch):
            docs += j - i
            df += (terms(data, starts, ends) > 0).sum(axis=0)
    at = np.append(np.flatnonzero(df), TERMS)
    yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "df": pa.array(np.append(df, docs)[at], pa.int64())})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every term over all documents."""
    rows = ids(docs).select("text").mapInArrow(_frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(TERMS + 1)
    for r in rows:
        df[r["term"]] = r["df"]
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, starts, ends in text_slices(batch):
            rows = terms(data, starts, ends)
            yield table_of(batch, i, j, ["quality"], terms=pa.array([r.tobytes() for r in rows], pa.binary()))


def latent_space(x: np.ndarray, dimensions: int, seed: int = 0) -> np.ndarray:
    """Leading right singular vectors of ``x`` by subspace iteration."""
    rng = np.random.default_rng(seed)
    width = min(dimensions + 8, *x.shape)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], width))))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, right = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ right.T)[:, : min(dimensions, width)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, labelled: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Share of similarity-weighted votes for label 1; one half where no neighbour is similar at all."""
    out = np.empty(len(vectors))
    k = min(neighbours, len(labels))
    for i in range(0, len(vectors), BLOCK):
        cosines = vectors[i : i + BLOCK] @ labelled.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 8
        total = weight.sum(axis=1)
        out[i : i + BLOCK] = np.where(total > 0, (weight * labels[near]).sum(axis=1) / np.maximum(total, 1e-300), 0.5)
    return out


def _scored(model, neighbours: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, labelled, labels = model.value
        for batch in batches:
            for i, j, data, starts, ends in text_slices(batch):
                score = np.full(j - i, 0.5)
                if labels is not None:
                    score = vote(_unit(terms(data, starts, ends) @ project), labelled, labels, neighbours)
                score[ends == starts] = 0.0
                yield table_of(batch, i, j, ["doc_id"], score=pa.array(score, pa.float64()))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, threshold: float = 0.7, seed: int = 0) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold``), one row per document row.

    ``labels`` has doc_id and quality; rows whose crc32 of the id modulo 4 is 2 are held out. At most about ``sample``
    rows of each label are learned from, chosen by a hash of the id. Null and empty texts score 0; without any usable
    label every other text scores one half. Labels that are neither 0 nor 1 and null ids teach nothing; a document that
    is labelled twice teaches twice. Only the text is an input of a score.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where((crc_mod4() != 2) & F.col("quality").isin(0, 1))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("quality") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample / max(1, counts.get(0, 0))))
    chosen = F.broadcast(known.where(lot < share))  # about 2 x sample rows of two numbers, whatever the tables hold
    picked = ids(docs).where("text is not null").join(chosen, "doc_id").select("quality", "text")
    rows = sorted(((r["quality"], bytes(r["terms"])) for r in picked.mapInArrow(_labelled, "quality int, terms binary").collect()))
    found = (None, None, None)
    if rows:
        idf = inverse_frequencies(docs)
        x = np.stack([np.frombuffer(t, np.float32) for _, t in rows]) * idf
        space = latent_space(_unit(x), dimensions, seed)
        found = ((idf[:, None] * space).astype(np.float32), _unit(x @ space).astype(np.float32), np.array([q for q, _ in rows], np.float64))
    scored = ids(docs).mapInArrow(_scored(spark.sparkContext.broadcast(found), neighbours), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
