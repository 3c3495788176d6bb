"""Language identification with a blended-spectrum string kernel, Nystroem landmarks and ridge regression.

A text is the set of byte n-grams (n = 1..4) of its lower-cased letters; the kernel of two texts is the number of shared
n-grams over the root of both set sizes. Landmarks approximate the kernel matrix of the training sample; one ridge
regression against the rest is fitted for each language. Since the kernel is linear in the presence vector, landmark
vectors and coefficients fold into one matrix, and a batch is scored by one matrix product.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from brierworks.llm.common import crc_mod4, text_slices
from brierworks.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 1 << 14
SAMPLE_PER_LANGUAGE = 400
SAMPLE_ROWS = 25_600  # over all languages
LANDMARKS = 256
LANDMARKS_PER_LANGUAGE = 4  # and sample rows at least
SMALL_TABLE = 100_000
CHUNK = 1024  # sample rows unpacked at a time
RIDGE = 1e-2
SHARPNESS = 3.0
FLOOR = 0.3  # of a plausible score; FLOOR_CHANCE / languages where that is less
FLOOR_CHANCE = 1.2
UNKNOWN = "und"

#: Every ASCII byte that is no letter becomes a blank.
PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
ASCII_LETTER = re.compile(rb"[a-z]")


def letters(text: bytes) -> bytes:
    """Lower-cased letters between blanks; empty if there is no letter."""
    low = text.decode().lower()
    plain = low.encode().translate(PLAIN)
    if not ASCII_LETTER.search(plain) and not any(map(str.isalpha, low)):
        return b""
    return b" " + plain + b" "


def presence(texts: list[bytes]) -> np.ndarray:
    """A row of zeros and ones for each text: which hashed n-grams it has."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    code = np.zeros(len(data), np.uint32)
    for n in range(1, 5):
        code = data if n == 1 else (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        spot = (code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519) >> shift
        for row, (text, end) in enumerate(zip(texts, ends.tolist())):
            if len(text) >= n:
                out[row, spot[end - len(text) : end - n + 1]] = 1
    return out


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang"))
        for i, j, data, starts, ends in text_slices(batch):
            raw = data.tobytes()
            plain = [letters(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
            bits = np.packbits(presence(plain).astype(bool), axis=1)
            yield pa.RecordBatch.from_pydict({"lang": langs.slice(i, j - i), "bits": pa.array([b.tobytes() if p else None for b, p in zip(bits, plain)], pa.binary())})


def _unit_rows(bits: np.ndarray) -> np.ndarray:
    """Presence rows of length one from packed bits."""
    rows = np.unpackbits(bits, axis=1).astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def fit(bits: np.ndarray, classes: np.ndarray, n_classes: int, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases from presence rows (packed bits) and class numbers.

    There are ``landmarks`` of them, and LANDMARKS_PER_LANGUAGE for each class at least.
    """
    turn = np.empty(len(bits), np.int64)  # landmarks take turns between classes
    for c in range(n_classes):
        mine = np.flatnonzero(classes == c)
        turn[mine] = np.arange(len(mine))
    chosen = np.lexsort((classes, turn))
    chosen = chosen[: max(landmarks, int((turn < LANDMARKS_PER_LANGUAGE).sum()))]
    marks = _unit_rows(bits[chosen])
    kmm = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kmm)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([(_unit_rows(bits[k : k + CHUNK]) @ marks.T).astype(np.float64) @ root for k in range(0, len(bits), CHUNK)])
    weight = 1.0 / np.maximum(np.bincount(classes, minlength=n_classes), 1)[classes]  # each language counts alike
    weight *= len(bits) / weight.sum()
    target = np.where(classes[:, None] == np.arange(n_classes), 1.0, -1.0)
    centre, mean = (weight @ phi) / len(bits), (weight @ target) / len(bits)
    gram = (phi - centre).T @ ((phi - centre) * weight[:, None])
    w = np.linalg.solve(gram + ridge * len(bits) * np.eye(gram.shape[0]), (phi - centre).T @ ((target - mean) * weight[:, None]))
    return (marks.T @ (root @ w).astype(np.float32)).astype(np.float32), (mean - centre @ w).astype(np.float32)


def per_language(languages: int, sample: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_ROWS) -> int:
    """Sample rows of each language: fewer as languages grow, LANDMARKS_PER_LANGUAGE at least."""
    return max(min(sample, LANDMARKS_PER_LANGUAGE), min(sample, total // max(1, languages)))


def learn(docs: DataFrame, seed: int = 0, sample: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, weights and biases from rows with a ``lang``; None if there are none.

    Every value of ``lang`` with a row that has letters is learned. About ``sample`` rows of each are used, or a smaller
    equal number where all would come to more than ``total`` (LANDMARKS_PER_LANGUAGE still), the first by a hash of the id;
    this bounds what reaches the driver (2 KB a row). Feature rows are made on the executors, from whole texts.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text", "doc_id")
    lettered = F.col("text").rlike("\\p{L}")
    lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30))
    known = known.where(lettered).withColumn("lot", lot)
    counts = cut_lineage(known.groupBy("lang").agg(F.count("*").alias("count"), F.min("lot").alias("first")))
    languages = counts.count()
    if not languages:
        return None
    share = F.lit(float(per_language(languages, sample, total))) / F.col("count") * (1 << 30)
    # where chance would leave a language none, its first row by lot stays
    picked = known.join(F.broadcast(counts) if languages <= SMALL_TABLE else counts, "lang").where((F.col("lot") < share) | (F.col("lot") == F.col("first"))).select("lang", "text")
    rows = [r for r in picked.mapInArrow(_sample_rows, "lang string, bits binary").where("bits is not null").collect()]
    names = sorted({r["lang"] for r in rows})
    if not names:
        return None
    number = {name: k for k, name in enumerate(names)}
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    bits = np.stack([np.frombuffer(r["bits"], np.uint8) for r in rows])
    return names, *fit(bits, np.array([number[r["lang"]] for r in rows]), len(names))


def _predicted(names: list[str], model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value if model is not None else (None, None)
        for batch in batches:
            doc = batch.column(batch.schema.get_field_index("doc"))
            texts = pa.RecordBatch.from_pydict({"text": pc.struct_field(doc, "text").cast(pa.large_string())})
            for i, j, data, starts, ends in text_slices(texts):
                raw = data.tobytes()
                plain = [letters(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                lang, score = [UNKNOWN] * len(plain), np.zeros(len(plain))
                has = np.array([bool(p) for p in plain], bool)
                plausible = has
                if weights is not None:
                    rows = presence(plain)
                    size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
                    margins = (rows @ weights / size + bias).astype(np.float64) * SHARPNESS
                    best = margins.argmax(axis=1)
                    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
                    score = np.where(has, 1.0 / odds.sum(axis=1), 0.0)
                    plausible = has & (score >= min(FLOOR, FLOOR_CHANCE / len(names)))
                    lang = [names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
                yield pa.RecordBatch.from_pydict({"doc": doc.slice(i, j - i), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "plausible": pa.array(plausible, pa.bool_())})

    return run


def identify(docs: DataFrame, learn_from: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """For each row its columns as the struct ``doc``, lang_pred, score (0 to 1) and plausible.

    Learns from the rows of ``learn_from`` (columns doc_id, text, lang; by default those of ``docs`` whose crc32 of the
    id modulo 4 is not 2). A text that is null or has no letter is ``und`` with score 0, and so is every text where
    nothing could be learned. A text with letters is plausible if its score is FLOOR at least (or FLOOR_CHANCE times what
    guessing would give, if that is less), and wherever nothing could be learned. Neither id, lang nor source is an input of a prediction, so equal texts get equal results.
    """
    source = docs.where(crc_mod4() != 2) if learn_from is None else learn_from
    found = learn(source, seed)
    names = found[0] if found else []
    model = docs.sparkSession.sparkContext.broadcast((found[1], found[2])) if found else None
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return row.mapInArrow(_predicted(names, model), f"doc struct<{fields}>, lang_pred string, score double, plausible boolean")
