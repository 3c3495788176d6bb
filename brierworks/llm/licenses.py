"""Licence scan with a positional index of licence templates.

The index holds, for each licence word, its places in the templates. A template is looked for through the two rarest words
(of highest IDF over the whole corpus) of its mandatory key phrases, which stand in place in every match: each of their
occurrences in a file proposes an alignment, file position minus template position, and the alignments that both propose
are verified: the key phrases must stand in place, byte for byte, and a share of the template's words must be
aligned. Short templates are mandatory as a whole. So no match is lost, whatever else a file holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from brierworks.llm.common import byte_table, byte_values, ids, span_hashes, spans, table_of, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COVER = 0.7

#: Phrases whose places are counted, with their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Label, template, mandatory key phrases (none: the template itself). Fixed wordings of public licences.
TEMPLATES = [
    ("agpl", "gnu affero general public license", ()),
    ("all-rights-reserved", "all rights reserved", ()),
    ("apache-2.0", "apache license version 2 0", ()),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("required by applicable law or agreed to in writing",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "bsd license", ()),
    ("cc-by", "cc by 4 0", ()),
    ("cc-by", "creative commons attribution 4 0 international", ()),
    ("cc-by-nc", "cc by nc 4 0", ()),
    ("cc-by-sa", "cc by sa 4 0", ()),
    ("cc0", "cc0 1 0 universal", ()),
    ("gpl-2.0", "gnu general public license version 2", ()),
    ("gpl-3.0", "gnu general public license version 3", ()),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("lgpl", "gnu lesser general public license", ()),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mpl-2.0", "mozilla public license version 2 0", ()),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]

WORD = byte_table((48, 57), (97, 122), (65, 90), (128, 255))  # A-Z count as a-z


class Index:
    """Positional postings of the templates; ``idf`` ranks the licence words."""

    def __init__(self, idf: dict[str, float]):
        whole = [(label, phrase.split(), None, True) for label, phrase in BASE]
        whole += [(label, text.split(), [k.split() for k in keys] or None, False) for label, text, keys in TEMPLATES]
        self.words = sorted({w for _, t, _, _ in whole for w in t})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.idf = np.array([idf.get(w, 0.0) for w in self.words])
        joined = "".join(self.words).encode()
        ends = np.cumsum([len(w.encode()) for w in self.words])
        self.values = byte_values(True)
        h = span_hashes(np.frombuffer(joined, np.uint8), np.append(0, ends[:-1]), ends, self.values)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.templates = [(label, np.array([self.number[w] for w in t]), keys, base) for label, t, keys, base in whole]

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The licence word at each word of the texts, -1 for other words."""
        h = span_hashes(data, begin, end, self.values)
        near = np.searchsorted(self.sorted, h).clip(max=len(self.sorted) - 1)
        return np.where(self.sorted[near] == h, self.order[near], -1)

    def _aligned(self, template: int, first: np.ndarray, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those alignments that lie in one text and have all key phrases in place, with their share of words in place."""
        _, wanted, keys, _ = self.templates[template]
        first = first[(first >= 0) & (first + len(wanted) <= len(words))]
        first = first[doc[first] == doc[first + len(wanted) - 1]]
        hit = words[first[:, None] + np.arange(len(wanted))] == wanted
        share = hit.mean(axis=1)
        good = share >= (1.0 if keys is None else COVER)
        for key in keys or ():
            k = self._begin(wanted, key)
            good &= hit[:, k : k + len(key)].all(axis=1)
        return first[good], share[good]

    def _begin(self, wanted: np.ndarray, key: list[str]) -> int:
        number = [self.number[w] for w in key]
        return next(i for i in range(len(wanted)) if wanted[i : i + len(key)].tolist() == number)

    def _rarest(self, wanted: np.ndarray, keys: list[list[str]] | None) -> list[int]:
        """The places in a template of the two rarest words that every match has."""
        needed = range(len(wanted)) if keys is None else sorted({self._begin(wanted, key) + d for key in keys for d in range(len(key))})
        return sorted(needed, key=lambda k: (-self.idf[wanted[k]], wanted[k], k))[:2]

    def places(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Template, first word and share of words in place, for every match in a slice of texts."""
        known = np.flatnonzero(words >= 0)
        by_word = known[np.argsort(words[known], kind="stable")]
        edges = np.searchsorted(words[by_word], np.arange(len(self.words) + 1))
        for t, (_, wanted, keys, _) in enumerate(self.templates):
            first, second = (by_word[edges[wanted[k]] : edges[wanted[k] + 1]] - k for k in (self._rarest(wanted, keys) * 2)[:2])
            for at, share in zip(*self._aligned(t, np.intersect1d(first, second, assume_unique=True), words, doc)):
                yield t, int(at), float(share)

    def verified(self, template: int, first: int, raw: bytes, begin: np.ndarray, end: np.ndarray) -> bool:
        """The mandatory phrases, byte for byte."""
        _, wanted, keys, _ = self.templates[template]
        texts = [self.words[k] for k in wanted.tolist()]
        for key in keys or [texts]:
            k = next(i for i in range(len(texts)) if texts[i : i + len(key)] == key)
            if any(raw[begin[first + k + d] : end[first + k + d]].lower() != w.encode() for d, w in enumerate(key)):
                return False
        return True


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, docs = Index({}), 0
    df = np.zeros(len(index.words), np.int64)
    for batch in batches:
        for i, j, data, starts, _ in text_slices(batch):
            begin, end, first = spans(data, starts, WORD)
            number = index.numbers(data, begin, end)
            hit = number >= 0
            doc = np.repeat(np.arange(j - i), np.diff(first))[hit]
            df += np.bincount(np.unique(doc * len(df) + number[hit]) % len(df), minlength=len(df))
            docs += j - i
    yield pa.RecordBatch.from_pydict({"word": pa.array([*index.words, None], pa.string()), "df": pa.array([*df.tolist(), docs], pa.int64())})


def word_rarity(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents."""
    rows = ids(docs).select("text").mapInArrow(_frequencies, "word string, df bigint").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {r["word"]: r["df"] for r in rows}
    return {w: float(np.log((1 + df[None]) / (1 + n))) for w, n in df.items() if w is not None}


def _scanned(idf: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        for batch in batches:
            for i, j, data, starts, _ in text_slices(batch):
                n = j - i
                begin, end, first = spans(data, starts, WORD)
                words = index.numbers(data, begin, end)
                doc = np.repeat(np.arange(n), np.diff(first))
                raw = data.tobytes()
                base = [[] for _ in range(n)]
                labels = [set() for _ in range(n)]
                bases = [set() for _ in range(n)]
                matches = [[] for _ in range(n)]
                score = np.zeros(n)
                for t, at, share in index.places(words, doc):
                    if not index.verified(t, at, raw, begin, end):
                        continue
                    label, wanted, _, counted = index.templates[t]
                    d = int(doc[at])
                    labels[d].add(label)
                    score[d] = max(score[d], share)
                    start = int(at - first[d])
                    matches[d].append({"label": label, "first": start, "last": start + len(wanted) - 1, "share": share})
                    if counted:
                        bases[d].add(label)
                        base[d].append(start)
                yield table_of(
                    batch, i, j, ["doc_id"],
                    n_words=pa.array(np.diff(first), pa.int64()),
                    n_base=pa.array([len(b) for b in base], pa.int64()),
                    first_word=pa.array([min(b, default=None) for b in base], pa.int64()),
                    last_word=pa.array([max(b, default=None) for b in base], pa.int64()),
                    base_labels=pa.array([",".join(sorted(b)) for b in bases], pa.string()),
                    labels=pa.array([",".join(sorted(b)) for b in labels], pa.string()),
                    score=pa.array(score, pa.float64()),
                    matches=pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))),
                )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_words, n_base (places of the base phrases), first_word and last_word (their smallest and
    largest start), base_labels, labels, score (the best share of a template found in place) and ``matches``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A null text is empty: no words, no
    labels (empty strings), null places, score 0. Rows are judged one by one, so repeated rows and null ids come back as
    they are. A template is matched only where it lies wholly in its text.
    """
    out = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label: string, first: bigint, last: bigint, share: double>>"
    return ids(docs).mapInArrow(_scanned(word_rarity(docs)), out)
