"""Packing of tokenized documents into fixed windows by order-preserving dynamic programming.

The documents of a scan split form one token stream in stored order. Window cuts are chosen at document ends (free),
sentence ends (a small penalty) or, inside sentences longer than HARD_GAP tokens, every HARD_GAP tokens (a large one),
so that padding plus penalties is smallest. With p the position and f the cost of a cut,

    f[j] = penalty[j] + window - p[j] + min(f[i] + p[i])  over  p[j] - window <= p[i] < p[j],

a sliding minimum that a monotone queue keeps. A window whose length is a power of two needs no padding; those
transitions are tried too. No shuffle: a split ends with at most one padded window, and the stream is solved in
stretches of HORIZON tokens of which the last windows stay open, so memory does not follow the split.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from brierworks.llm.common import byte_table, byte_values, ids, same_spans, span_hashes, spans, text_slices, worker_memory

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 4096
SENTENCE_CUT = 24
HARD_CUT = 256
SHORT_WINDOW = 48
HARD_GAP = 256
HORIZON = 1 << 18
KNOWN_WORDS = 800_000

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: ASCII punctuation without the apostrophe, which tokenizers join with letters.
MARK = byte_table((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))
LETTER = byte_table((65, 90), (97, 122))
#: Lower-case letters without composition, or punctuation: one unit before the tokenizer's merges.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class WordTokens:
    """Token ids of the words of a text, each distinct part of a word tokenized once while it is remembered.

    Valid for tokenizers that drop white space and never join across it. Where the tokenizer also keeps letters and the
    punctuation behind them apart (it is asked), these are looked up separately, and parts of plain letters go straight
    to its model. Equal parts are found by a 64-bit hash within a slice, and their bytes are compared.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their spellings in a text are ordinary text
        ids = self._ids
        self.lower = ids("Ab") == ids("aB") == ids("ab")
        self.apart = self.lower and all(ids(a + b) == ids(a) + ids(b) for a in ("ab", "x1y", "é", "o'c", "Ü") for b in ("***", ".", ",-", "|", "{}", "_"))
        self.direct = self.apart and all(ids(w) == self._model(w) for w in ("the", "of", "éàß", "reünion", "***", ".,", "zzzqx"))
        self.values = byte_values(False)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _model(self, part: str) -> list[int]:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def _learn(self, words: list[bytes]) -> None:
        low = [w.decode().lower() if self.direct else "" for w in words]
        plain = [bool(PLAIN.fullmatch(w)) for w in low]
        hard = iter(self.tokenizer.encode_batch_fast([w.decode() for w, p in zip(words, plain) if not p], add_special_tokens=False))
        found = [self._model(w) if p else next(hard).ids for w, p in zip(low, plain)]
        for k, word in enumerate(words, len(self.rows)):
            self.rows[word] = k
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def _parts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words, those that end with punctuation behind a letter cut in two; and the first part of each word."""
        if not self.apart:
            return begin, end, np.arange(len(begin) + 1)
        place = np.where(MARK[data], 0, np.arange(1, len(data) + 1))
        cut = np.maximum(np.maximum.accumulate(place)[end - 1], begin)  # behind the last byte that is no punctuation
        last, before = data[cut - 1], data[np.maximum(cut - 2, 0)]
        wide = (before == 195) & (last >= 128) & (last < 192) & (last != 151) & (last != 183)  # letters of Latin-1
        split = (cut > begin) & (cut < end) & (LETTER[last] | (wide & (cut - 2 >= begin)))
        first = np.append(0, np.cumsum(1 + split))
        b, e = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        b[first[:-1]], e[first[1:] - 1] = begin, end
        e[first[:-1][split]] = b[first[1:][split] - 1] = cut[split]
        return b, e, first

    def encode(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each word has."""
        if len(self.rows) > KNOWN_WORDS:
            self.forget()
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        begin, end, parts = self._parts(data, begin, end)
        raw = data.tobytes()
        _, first, which = np.unique(span_hashes(data, begin, end, self.values), return_index=True, return_inverse=True)
        if not np.array_equal((end - begin)[first][which], end - begin) or not same_spans(data, begin, begin[first][which], end - begin):
            number: dict[bytes, int] = {}  # two parts share a hash: told apart by their bytes
            which = np.array([number.setdefault(raw[s:e], len(number)) for s, e in zip(begin.tolist(), end.tolist())])
            _, first = np.unique(which, return_index=True)
        words = [raw[s:e] for s, e in zip(begin[first].tolist(), end[first].tolist())]
        if self.lower:
            words = [w.lower() if w.isascii() else w for w in words]
        if fresh := [w for w in dict.fromkeys(words) if w not in self.rows]:
            self._learn(fresh)
        row = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))[which]
        size = self.begin[row + 1] - self.begin[row]
        upto = np.append(0, np.cumsum(size))
        at = np.arange(upto[-1]) + np.repeat(self.begin[row] - upto[:-1], size)
        return self.flat[at], np.diff(upto[parts])


def cuts(at: list[int], penalty: list[int], window: int = WINDOW) -> list[int]:
    """Indices of the cheapest cuts through positions ``at`` (ascending, no gap over ``window``), first and last included."""
    n = len(at)
    best, back, queue = [0] * n, [0] * n, deque([0])
    value = [at[0]] + [0] * (n - 1)
    where = np.array(at)
    exact: dict[int, list[int]] = {}
    size = window // 2
    while size >= window // 16 and size:
        i = np.searchsorted(where, where - size)
        for j in np.flatnonzero((where[i] == where - size) & (where >= where[0] + size)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        size //= 2
    for j in range(1, n):
        p = at[j]
        while p - at[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        cost = value[i] + window - p
        for k in exact.get(j, ()):
            if best[k] + SHORT_WINDOW < cost:
                i, cost = k, best[k] + SHORT_WINDOW
        best[j] = cost = cost + penalty[j]
        back[j] = i
        value[j] = cost = cost + p
        while queue and value[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    path = [n - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def tail_sizes(n: int, window: int) -> list[int]:
    """The lengths into which the last ``n`` <= window tokens go: one padded window, or powers of two if that is cheaper."""
    bits = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return bits if (len(bits) - 1) * HARD_CUT < window - n else [n]


class Stream:
    """The open end of a split's token stream."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.tokens = np.zeros(0, np.uint32)
        self.at, self.penalty = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.docs: list[tuple[int | None, int, int]] = []  # id, begin in the stream (may be negative), tokens

    def add(self, tokens: np.ndarray, at: np.ndarray, penalty: np.ndarray, docs: list[tuple[int | None, int, int]]) -> None:
        base = len(self.tokens)
        self.tokens = np.append(self.tokens, tokens)
        self.at, self.penalty = np.append(self.at, at + base), np.append(self.penalty, penalty)
        self.docs += [(d, b + base, n) for d, b, n in docs]

    def settle(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are decided: all of them if ``last``."""
        n = len(self.tokens)
        if not n:
            return []
        path = cuts([0, *self.at.tolist()], [0, *self.penalty.tolist()], self.window)
        ends = [0, *(int(self.at[k - 1]) for k in path[1:])]
        if last:
            size = ends[-1] - ends[-2]
            parts = tail_sizes(size, self.window)
            ends = ends[:-1] + [ends[-2] + s for s in np.cumsum(parts).tolist()]
        else:
            ends = [x for x in ends if x <= n - 4 * self.window] or [0]
        out, d = [], 0
        for begin, end in zip(ends, ends[1:]):
            place = begin
            while place < end:
                while self.docs[d][1] + self.docs[d][2] <= place:
                    d += 1
                doc, first, size = self.docs[d]
                stop = min(end, first + size)
                crc = zlib.crc32(self.tokens[place:stop].astype("<u4").tobytes())
                out.append((doc, place - first, stop - place, crc, size, self.sequence, place - begin))
                place = stop
            self.sequence += 1
        done = ends[-1]
        self.tokens = self.tokens[done:].copy()
        open_ = self.at > done
        self.at, self.penalty = self.at[open_] - done, self.penalty[open_]
        self.docs = [(x, b - done, m) for x, b, m in self.docs[d:] if b + m > done]
        return out


def _candidates(data, begin, end, first, size, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the texts' tokens (with the closing id), and cut positions with penalties, in the stream of a slice."""
    docs = len(starts)
    upto = np.append(0, np.cumsum(size))
    tokens = upto[first[1:]] - upto[first[:-1]] + 1
    stop = np.cumsum(tokens)
    doc = np.repeat(np.arange(docs), np.diff(first))
    after = upto[1:] + doc  # one closing id for each earlier text
    breaks = np.append(0, np.cumsum(data == 10))
    next_ = np.append(begin[1:], len(data))
    mark = data[end - 1]
    sentence = (mark == 46) | (mark == 33) | (mark == 63) | (breaks[next_] > breaks[end]) if len(end) else np.zeros(0, bool)
    at = np.concatenate([stop, after[sentence]])
    penalty = np.concatenate([np.zeros(docs, np.int64), np.full(int(sentence.sum()), SENTENCE_CUT)])
    order = np.lexsort((penalty, at))
    at, penalty = at[order], penalty[order]
    keep = np.append(True, np.diff(at) > 0) & (at > 0)
    at, penalty = at[keep], penalty[keep]
    gap = np.diff(np.append(0, at))
    wide = np.flatnonzero(gap > HARD_GAP)
    if len(wide):
        times = (gap[wide] - 1) // HARD_GAP
        base = np.repeat(at[wide] - gap[wide], times)
        hard = base + HARD_GAP * (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + 1)
        at, penalty = np.append(at, hard), np.append(penalty, np.full(len(hard), HARD_CUT))
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    return tokens, at, penalty


def _with_closing(tokens: np.ndarray, counts: np.ndarray, closing: int) -> np.ndarray:
    return np.insert(tokens, np.cumsum(counts - 1), closing)


def _packed(spec, closing: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory()
        if memory.get("tokenizer") != spec.value:
            memory["tokenizer"], memory["words"] = spec.value, WordTokens(spec.value)
        words: WordTokens = memory["words"]
        stream = Stream(window, TaskContext.get().partitionId() << 32)

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = zip(*pieces) if pieces else [[]] * 7
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_pydict({n: pa.array(list(c), pa.int64()) for n, c in zip(names, columns)})

        for batch in batches:
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for i, j, data, starts, _ in text_slices(batch):
                begin, end, first = spans(data, starts)
                tokens, size = words.encode(data, begin, end)
                counts, at, penalty = _candidates(data, begin, end, first, size, starts)
                stops = np.cumsum(counts)
                stream.add(_with_closing(tokens, counts, closing), at, penalty, list(zip(doc_ids[i:j], (stops - counts).tolist(), counts.tolist())))
                if len(stream.tokens) >= HORIZON:
                    yield rows(stream.settle(False))
        yield rows(stream.settle(True))

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, closing: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    ``tokenizer`` is the file of a word tokenizer (see :class:`WordTokens`); the driver reads it and sends it along. A
    document is its ids and ``closing``; a null, empty or blank text is the closing id alone. Rows are packed in stored
    order whatever their ids, so null and repeated ids and repeated rows each have their own pieces. A sequence holds at
    most ``window`` tokens. ``sequence_id`` is unique and rises along a split.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    return ids(docs).mapInArrow(_packed(spec, closing, window), PIECES)
