"""Packing: every id exactly once, cuts no dearer than a full search, little padding."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from brierworks.llm import packing
from brierworks.llm.common import spans

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = sorted(((d is None, d or 0, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in docs), key=str)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    seen = []
    for key, ids in ((w[:2], w[2]) for w in want):
        pieces = [r for r in by_doc[key] if r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())]
        assert sum(r.length for r in pieces) == len(ids) * sum(w[:2] == key and w[2] == ids for w in want)
        seen.append(len(ids))
    assert sum(seen) == sum(r.length for r in rows)
    padded = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        place = 0
        for r in pieces:
            assert r.offset == place
            place += r.length
        assert place <= window
        padded += place if place & (place - 1) == 0 else window
    return padded / sum(seen) - 1


def test_all_kinds_of_text(spark):
    rng = random.Random(3)
    words = "The quick, brown fox! Don't stop... Ünïcode ÉTÉ straße İstanbul J̌ ǰ x1y2 ¿qué? é 日本語 a\xa0b c\x1cd <|endoftext|> 's o'clock ###&&& WH!! ΣΑΣ ﬁ".split(" ")
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3000))).replace("fox! ", "fox!\n")) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \n\t"), (None, "no id"), (None, None), (7, docs[7][1]), (103, "x" * 30000), (104, "word " * 20000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS start", "'s' AS source").coalesce(1)
    assert check(packing.pack(df, PATH).collect(), docs, 4096) < 0.02
    assert check(packing.pack(df, PATH, window=512).collect(), docs, 512) < 0.15


def test_words_are_tokenized_as_in_their_text():
    spec = open(PATH, encoding="utf-8").read()
    words = packing.WordTokens(spec)
    assert words.lower and words.apart and words.direct
    rng = random.Random(1)
    odd = "— … é… é—*** ×*** ÷. a× ’s it’s*** o'clock! 's. a's- x1*** 1*** ***a ***1 日本*** ñ* Ñ* Ł. ǰ. J̌. é. İ* ı. ſ. ß* ẞ* ﬁ* ª. º* µ* ¿a? ¡ «a» a» a\xa0. a\u200b* 😀* ÀÉ|_ Straße, étÉ**".split(" ")
    for _ in range(40):
        text = " ".join(rng.choice(odd) for _ in range(80))
        data = np.frombuffer(text.encode(), np.uint8)
        begin, end, _ = spans(data, np.array([0]))
        got, sizes = words.encode(data, begin, end)
        assert got.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids and sizes.sum() == len(got)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_cuts_are_cheapest():
    rng = random.Random(1)
    for _ in range(150):
        window = rng.choice([16, 32, 64])
        at = [0]
        while len(at) < 40:
            at.append(at[-1] + rng.randint(1, window))
        penalty = [0] + [rng.choice([0, 24, 256]) for _ in at[1:]]

        def cost(i, j):
            size = at[j] - at[i]
            short = size in (window // 2, window // 4, window // 8, window // 16)
            return min(window - size, packing.SHORT_WINDOW if short else window - size) + penalty[j]

        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost(i, j) for i in range(j) if at[j] - at[i] <= window)
        path = packing.cuts(at, penalty, window)
        assert sum(cost(i, j) for i, j in zip(path, path[1:])) == best[-1]
