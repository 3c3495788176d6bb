"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters are word lists and patterns fixed here, and words and word beginnings that stand out in a bounded sample of labelled
rows. A voter fires or abstains. The label model takes how often voters fire, alone and in pairs, over all documents; the
pairs' covariances are a product of the two voters' accuracies wherever the voters depend on the class alone, so they
give the accuracies (labelled rows start and steady the fit), and pairs that deviate are correlated: voters of a correlated
group count less, as what they say is partly the same. Its posterior labels train a logistic regression on single terms,
which scores every document.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from brierworks.llm.common import ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_PER_LABEL = 2500
MAX_TERMS = 1024
MIN_Z = 5.0  # how far a term must stand out in the sample, in standard errors
STARTS = (4, 5, 6, 7)  # lengths of word beginnings
OFTEN = 100  # a frequent beginning has one of so many words
TERM_VOTERS = 40  # single terms that vote
LISTS = 4  # further terms vote in so many lists
COVER = 2  # voters wanted for each toxic sample row
DEPENDENT = 0.1  # correlation beyond what the class explains
GOLD = 0.99  # accuracy of a given label
PRIOR = 0.1  # share of toxic documents where no label is known

WORDS = re.compile(r"[^\W\d_]+")

#: Word lists that vote for toxicity; the last one against it.
LEXICONS = {
    "insults": "idiot idiots moron morons stupid dumb fool imbecile loser losers jerk clown dimwit",
    "contempt": "pathetic worthless disgusting trash garbage scum filth vermin parasite useless",
    "threats": "kill die hurt destroy punch strangle burn shoot stab",
    "german": "idiot dummkopf arschloch blöd blödmann trottel abschaum widerlich wertlos versager",
    "french": "idiot imbécile crétin connard salaud stupide débile ordure dégoûtant minable",
    "spanish": "idiota imbécil estúpido estúpida basura asqueroso asquerosa escoria inútil payaso",
    "courtesy": "please thanks thank welcome bitte danke merci gracias",
}
ADDRESSES = ("you are", "you're", "you all", "du bist", "ihr seid", "tu es", "vous êtes", "eres ")
MASKED = re.compile(r"[^\W\d_][*@$#]+[^\W\d_]")
PATTERNS = ("address", "shouting", "exclaims", "asks", "masked")


def patterns(text: str, low: str) -> list[int]:
    """The patterns a text shows."""
    shown = (
        any(a in low for a in ADDRESSES),
        low != text and text == text.upper(),
        "!!" in text,
        "??" in text,
        any(c in text for c in "*@$#") and MASKED.search(text) is not None,
    )
    return [k for k, s in enumerate(shown) if s]


def starts_of(words: Counter) -> Counter:
    """How often words begin with each of their first few letters."""
    out: Counter = Counter()
    for w, n in words.items():
        for k in STARTS:
            if len(w) >= k:
                out[w[:k]] += n
    return out


def levels(n: int, words: int) -> list[str]:
    """What a word beginning that occurs ``n`` times among ``words`` says: it occurs, repeatedly, often."""
    return ["*"] + ["**"] * (n > 1) + ["%"] * (n > 1 and n * OFTEN >= words)


def terms_of(low: str) -> set[str]:
    """Words of a lower-cased text, and word beginnings with a star (two if repeated) or a percent sign (if frequent)."""
    words = Counter(WORDS.findall(low))
    total = words.total()
    return set(words) | {w + level for w, n in starts_of(words).items() for level in levels(n, total)}


class Terms(NamedTuple):
    """Where the terms stand among the columns: patterns first, then fixed lists, then terms of the sample."""

    words: dict[str, list[int]]
    starts: dict[int, dict[str, dict[str, int]]]
    names: list[str]

    @classmethod
    def of(cls, terms: list[str]) -> Terms:
        names = [*PATTERNS, *LEXICONS, *terms]
        words: dict[str, list[int]] = {}
        for k, lexicon in enumerate(LEXICONS.values(), len(PATTERNS)):
            for w in lexicon.split():
                words.setdefault(w, []).append(k)
        starts: dict[int, dict[str, dict[str, int]]] = {}
        for k, term in enumerate(terms, len(PATTERNS) + len(LEXICONS)):
            plain = term.rstrip("*%")
            if plain == term:
                words.setdefault(term, []).append(k)
            else:
                starts.setdefault(len(plain), {}).setdefault(plain, {})[term[len(plain) :]] = k
        return cls(words, starts, names)

    def found(self, text: str | None) -> list[int]:
        """The columns that a text has."""
        if not text:
            return []
        low = text.lower()
        out = set(patterns(text, low))
        counts = Counter(WORDS.findall(low))
        words, starts, begun = self.words, tuple(self.starts.items()), Counter()
        for w, n in counts.items():
            if w in words:
                out.update(words[w])
            for k, table in starts:
                if w[:k] in table and len(w) >= k:
                    begun[w[:k]] += n
        total = counts.total()
        for w, n in begun.items():
            table = self.starts[len(w)][w]
            out.update(table[level] for level in levels(n, total) if level in table)
        return sorted(out)


class Voters(NamedTuple):
    """Each voter's columns; it fires if a text has one of them."""

    columns: list[list[int]]

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([rows[:, c].any(axis=1) for c in self.columns], axis=1).astype(np.float64) if len(rows) else np.zeros((0, len(self.columns)))


def matrix(found: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(found), width), bool)
    for row, columns in zip(out, found):
        row[columns] = True
    return out


def choose_voters(rows: np.ndarray, toxic: np.ndarray) -> Voters:
    """Every pattern and list; then terms that cover toxic rows not yet covered often enough; the other terms in lists."""
    fixed = len(PATTERNS) + len(LEXICONS)
    columns = [[k] for k in range(fixed)]
    if not len(rows):
        return Voters(columns)
    hits, misses = rows[toxic == 1, fixed:].astype(np.float64), rows[toxic == 0, fixed:].sum(axis=0)
    share = rows[:, fixed:][toxic == 1].mean(axis=0) - rows[:, fixed:][toxic == 0].mean(axis=0)
    need, open_ = np.full(len(hits), float(COVER)), share > 0
    while len(columns) < fixed + TERM_VOTERS and open_.any():
        gain = np.where(open_, (np.minimum(need, 1) @ hits) - 2 * misses, -np.inf)
        k = int(gain.argmax())
        if gain[k] < max(2, len(hits) / 500):
            break
        columns.append([fixed + k])
        open_[k] = False
        need = np.maximum(need - hits[:, k], 0)
    left = fixed + np.flatnonzero(open_)
    columns += [left[k::LISTS].tolist() for k in range(LISTS) if len(left[k::LISTS])]
    against = fixed + np.flatnonzero(share < 0)
    return Voters(columns + ([against.tolist()] if len(against) else []))


class LabelModel(NamedTuple):
    """How often each voter fires among toxic and other documents, and how much of its say is its own."""

    prior: float
    toxic: np.ndarray
    other: np.ndarray
    weight: np.ndarray
    correlated: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        fires, silent = np.log(self.toxic / self.other), np.log((1 - self.toxic) / (1 - self.other))
        return np.log(self.prior / (1 - self.prior)) + votes @ (fires * self.weight) + (1 - votes) @ (silent * self.weight)


def fit_label_model(n: int, pairs: np.ndarray, prior: float, start: np.ndarray, trust: float, rounds: int = 50) -> LabelModel:
    """Accuracies and correlations from ``pairs``, how many of ``n`` documents each pair of voters fires in together
    (on the diagonal each voter alone).

    ``start`` is the difference of each voter's rate between toxic and other documents as labelled rows show it, and
    ``trust`` how many documents that is worth. The covariance of two voters that depend on the class alone is
    prior (1 - prior) times both differences. Pairs whose correlation departs from that by DEPENDENT or more are correlated
    and left out of the fit.
    """
    rate = np.diag(pairs) / max(n, 1)
    cov = pairs / max(n, 1) - np.outer(rate, rate)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    scale, room = prior * (1 - prior), 1e-4
    low, high = -(1 - rate) / max(prior, room), rate / max(prior, room)  # keeps both rates between zero and one
    off = ~np.eye(len(rate), dtype=bool)
    diff, correlated = start.copy(), np.zeros_like(off)
    pull = trust / (trust + max(n, 1))
    for _ in range(rounds):
        correlated = off & (np.abs(cov - scale * np.outer(diff, diff)) >= DEPENDENT * np.outer(spread, spread))
        free = off & ~correlated
        power = scale * (free @ (diff * diff))
        fitted = np.where(power > 1e-9, (np.where(free, cov, 0) @ diff) / np.maximum(power, 1e-9), diff)
        new = np.clip(pull * start + (1 - pull) * fitted, low, high)
        if np.abs(new - diff).max(initial=0) < 1e-9:
            break
        diff = 0.5 * (diff + new)
    toxic, other = (np.clip(r, room, 1 - room) for r in (rate + (1 - prior) * diff, rate - prior * diff))
    rest = np.abs(cov - scale * np.outer(diff, diff)) / np.outer(spread, spread)
    return LabelModel(prior, toxic, other, 1 / (1 + np.where(correlated, np.minimum(rest, 1), 0).sum(axis=1)), correlated)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression with soft targets, the last one for the constant (Newton steps)."""
    x = np.hstack([rows.astype(np.float64), np.ones((len(rows), 1))])
    penalty = np.append(np.full(rows.shape[1], ridge), 1e-3)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - target)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of labelled texts."""
    for batch in batches:
        toxic = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
        for label, text in zip(toxic, batch.column(batch.schema.get_field_index("text"))):
            terms = sorted(terms_of((text.as_py() or "").lower()))
            for k in range(0, len(terms), 1 << 16):
                part = terms[k : k + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "toxic": pa.array([label] * len(part), pa.int32())})


def _columns(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(*sent.value)  # broadcasts hold plain tuples, which any worker can read
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [terms.found(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    return run


def _pair_counts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, voters = Terms(*sent.value[0]), Voters(*sent.value[1])
        counts, n = np.zeros((len(voters.columns),) * 2), 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [terms.found(t.as_py()) for t in texts]
            votes = voters.of_rows(matrix(found, len(terms.names)))
            counts += votes.T @ votes
            n += len(found)
        i, j = np.nonzero(np.triu(counts))
        total = counts[i, j].astype(np.int64)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i, -1), pa.int32()), "j": pa.array(np.append(j, -1), pa.int32()), "n": pa.array(np.append(total, n), pa.int64())})

    return run


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = Terms(*sent.value[0]), sent.value[1]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            margin = [weights[-1] + weights[terms.found(t.as_py())].sum() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sigmoid(np.array(margin, np.float64)), pa.float64())], names=["doc_id", "score"])

    return run


def crc_mod(n: int, key: str = "doc_id") -> Column:
    """crc32 of the id's text modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def standing_out(spelled: DataFrame, n_toxic: int, n_other: int, limit: int = MAX_TERMS, z: float = MIN_Z) -> list[str]:
    """The terms whose share of toxic rows differs most from their share of others, by ``z`` standard errors at least."""
    counts = spelled.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    both = (F.col("a") + F.col("b")) / float(n_toxic + n_other)
    error = F.sqrt(both * (1 - both) * (1.0 / n_toxic + 1.0 / n_other))
    far = F.abs(F.col("a") / float(n_toxic) - F.col("b") / float(n_other)) / F.greatest(error, F.lit(1e-12))
    rows = counts.select("term", far.alias("z")).where(F.col("z") >= z).orderBy(F.desc("z"), "term").limit(limit).collect()
    return [r["term"] for r in rows]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL, seed: int = 0) -> tuple[Terms, np.ndarray]:
    """The terms and their weights in the classifier. ``docs`` are all documents (the label model's counts cover them);
    ``labels`` (doc_id, toxic) are those that may teach."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample / max(1, counts.get(0, 0))))
    chosen = F.broadcast(known.where(lot < share))  # about 2 x sample rows of two numbers, whatever the tables hold
    texts = ids(docs)
    picked = texts.where("text is not null").join(chosen, "doc_id").select("text", "toxic")
    drawn = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    terms = Terms.of(standing_out(picked.mapInArrow(_spelled, "term string, toxic int"), drawn[1], drawn[0]) if len(drawn) == 2 else [])
    rows = picked.mapInArrow(_columns(spark.sparkContext.broadcast(tuple(terms))), "toxic int, found array<int>").collect()
    rows = sorted((r["toxic"], list(r["found"])) for r in rows)  # at most about 2 x sample rows of MAX_TERMS numbers
    toxic, x = np.array([t for t, _ in rows], np.int64), matrix([f for _, f in rows], len(terms.names))
    both = len(drawn) == 2
    voters = choose_voters(x, toxic) if both else choose_voters(x[:0], toxic[:0])
    sums = texts.select("text").mapInArrow(_pair_counts(spark.sparkContext.broadcast((tuple(terms), tuple(voters)))), "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    pairs, n = np.zeros((len(voters.columns),) * 2), 0
    for r in sums:
        if r["i"] < 0:
            n = r["n"]
        else:
            pairs[r["i"], r["j"]] = pairs[r["j"], r["i"]] = r["n"]
    votes = voters.of_rows(x)
    if both:
        prior = float(np.clip(counts[1] / (counts[0] + counts[1]), 0.001, 0.999))
        start = votes[toxic == 1].mean(axis=0) - votes[toxic == 0].mean(axis=0)
    else:  # nothing is known of the class: lists vote as their names say, patterns hardly
        prior = PRIOR
        rate = np.diag(pairs) / max(n, 1)
        lean = np.array([0.1] * len(PATTERNS) + [0.9] * (len(LEXICONS) - 1) + [-0.5])
        start = rate * lean / np.where(lean > 0, prior, 1)
    model = fit_label_model(n, pairs, prior, start, float(len(rows)))
    if not both:
        weights = np.log(model.toxic / model.other) * model.weight
        return terms, np.append(weights, np.log(prior / (1 - prior)))
    gold = np.log(GOLD / (1 - GOLD))
    posterior = sigmoid(model.log_odds(votes) + np.where(toxic == 1, gold, -gold))
    balance = np.where(toxic == 1, prior / drawn[1], (1 - prior) / drawn[0]) * len(toxic)
    return terms, fit_linear(x, posterior, balance)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL, threshold: float = 0.5, seed: int = 0) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold``), one row per document row.

    ``labels`` has doc_id and toxic; rows whose crc32 of the id modulo 5 is 0 are held out. At most about ``sample`` rows of
    each label are learned from, chosen by a hash of the id; the label model's counts cover all documents. Labels that are
    neither 0 nor 1 and null ids teach nothing; a document that is labelled twice teaches twice. Without labelled rows of
    both kinds the fixed lists and patterns decide. Only the text is an input of a score; null and empty texts show no
    term and score the constant of the classifier, which follows the share of toxic labels.
    """
    terms, weights = learn(docs, labels.where(crc_mod(5) != 0), sample, seed)
    sent = docs.sparkSession.sparkContext.broadcast((tuple(terms), weights))
    scored = ids(docs).mapInArrow(_scored(sent), "doc_id bigint, score double")
    return scored.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
