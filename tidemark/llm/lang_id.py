"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of one fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, computed by the forward algorithm; a text's is the
product over its words. The distributions are learned by expectation-maximisation on the table of
(language, word, count) over all training documents: the expected number of times each piece is used,
from the forward-backward algorithm, gives the next distribution.

Words are runs of letters (Unicode category L) of the lower-cased text, whole, each behind the vocabulary's
word mark. A character outside the vocabulary is a piece of its own with probability UNKNOWN in every
language. Words of up to BATCHED letters go through the algorithm in groups of one length; longer ones one
by one, in logarithms and a window of the longest piece, so that no probability underflows.

Only word counts are shuffled. What is broadcast, and what a job returns to the driver, is one number for
each piece of the vocabulary (fixed) and language (as many as the training rows name).

Defined results: ``und`` with score 0 for a null text or one without letters; rows without a language
teach nothing, and so do rows without a doc_id, whose held_out is null; with no training rows every text
is ``und``; repeated rows are predicted each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, fold

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
BATCHED = 32
UNKNOWN = 1e-7
ROUNDS, SMOOTH = 2, 0.1
CELLS = 3_000_000
SCALE = 1e7
_WORD = re.compile(r"[^\W\d_]+")
_K = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # Signs that count as word characters without being letters, such as fractions, part words.
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split(" ") if w]


class Vocabulary:
    """Pieces by a hash of their code points; look-ups compare the whole hash."""

    BITS = 20

    def __init__(self, name: str = VOCABULARY):
        import os

        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=name if os.sep in name else public_tokenizers.path(name))
        pieces = sorted({p for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for p in [sp.id_to_piece(i)]})
        self.size, self.longest = len(pieces), max(map(len, pieces))
        #: Code points of each piece, of an unknown character, and of no piece.
        self.lengths = np.array([*map(len, pieces), 1, 0], float)
        h = np.array([self.hash_one(p) for p in pieces], np.uint64)
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.ids = np.full(1 << self.BITS, -1, np.int32)
        mask = (1 << self.BITS) - 1
        for i, k in enumerate(h.tolist()):
            at = k & mask
            while self.ids[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.ids[at] = k, i
        #: How far a look-up has to walk at most.
        self.walk = 1 + max((int(at) - (int(self.keys[at]) & mask)) % (mask + 1) for at in np.flatnonzero(self.ids >= 0))

    @staticmethod
    def hash_one(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = Vocabulary.extend(h, np.array([ord(c)], np.uint64))
        return int(Vocabulary.final(h)[0])

    @staticmethod
    def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c + np.uint64(1)) * _K

    @staticmethod
    def final(h: np.ndarray) -> np.ndarray:
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        h = self.final(h)
        mask = np.uint64((1 << self.BITS) - 1)
        at = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        for _ in range(self.walk):
            hit = self.keys[at] == h
            out[hit] = self.ids[at[hit]]
            at = (at + 1) & int(mask)
        return out

    def spans(self, group: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
        """For words of one length: (start, end) -> id of the piece there (-1: none; size: an unknown character)."""
        n = len(group[0]) + 1
        codes = np.empty((len(group), n), np.uint64)
        codes[:, 0] = ord(MARK)
        codes[:, 1:] = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), n - 1)
        out = {}
        for s in range(n):
            h = np.zeros(len(group), np.uint64)
            for e in range(s + 1, min(n, s + self.longest) + 1):
                h = self.extend(h, codes[:, e - 1])
                ids = self.find(h)
                if e == s + 1:
                    ids[ids < 0] = self.size
                out[s, e] = ids
        return n, out

    def pieces_of(self, word: str) -> np.ndarray:
        """[length - 1, start]: the same for one word of any length (past its end: -1)."""
        codes = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out, h = np.full((self.longest, len(codes)), -1, np.int32), np.zeros(len(codes), np.uint64)
        for k in range(min(self.longest, len(codes))):
            h = self.extend(h[: len(codes) - k], codes[k:])
            out[k, : len(h)] = self.find(h)
        out[0][out[0] < 0] = self.size
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    if name not in _VOCABULARIES:
        _VOCABULARIES[name] = Vocabulary(name)
    return _VOCABULARIES[name]


def _by_length(found: list[str], languages: int):
    """Places and words of one length, as many at a time as CELLS numbers allow; long ones are left out."""
    groups = defaultdict(list)
    for i, w in enumerate(found):
        if len(w) <= BATCHED:
            groups[len(w)].append(i)
    for n, at in groups.items():
        size = max(1, CELLS // ((n + 2) * languages))
        for k in range(0, len(at), size):
            part = at[k : k + size]
            yield np.array(part), [found[i] for i in part]


def _long_forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of a long word's probability by language. ids: [length - 1, start]; p has a row of zeros at -1.

    The window holds the sums for the last places, the nearest first, scaled by what ``scale`` remembers.
    """
    longest, n = ids.shape
    window, scale = np.zeros((longest, p.shape[1])), np.zeros(p.shape[1])
    window[0] = 1
    lengths = np.arange(longest)
    for e in range(1, n + 1):
        k = lengths[: min(longest, e)]
        a = (window[: len(k)] * p[ids[k, e - 1 - k]]).sum(0)
        window[1:] = window[:-1]
        window[0] = a
        window /= a
        scale += np.log(a)
    return scale


def _scaled(p: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Piece probabilities times SCALE for each code point, and a row of zeros for no piece: products over a word of
    up to BATCHED letters stay among doubles down to piece probabilities of 1e-16."""
    return np.vstack([p, np.zeros(p.shape[1])]) * (SCALE**vocab.lengths)[:, None]


def word_log_probs(found: list[str], vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability by language. p: (pieces + 1) x languages."""
    q = _scaled(p, vocab)
    p = np.vstack([p, np.zeros(p.shape[1])])  # -1: no piece
    out = np.empty((len(found), p.shape[1]))
    for at, group in _by_length(found, p.shape[1]):
        n, spans = vocab.spans(group)
        alpha = [np.ones((len(group), p.shape[1]))]
        for e in range(1, n + 1):
            a = np.zeros_like(alpha[0])
            for s in range(max(0, e - vocab.longest), e):
                a += alpha[s] * q[spans[s, e]]
            alpha.append(a)
        out[at] = np.log(alpha[n]) - n * np.log(SCALE)
    for i, w in enumerate(found):
        if len(w) > BATCHED:
            out[i] = _long_forward(vocab.pieces_of(w), p)
    return out


def _long_expected(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[length - 1, start]: how often a long word is expected to use the piece there, in one language (q: its probabilities)."""
    longest, n = ids.shape
    with np.errstate(divide="ignore"):
        use = np.log(q[ids])
    ahead, back, lengths = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), np.arange(longest)
    ahead[0] = back[n] = 0
    for e in range(1, n + 1):
        k = lengths[: min(longest, e)]
        ahead[e] = np.logaddexp.reduce(ahead[e - 1 - k] + use[k, e - 1 - k])
    for s in range(n - 1, -1, -1):
        k = lengths[: min(longest, n - s)]
        back[s] = np.logaddexp.reduce(back[s + 1 + k] + use[k, s])
    out = np.zeros(ids.shape)
    for k in range(min(longest, n)):
        s = np.arange(n - k)
        out[k, s] = np.exp(ahead[s] + use[k, s] + back[s + k + 1] - ahead[n])
    return out


def _expected(vocab: Vocabulary, p: np.ndarray):
    """Expected uses of each piece by language over the task's (lang, word, n) rows."""

    def run(batches):
        q, plain = _scaled(p, vocab), np.vstack([p, np.zeros(p.shape[1])])
        total = np.zeros(q.shape)
        for b in batches:
            lang, found, count = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for at, group in _by_length(found, 16):
                l, c = lang[at], count[at].astype(float)
                n, spans = vocab.spans(group)
                use = {k: q[i, l] for k, i in spans.items()}
                alpha, beta = [np.ones(len(at))], {n: np.ones(len(at))}
                for e in range(1, n + 1):
                    alpha.append(sum(alpha[s] * use[s, e] for s in range(max(0, e - vocab.longest), e)))
                for s in range(n - 1, -1, -1):
                    beta[s] = sum(beta[e] * use[s, e] for e in range(s + 1, min(n, s + vocab.longest) + 1))
                for (s, e), ids in spans.items():
                    x = c * alpha[s] * use[s, e] * beta[e] / alpha[n]
                    some = np.flatnonzero(ids >= 0)
                    total += np.bincount(ids[some] * q.shape[1] + l[some], x[some], total.size).reshape(total.shape) if len(some) > 50_000 else 0
                    if len(some) <= 50_000:
                        np.add.at(total, (ids[some], l[some]), x[some])
            for i, w in enumerate(found):
                if len(w) > BATCHED:
                    ids = vocab.pieces_of(w)
                    x = _long_expected(ids, plain[:, lang[i]])
                    np.add.at(total[:, lang[i]], ids[ids >= 0], count[i] * x[ids >= 0])
        piece, lang = np.nonzero(total[: vocab.size])
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "x"])

    return run


def _counted(langs: dict[str, int]):
    def run(batches):
        seen: dict[int, Counter] = defaultdict(Counter)

        def out():
            for l, c in seen.items():
                keys = list(c)
                for k in range(0, len(keys), 100_000):
                    part = keys[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(part), pa.int32()), pa.array(part, pa.string()), pa.array([c[w] for w in part], pa.int64())], ["lang", "word", "n"])
            seen.clear()

        for b in batches:
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[langs[l]].update(words(t))
            if sum(map(len, seen.values())) > 1_000_000:
                yield from out()
        yield from out()

    return run


class Model:
    def __init__(self, langs: list[str], p: np.ndarray, prior: np.ndarray, vocabulary_name: str):
        self.langs, self.p, self.prior, self.name = langs, p, prior, vocabulary_name
        self._cache, self._rows = None, None

    #: Words remembered, in numbers by language.
    LIMIT = 1_600_000

    def __getstate__(self):
        return self.__dict__ | {"_cache": None, "_rows": None}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self._cache is None or len(self._cache) * len(self.langs) > self.LIMIT:
            self._cache, self._rows = {}, np.empty((4_096, len(self.langs)))
        found = [words(t) for t in texts]
        new = list(set().union(*found) - self._cache.keys()) if self.langs else []
        if new:
            used = len(self._cache)
            if used + len(new) > len(self._rows):
                self._rows = np.concatenate([self._rows[:used], np.empty((used + 2 * len(new), len(self.langs)))])
            self._rows[used : used + len(new)] = word_log_probs(new, vocabulary(self.name), self.p)
            self._cache.update(zip(new, range(used, used + len(new))))
        out = []
        for w in found:
            if not w or not self.langs:
                out.append(("und", 0.0))
                continue
            total = self._rows[np.fromiter(map(self._cache.__getitem__, w), np.int64, len(w))].sum(0) + self.prior
            e = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((self.langs[best], float(e[best] / e.sum())))
        return out


def fit(docs: DataFrame, vocabulary_name: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Learn from every row of text and lang whose lang is not null."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = docs.where("lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    share = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(share)
    vocab = vocabulary(vocabulary_name)
    p = np.full((vocab.size + 1, len(langs)), 1.0 / vocab.size)
    p[-1] = UNKNOWN
    if langs:
        table = src.mapInArrow(_counted({l: i for i, l in enumerate(langs)}), "lang int, word string, n long")
        table = scratch.put(table.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(p)

            def expect(batches, shared=shared):
                yield from _expected(vocabulary(vocabulary_name), shared.value)(batches)

            # One row a piece and language, as many as the vocabulary allows.
            rows = table.mapInArrow(expect, "piece int, lang int, x double").groupBy("piece", "lang").agg(F.sum("x").alias("x")).toPandas()
            e = np.full((vocab.size, len(langs)), SMOOTH)
            np.add.at(e, (rows["piece"].to_numpy(), rows["lang"].to_numpy()), rows["x"].to_numpy())
            p[:-1] = e / e.sum(0)
        scratch.drop(table)
    n = np.array([share[l] for l in langs], float)
    return Model(langs, p, np.log(n / n.sum()) if langs else n, vocabulary_name)


def predict(text: str | Column, model: Model, spark) -> Column:
    """struct(lang_pred, score) for a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            rows, s = [], s.tolist()
            for k in range(0, len(s), 500):
                rows += shared.value.predict(s[k : k + 500])
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predicted(text)


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose crc32(doc_id) mod folds is not ``held``."""
    model = fit(docs.where(fold("doc_id", folds) != held))
    out = docs.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), predict("text", model, docs.sparkSession).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
