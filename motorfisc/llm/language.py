"""Language identification by unigram pieces with all segmentations summed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.llm.common import bounded_sample, crc_mod, free_names, shielded, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Documents that the model is fitted on at most: those of the least hashes of doc_id among the labelled ones.
TRAIN_ROWS = 3000
ROUNDS = 3
#: Least probability of a piece.
FLOOR = 1e-8
#: After so many letters the sums of a word are scaled anew, which keeps them within the range of doubles.
_RESCALE = 8
#: Letters of the words whose lattices are held at once.
_BATCH = 1 << 16
UNDECIDED = "und"
_LETTERS = regex.compile(r"\p{L}+").findall
_MARK = "▁"
_KEPT = 200_000
_HELD = 500_000


@cache
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the vocabulary's pieces of letters (word starts marked), sorted, and the piece that each stands for."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sorted({p.lower() for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) and p.strip(_MARK).isalpha() and p.rfind(_MARK) <= 0})
    hashes = np.array([_hash_of(p) for p in found], dtype=np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@cache
def _longest(path: str) -> int:
    """Letters of the longest piece, its mark included."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return max((len(p) for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)).strip(_MARK).isalpha()), default=1)


class _Lattice:
    """Pieces in a batch of words of one length: ``ids[l - 1][:, i]`` is the piece of l letters that starts at i, or none."""

    def __init__(self, words: list[str], path: str) -> None:
        hashes, order = _pieces(path)
        self.length, self.none = len(words[0]), len(order)
        self.longest = min(_longest(path), self.length)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), self.length).astype(np.uint64) + np.uint64(1)
        self.ids = []
        rolling = np.zeros((len(words), self.length), dtype=np.uint64)
        for size in range(1, self.longest + 1):
            rolling = rolling[:, : self.length - size + 1] * np.uint64(0x100000001B3) + codes[:, size - 1 :]
            at = np.minimum(np.searchsorted(hashes, rolling), len(hashes) - 1)
            ids = np.where(hashes[at] == rolling, order[at], self.none)
            # a single letter that is no piece is a piece of its own kind
            self.ids.append(np.where(ids == self.none, self.none + 1, ids) if size == 1 else ids)
        self.some = [(ids != self.none).any(axis=0) for ids in self.ids]

    def _sums(self, p: np.ndarray, pieces: Callable[[int], list[tuple[int, np.ndarray]]]) -> list[np.ndarray]:
        """Log sums of 0, 1, ... letters; ``pieces`` lists those that make up the nth: letters before it, piece ids.

        Sums are kept as multiples of a scale that is set anew every _RESCALE letters, to the sum reached, so that
        words of any length stay within the range of doubles.
        """
        sums, scale = [np.ones((len(self.ids[0]), p.shape[1]))], 0.0
        logs = [np.zeros_like(sums[0])]
        for n in range(1, self.length + 1):
            sums.append(sum(sums[-back] * p[ids] for back, ids in pieces(n)))
            logs.append(np.log(sums[-1]) + scale)
            if n % _RESCALE == 0:
                scale = logs[-1]
                sums = [s / sums[-1] for s in sums[-self.longest :]]
        return logs

    def forward(self, probabilities: np.ndarray) -> list[np.ndarray]:
        """probabilities (pieces + none + other letter, languages) -> log of each prefix, summed over its segmentations."""
        return self._sums(probabilities, lambda end: [(n, self.ids[n - 1][:, end - n]) for n in range(1, min(self.longest, end) + 1) if self.some[n - 1][end - n]])

    def backward(self, probabilities: np.ndarray) -> list[np.ndarray]:
        """The same of each suffix, in the order of where it starts."""
        first = lambda n: self.length - n
        return self._sums(probabilities, lambda n: [(size, self.ids[size - 1][:, first(n)]) for size in range(1, min(self.longest, n) + 1) if self.some[size - 1][first(n)]])[::-1]


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of the words, in batches of one length and of about _BATCH letters."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths):
        same, most = np.flatnonzero(lengths == n), max(1, _BATCH // int(n))
        for at in range(0, len(same), most):
            yield same[at : at + most]


@dataclass
class SegmentModel:
    """Piece probabilities of each language: ``probabilities`` (pieces + none + other letter, languages)."""

    languages: list[str]
    probabilities: np.ndarray
    path: str
    known: dict[str, int] = field(default_factory=dict)
    scores: list[np.ndarray] = field(default_factory=list)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all its segmentations."""
        marked = [_MARK + w for w in words]
        out = np.zeros((len(words), len(self.languages)))
        for rows in _by_length(marked):
            out[rows] = _Lattice([marked[i] for i in rows], self.path).forward(self.probabilities)[-1]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [_LETTERS(t.lower()) if t else [] for t in texts]
        new = list(set().union(*words) - self.known.keys())
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores.append(self.word_scores(new))
        scores = self.scores[0] if len(self.scores) == 1 else np.concatenate([np.zeros((0, len(self.languages))), *self.scores])
        self.scores = [scores]
        labels, best = [], np.zeros(len(texts))
        for i, ws in enumerate(words):
            if not ws or not self.languages:
                labels.append(UNDECIDED)
                continue
            total = scores[[self.known[w] for w in ws]].sum(axis=0)
            posterior = np.exp(total - total.max())
            posterior /= posterior.sum()
            labels.append(self.languages[int(posterior.argmax())])
            best[i] = posterior.max()
        if len(self.known) > _KEPT:
            self.known, self.scores = {}, []
        return labels, best


def fit(counts: pd.DataFrame, path: str = VOCABULARY) -> SegmentModel:
    """(lang, word, n) -> model, by expectation maximisation over segmentations, in rows sorted by language and word."""
    counts = counts.sort_values(["lang", "word"], ignore_index=True)
    languages = sorted(counts["lang"].unique())
    size = len(_pieces(path)[1]) + 2
    out = np.zeros((size, len(languages)))
    for column, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        parts, weights = [_MARK + word for word in own["word"]], own["n"].to_numpy(dtype=float)
        lattices = [(weights[rows], _Lattice([parts[i] for i in rows], path)) for rows in _by_length(parts)]
        p = np.full((size, 1), 1.0 / size)
        for _ in range(ROUNDS + 1):
            p[size - 2] = 0
            expected = np.zeros(size)
            for w, lattice in lattices:
                alpha, beta = lattice.forward(p), lattice.backward(p)
                for n, ids in enumerate(lattice.ids, 1):
                    for start in np.flatnonzero(lattice.some[n - 1]):
                        share = w * p[ids[:, start], 0] * np.exp(alpha[start][:, 0] + beta[start + n][:, 0] - alpha[-1][:, 0])
                        expected += np.bincount(ids[:, start], share, minlength=size)
            p = np.maximum((expected / expected.sum())[:, None], FLOOR)
        p[size - 2] = 0
        out[:, column] = p[:, 0]
    return SegmentModel(list(languages), out, path)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, path: str = VOCABULARY) -> SegmentModel:
    """Fits on (text, lang, doc_id) rows with a lang: ``rows`` of them at most, words counted on the executors.

    One row is taken for each doc_id, and one for each text of the rows without a doc_id. Without such rows nothing is
    learned: the model has no language.
    """
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("own")
    labelled = docs.where("lang is not null and text is not null").select("doc_id", own, "lang", "text")
    chosen = bounded_sample(labelled, rows, "language", "doc_id", "own")
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return fit(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).toPandas(), path)


def identify(docs: DataFrame, model: SegmentModel) -> DataFrame:
    """``docs`` with lang_pred and score added (columns of those names are replaced).

    The score is the posterior of the predicted language under equal priors. A text that is null or has no letter is
    ``und`` with score 0, as is every text if nothing was learned. Ties go to the first language in order. Only the
    text is looked at; it is scored whole. Repeated rows get the same prediction; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.probabilities, model.path))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = SegmentModel(*shared.value)
        for part in parts:
            labels, scores, held, size = [], [], [], 0
            for t in [*part, ...]:
                if t is not ...:
                    held.append(t)
                    size += len(t) if t else 0
                if held and (t is ... or size > _HELD):
                    a, b = own.predict(held)
                    labels += a
                    scores.append(b)
                    held, size = [], 0
            yield pd.DataFrame({"lang_pred": pd.Series(labels, dtype=object), "score": np.concatenate(scores) if scores else np.zeros(0)})

    kept = docs.drop("lang_pred", "score")
    (p,) = free_names(kept, "_p")
    return kept.withColumn(p, predicted("text")).select(*kept.columns, f"{p}.lang_pred", f"{p}.score")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: all but the held-out third."""
    return docs.where(crc_mod(F.col("doc_id"), 3) != 1)


def keep_identified(docs: DataFrame, model: SegmentModel, least: float = 0.5) -> DataFrame:
    """The documents with a language of posterior ``least`` or more; columns and their values as they came.

    A model without a language can't reject: all documents stay.
    """
    if not model.languages:
        return docs
    given, back = shielded(docs, "lang_pred", "score")
    return identify(given, model).where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= least)).select(*back)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
