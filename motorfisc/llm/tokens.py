"""Token counts of a public byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from motorfisc.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens that a document may have before it counts as over the limit.
LIMIT = 512
#: Characters whose pre-tokens are held at once, and counts that a worker keeps.
_HELD, _KEPT = 1_000_000, 150_000
#: Longest word that is known as a whole, rather than by its pre-tokens.
_UNIT = 48
_NONE = np.int64(1) << 40


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankedMerges:
    """The merges of one vocabulary, as a hash table from a pair of symbols to its rank and the symbol it makes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, merges = said["model"]["vocab"], said["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = _byte_letters()
        self.start = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.mask = (1 << 19) - 1
        self.keys, self.ranks, self.made = np.full(self.mask + 1, -1, dtype=np.int64), np.full(self.mask + 1, _NONE), np.zeros(self.mask + 1, dtype=np.int64)
        self.probes, left = 0, np.arange(len(keys))
        slots = self._slot(keys)
        while len(left):
            self.probes += 1
            at = (slots[left] + self.probes - 1) & self.mask
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            placed = np.zeros(len(left), dtype=bool)
            placed[first] = True
            placed &= free
            where = at[placed]
            self.keys[where], self.ranks[where], self.made[where] = keys[left[placed]], left[placed], made[left[placed]]
            left = left[~placed]
        self.special = [t["content"] for t in said["added_tokens"]]
        self.apart = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")").split if self.special else lambda text: [text]
        self.run_of_spaces = regex.compile(r"\s (?:\s|\Z)").search
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, int] = dict.fromkeys(self.special, 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs in the table; a pair without a merge gets a slot of another key."""
        keys = (left << 20) | right
        at = self._slot(keys)
        open_ = np.flatnonzero(self.keys[at] != keys)
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        self_hit = self.keys[at] == keys
        return np.where(self_hit, at, -1)

    def lengths(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token.

        All are held in one flat array of symbols. In a round every sequence that still has a mergeable pair has all
        occurrences of its lowest-ranked pair merged, leftmost first where they overlap. A merge makes no pair of a
        lower rank than its own, so that this equals merging one pair after another.
        """
        raw = [w.encode("utf-8", "replace") for w in words]
        counts = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out = counts.copy()
        symbols = self.start[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), counts)
        while len(symbols) > 1:
            inside = owner[:-1] == owner[1:]
            at = self._find(symbols[:-1], symbols[1:])
            ranks = np.where(inside & (at >= 0), self.ranks[at], _NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[ranks, _NONE], starts)
            busy = np.repeat(best, np.diff(np.r_[starts, len(owner)]))
            live = busy < _NONE
            hit = (ranks == busy[:-1]) & live[:-1]
            # of hits in a row (a symbol repeated) every second one merges, from the left
            place = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(place) != 1]) if len(place) else place
            nth = np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))
            place = place[nth % 2 == 0]
            symbols[place] = self.made[at[place]]
            live[place + 1] = False
            out -= np.bincount(owner[place], minlength=len(out))
            symbols, owner = symbols[live], owner[live]
        return out

    def _units(self, text: str) -> list[str]:
        """Texts of one or more whole pre-tokens each, in order, that make up a text: mostly words with a space before.

        A space between two other characters, of which one at least is no white space, starts a pre-token, whatever
        else there is. Texts with longer runs of white space around a space, and long words, are cut up into pre-tokens.
        """
        if self.run_of_spaces(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        out = [first] if first else []
        out += [" " + w for w in rest]
        return out if max(map(len, out)) <= _UNIT else [p for u in out for p in ([u] if len(u) <= _UNIT else self.pieces(u))]

    def _learn(self, words: list[list[str]]) -> None:
        """Sees to it that the tokens of each of these units are known."""
        own = set().union(*words)
        if len(self.known) > _KEPT:
            # what occurs here again is likely to later, unlike most of the rest
            self.known = dict.fromkeys(self.special, 1) | {w: self.known[w] for w in own & self.known.keys()}
        new = own.difference(self.known)
        mixed = {w: self.pieces(w) for w in new if not w.lstrip(" ").isalpha()}
        single = new.difference(mixed).union(*mixed.values()).difference(self.known)
        if single:
            self.known.update(zip(single, self.lengths(list(single)).tolist(), strict=True))
        known = self.known.__getitem__
        self.known.update({w: sum(map(known, pieces)) for w, pieces in mixed.items()})

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; special tokens that occur in a text count as one each."""
        words = self._split(texts)
        self._learn(words)
        known = self.known.__getitem__
        return [sum(map(known, ws)) for ws in words]

    def _split(self, texts: list[str | None]) -> list[list[str]]:
        return [[w for i, part in enumerate(self.apart(t)) if part for w in ([part] if i % 2 else self._units(part))] if t else [] for t in texts]

    def cut(self, texts: list[str | None], most: int) -> list[list[tuple[str, int]]]:
        """Each text as (piece, tokens): pieces of ``most`` tokens at most that make up the text, none for an empty one.

        A text of no more tokens is one piece. A longer one is cut between words (and other pre-tokens), each piece
        taking as many as it can; one of more tokens than that is cut up first. The tokens of a piece are those that it
        has within its text.
        """
        words = self._split(texts)
        self._learn(words)
        known, out = self.known.__getitem__, []
        for text, own in zip(texts, words, strict=True):
            sizes = np.fromiter(map(known, own), dtype=np.int64, count=len(own))
            if not own or sizes.sum() <= most:
                out.append([(text, int(sizes.sum()))] if own else [])
                continue
            if sizes.max() > most:
                own = [part for w, n in zip(own, sizes, strict=True) for part in ([w] if n <= most else self._short(w, most))]
                self._learn([own])
                known = self.known.__getitem__
                sizes = np.fromiter(map(known, own), dtype=np.int64, count=len(own))
            ends, pieces, at = np.cumsum(sizes), [], 0
            while at < len(own):
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + most, side="right"))
                pieces.append(("".join(own[at:to]), int(ends[to - 1]) - before))
                at = to
            out.append(pieces)
        return out

    @staticmethod
    def _short(word: str, most: int) -> list[str]:
        """A word in parts of ``most`` bytes at most."""
        step = max(1, most // 4)
        return [word[at : at + step] for at in range(0, len(word), step)]


@cache
def merges(path: str) -> RankedMerges:
    return RankedMerges(path)


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text as long, without begin, end or padding; a null text counts as the empty one, with none.

    Texts are taken whole; a batch is worked off in parts of about ``_HELD`` characters (or one longer text). ``path``
    is a vocabulary file that the executors have too.
    """

    @F.pandas_udf(LongType())
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = merges(path)
        for part in parts:
            out: list[int] = []
            held, size = [], 0
            for t in part:
                held.append(t)
                size += len(t) if t else 0
                if size > _HELD:
                    out += model.counts(held)
                    held, size = [], 0
            yield pd.Series(out + (model.counts(held) if held else []), dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit), one row for each row, repeated rows included.

    A null text counts as empty: 0 bytes, 0 tokens. An empty table gives an empty one. Other columns are neither read
    nor returned.
    """
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count_tokens(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
