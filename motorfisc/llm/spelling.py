"""Spelling variants: words one edit apart, found by composing vocabulary acceptors with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motorfisc.llm.common import settle, table

#: Letters of a word at least, and how often it occurs at least.
LEAST_LETTERS, LEAST_N = 7, 2
#: A form occurs so many times as often as its variant at least.
FORM = 10
#: One of so many runs of a document loses a letter.
DAMAGED = 31
#: Words of a partition of the composition at most; a larger one is cut again.
MOST = 1 << 14
_LETTER = "A-Za-zÀ-ÿ"
_KEY = ["path", "m", "head", "tail"]
_FOUND = "word string, n_near long, near_n long, near string"


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words.

    States are numbered so that arcs lead to smaller numbers; the last state is the initial one. ``arcs[s]`` maps a
    letter to (target, words of the state that come before those of the arc), so that the sums along a path are the
    places of words in their order; ``final[s]`` tells whether a word ends in s.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._words: list[int] = []
        self._known: dict[tuple, int] = {}
        open_states: list[list] = [[{}, False]]
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            self._close(open_states, before, shared)
            open_states += [[{}, False] for _ in range(len(word) - shared)]
            open_states[-1][1] = True
            before = word
        self._close(open_states, before, 0)
        self.initial = self._state(*open_states[0])

    def _close(self, open_states: list[list], word: str, down_to: int) -> None:
        while len(open_states) - 1 > down_to:
            state = self._state(*open_states.pop())
            open_states[-1][0][word[len(open_states) - 1]] = state

    def _state(self, targets: dict[str, int], final: bool) -> int:
        key = (final, *targets.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            arcs, words = {}, int(final)
            for letter, target in targets.items():
                arcs[letter] = (target, words)
                words += self._words[target]
            self.arcs.append(arcs)
            self.final.append(final)
            self._words.append(words)
        return state

    def _shared(self, p: int, q: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Places of the words that both states accept, in the order of each: the transducer after its edit."""
        arcs, final, todo = self.arcs, self.final, [(p, q, i, j)]
        while todo:
            p, q, i, j = todo.pop()
            if final[p] and final[q]:
                yield i, j
            other = arcs[q]
            for letter, (target, words) in arcs[p].items():
                if letter in other:
                    to, more = other[letter]
                    todo.append((target, to, i + words, j + more))

    def _edits(self, state: int, end: bool) -> Iterator[tuple[int, int]]:
        """Pairs of words of a state that differ by an edit of their first letter: a replaced one, or one more in the second.

        A letter put in counts only where the next one is another letter, or none (with ``end``), so that a pair has
        one path through the composition however often a letter stands in a row.
        """
        own = list(self.arcs[state].items())
        for at, (_, (p, i)) in enumerate(own):
            for _, (q, j) in own[at + 1 :]:
                yield from self._shared(p, q, i, j)
        for put, (q, j) in own:
            if end and self.final[state] and self.final[q]:
                yield 0, j
            for letter, (to, more) in self.arcs[q].items():
                if letter != put and letter in self.arcs[state]:
                    target, words = self.arcs[state][letter]
                    yield from self._shared(target, to, words, j + more)

    def near(self, end: bool = True) -> Iterator[tuple[int, int]]:
        """Places of all pairs of words one edit apart, the shorter first; ``end``: also those that differ by a last letter.

        This is the acceptor composed with the one-edit transducer and the acceptor. Before the edit both acceptors are
        in the same state, so a pair is a path to a state, and an edit there. Only states where ways part are looked at.
        """
        bases: list[list[int]] = [[] for _ in self.arcs]
        bases[self.initial] = [0]
        for state in range(len(self.arcs) - 1, -1, -1):
            arcs, here = self.arcs[state], bases[state]
            for target, words in arcs.values():
                bases[target] += [b + words for b in here]
            if len(arcs) > 1 or arcs and self.final[state]:
                for i, j in self._edits(state, end):
                    for b in here:
                        yield b + i, b + j
            bases[state] = []


def near_in_partition(rests: list[str], m: int, strict: bool) -> list[tuple[int, int]]:
    """Pairs of a partition's sorted words: those whose shorter one has ``m`` letters; ``strict`` leaves out a word and itself with a letter more."""
    return [(i, j) for i, j in Acceptor(rests).near(not strict) if len(rests[i]) == m or len(rests[j]) == m]


def _summed(group: pd.DataFrame) -> pd.DataFrame | None:
    """Of each word of a partition with a near word in it: how many, and the most frequent one (ties: the least)."""
    m, path, head, tail = int(group["m"].iloc[0]), group["path"].iloc[0], group["head"].iloc[0], group["tail"].iloc[0]
    rests = group["rest"].to_list()
    pairs = near_in_partition(rests, m, "s" in path)
    if not pairs:
        return None
    a, b = np.array(pairs).T
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    words = np.array([head + r + tail for r in rests], dtype=object)
    place, n = np.empty(len(words), dtype=np.int64), group["n"].to_numpy()
    place[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    own, first, count = np.unique(a, return_index=True, return_counts=True)
    return pd.DataFrame({"word": words[own], "n_near": count, "near_n": n[b[first]], "near": words[b[first]]})


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of partitions and words; a partition is held until it is whole."""
    held: list[pd.DataFrame] = []

    def last_first(batch: pd.DataFrame) -> np.ndarray:
        changed = np.zeros(len(batch), dtype=bool)
        for c in _KEY:
            x = batch[c].to_numpy()
            changed[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(changed)

    def out(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [s for g in groups if len(g) > 1 and (s := _summed(g)) is not None]
        if found:
            yield pd.concat(found)

    for batch in batches:
        if not len(batch):
            continue
        if held and any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in _KEY):
            yield from out([pd.concat(held)])
            held = []
        edges = last_first(batch).tolist()
        if not edges:
            held.append(batch)
            continue
        yield from out([pd.concat([*held, batch.iloc[: edges[0]]]), *[batch.iloc[i:j] for i, j in zip(edges, edges[1:], strict=False)]])
        held = [batch.iloc[edges[-1] :]]
    if held:
        yield from out([pd.concat(held)])


def _halves(parts: DataFrame) -> DataFrame:
    """Each word of a partition, by both halves: what is left of it besides the half that it may share.

    Two words one edit apart whose shorter one has m letters share their first m // 2 letters or their last m - m // 2.
    """
    h, k = F.floor(F.col("m") / 2).cast("int"), F.length("rest")
    long = F.col("m") - h
    first = F.struct(F.concat("path", F.lit("p")).alias("path"), long.alias("m"), F.concat("head", F.substring("rest", F.lit(1), h)).alias("head"), F.col("tail"), F.substring("rest", h + 1, k).alias("rest"))
    last = F.struct(F.concat("path", F.lit("s")).alias("path"), h.alias("m"), F.col("head"), F.concat(F.substring("rest", k - long + 1, long), "tail").alias("tail"), F.substring("rest", F.lit(1), k - long).alias("rest"))
    return parts.select("n", F.explode(F.array(first, last)).alias("x")).select("n", "x.*")


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n) -> (path, m, head, tail, rest, n): words by the partitions in which their near words are found.

    A partition stands for a state of the vocabulary's acceptor: the one after the letters ``head`` (path p), or for
    words read from behind the one after ``tail`` (path s); ``rest`` is what the word has besides. Every pair of near
    words is found in one partition: where both start alike there, else where both end alike. A partition of more than
    ``most`` words is cut by halves of the rest again, until none is left or the rests are of one or two letters.
    """
    k = F.length("word")
    whole = words.select(F.lit("").alias("path"), F.explode(F.array(k, k - 1)).alias("m"), F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("rest"), "n")
    level, done = settle(_halves(whole.where(F.col("m") >= LEAST_LETTERS))), None
    while True:
        large = level.where("m > 1").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > most).drop("words")
        large = settle(large)
        if large.isEmpty():
            return level if done is None else done.unionByName(level)
        small = level.join(large, _KEY, "left_anti").select(*level.columns)
        done = small if done is None else done.unionByName(small)
        level = settle(_halves(level.join(large, _KEY, "left_semi").select(*level.columns)))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct (word, n) -> (word, n_near, near_n, near): of each word with near words how many, and the most frequent (ties: the least)."""
    every = Window.partitionBy(*_KEY).orderBy("rest").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = partitions(words, most).withColumn("_in", F.count(F.lit(1)).over(every)).where("_in > 1").drop("_in").sortWithinPartitions(*_KEY, "rest")
    found = shared.mapInPandas(_composed, _FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without circles -> (word, root): where forms lead in the end; ways are joined, which halves what is left of each."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = settle(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.drop("moved")
        now = further.drop("moved")


def variants(words: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct (word, n) of words of LEAST_LETTERS or more -> (word, form, root, n, n_near, form_n), one row a word.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near
    word of largest n (ties: the first in code-point order) if that n is FORM times its own at least, else null; its
    root is the last of its form, the form's form and so on, or the word itself. Rows without a word or n take no part.
    An empty table gives an empty one; other columns are neither read nor returned.

    Hot prefixes: a partition of the composition has MOST words at most, as larger ones are cut again, so none outgrows
    a task. Only words and counts are shuffled.
    """
    given = settle(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")))
    near = settle(near_words(given, most))
    enough = F.col("near_n") >= FORM * F.col("n")
    linked = given.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"))
    linked = settle(linked)
    ends = roots(linked.where("form is not null"))
    return linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _damaged(doc_id: Column, run: Column) -> Column:
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (word, n): the words of LEAST_LETTERS code points and LEAST_N occurrences or more, over all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, some of them damaged: if 31 divides
    the crc32 of ``doc_id:run``, the run loses the letter at that crc32 modulo its length. Null texts have no words; a
    null doc_id counts as empty. Shorter runs are never words, so none is taken out of the text. Occurrences are
    counted in the tasks that find them before anything is shuffled, so a word that is everywhere is no hot key.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{_LETTER}]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = runs.select("doc_id", lower.alias("run")).select(_damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_N)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of all documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
