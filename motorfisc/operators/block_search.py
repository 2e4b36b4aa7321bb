"""The first rows of many listings out of one block of rows: points as ``match`` gives them, a matrix of listings by rows at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

from motorfisc.functions import dims

_M = dims.MATCH
#: Listings that are looked up together (of near power), and scores that are held at once.
GROUP, HELD = 64, 1 << 18
#: Periods that aren't in force yet stand behind all others.
LATER = 1 << 31
#: Bounds are told a little too high, as they add up in another order than scores do.
SLACK = 1e-9


def _ramp(gap: np.ndarray, ramp: tuple) -> np.ndarray:
    """Points of a gap; none where it isn't known."""
    tolerance, most, bonus, penalty = ramp
    points = bonus - (gap - tolerance) / (most - tolerance) * (bonus + penalty)
    return np.where(np.isnan(gap), 0.0, np.where(gap <= tolerance, bonus, np.where(gap >= most, -penalty, points)))


class _Rows:
    """What a block holds."""

    def __init__(self, held: pd.DataFrame) -> None:
        number = lambda name: held[name].to_numpy("float64", na_value=np.nan)
        self.other = held["_other"].to_numpy("bool")
        self.base = np.maximum(0.0, number("_text") - np.where(self.other, _M["model_penalty"], 0.0))
        self.words, self.power, self.co2, self.year, self.price = (number(n) for n in ("_words", "power_kw", "co2_g_km", "_year", "_price"))
        self.start, self.id = held["_start"].to_numpy("int64"), held["catalogue_id"].to_numpy("int64")

    def bounds(self, power: np.ndarray, co2: np.ndarray, year: np.ndarray) -> np.ndarray:
        """What each row can score at most with any of these listings."""
        gap = np.zeros(len(self.id))
        if not np.isnan(power).any():
            gap = np.nan_to_num(np.maximum(np.maximum(power.min() - self.power, self.power - power.max()), 0.0))
        points = _ramp(gap, dims.POWER_RAMP)
        bonus = np.maximum(points, 0.0) + (0.0 if np.isnan(co2).all() else dims.CO2_RAMP[2]) + (0.0 if np.isnan(year).all() else dims.YEAR_RAMP[2])
        most = np.maximum(0.0, np.minimum(100.0, self.base + bonus) - self.words - np.maximum(-points, 0.0))
        sure = ~self.other & (self.words == 0) & (gap <= dims.POWER_RAMP[0])
        return np.where(sure, np.maximum(most, 100.0 - _M["trim_penalty"]), most) + SLACK

    def scores(self, at: np.ndarray, power: np.ndarray, co2: np.ndarray, year: np.ndarray) -> np.ndarray:
        """A listing's row of the matrix: what it scores with each row at ``at``, as ``match`` adds points up."""
        power, year = power[:, None], year[:, None]
        gap, years = np.abs(power - self.power[at]), np.abs(year - self.year[at])
        given = [_ramp(gap, dims.POWER_RAMP), 0.0 if np.isnan(co2).all() else _ramp(np.abs(co2[:, None] - self.co2[at]), dims.CO2_RAMP), _ramp(years, dims.YEAR_RAMP)]
        bonus = np.maximum(given[0], 0.0) + np.maximum(given[1], 0.0) + np.maximum(given[2], 0.0)
        penalty = self.words[at] + (np.maximum(-given[0], 0.0) + np.maximum(-given[1], 0.0) + np.maximum(-given[2], 0.0))
        score = np.maximum(0.0, np.minimum(100.0, self.base[at] + bonus) - penalty)
        power_ok, year_ok = gap <= dims.POWER_RAMP[0], years <= dims.YEAR_RAMP[0]
        sure = ~self.other[at] & (penalty == 0) & (np.isnan(power) | power_ok) & (np.isnan(year) | year_ok) & (power_ok | year_ok)
        return np.where(sure, np.maximum(score, 100.0 - _M["trim_penalty"]), score)


class _Found:
    """The first ``k`` rows of each listing so far, and what is known of the prices near its best.

    ``s1`` is the best score of a row that has a price, ``p1`` that price, ``s2`` the best score of a row of another price.
    """

    def __init__(self, asked: pd.DataFrame, k: int) -> None:
        n = len(asked)
        self.k, self.score, self.key, self.id = k, np.full((n, k), -1.0), np.zeros((n, k), "int64"), np.zeros((n, k), "int64")
        for i, (ids, scores, keys) in enumerate(zip(asked["ids"], asked["scores"], asked["keys"], strict=True)):
            m = len(ids)
            if m:
                self.id[i, :m], self.score[i, :m], self.key[i, :m] = ids, scores, keys
        self.s1, self.p1, self.s2 = (asked[x].to_numpy("float64", na_value=np.nan).copy() for x in ("s1", "p1", "s2"))

    def needs(self, at: np.ndarray) -> np.ndarray:
        """The least score of a row that a listing still has to meet."""
        top, kth = self.score[at, 0], np.maximum(self.score[at, -1], 0.0)
        told = (top < _M["accept"]) | ((self.s2[at] >= 0) & (top - self.s2[at] <= _M["margin"]))
        return np.where(top < _M["floor"], _M["floor"], np.where(told, kth, np.minimum(kth, top - _M["margin"])))

    def add(self, who: np.ndarray, scores: np.ndarray, rows: _Rows, at: np.ndarray, year: np.ndarray) -> None:
        k, least = self.k, self.score[who, -1]
        if scores.shape[1] > k:
            least = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        q, r = np.nonzero(scores >= least[:, None])
        begun = np.isnan(year[q]) | np.isnan(rows.year[at[r]]) | (rows.year[at[r]] <= year[q])
        key = np.where(begun, -rows.start[at[r]], LATER + rows.start[at[r]])
        old_q, old_r = np.nonzero(self.score[who] >= 0)
        old = who[old_q], old_r
        q, score = np.concatenate([old_q, q]), np.concatenate([self.score[old], scores[q, r]])
        key, ids = np.concatenate([self.key[old], key]), np.concatenate([self.id[old], rows.id[at[r]]])
        order = np.lexsort((ids, key, -score, q))
        q = q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, nth = order[nth < k], q[nth < k], nth[nth < k]
        to = who[q], nth
        self.score[to], self.key[to], self.id[to] = score[order], key[order], ids[order]
        self._priced(who, scores, rows.price[at])

    def _priced(self, who: np.ndarray, scores: np.ndarray, price: np.ndarray) -> None:
        have = ~np.isnan(price)
        if not have.all():
            scores, price = scores[:, have], price[have]
        if not len(price):
            return
        best = scores.argmax(axis=1)
        t1, q1 = scores[np.arange(len(who)), best], price[best]
        t2 = np.where(price == q1[:, None], -1.0, scores).max(axis=1)
        s1, p1, s2 = self.s1[who], self.p1[who], self.s2[who]
        better, alike = t1 > s1, p1 == q1
        lower = np.where(alike | np.isnan(p1), -1.0, np.minimum(s1, t1))
        # a second price is the other one of two best, or one that either side has known as such
        self.s2[who] = np.maximum(np.maximum(lower, np.where(alike | ~better, s2, -1.0)), np.where(alike | better, t2, -1.0))
        self.s1[who], self.p1[who] = np.maximum(s1, t1), np.where(better, q1, p1)


def search(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """``asked`` listings with their first ``k`` rows, of those that they came with and those of ``held``.

    Rows stand by what they can score at most with a group of listings, so a listing is left as soon as no further row
    can come among its first or tell of another price near its best. All that can are met.
    """
    if asked.empty or held.empty:
        return asked
    found, rows = _Found(asked, k), _Rows(held)
    power, co2, year = (asked[x].to_numpy("float64", na_value=np.nan) for x in ("q_power", "q_co2", "year"))
    by_power = np.lexsort((year, power))
    for first in range(0, len(by_power), GROUP):
        who = by_power[first : first + GROUP]
        bound = rows.bounds(power[who], co2[who], year[who])
        order = np.argsort(-bound, kind="stable")
        done, step = 0, 4 * k + 64
        while done < len(order):
            who = who[found.needs(who) <= bound[order[done]]]
            if not len(who):
                break
            at = order[done : done + step]
            found.add(who, rows.scores(at, power[who], co2[who], year[who]), rows, at, year[who])
            done, step = done + step, min(2 * step, max(HELD // GROUP, 1))
    n = (found.score >= 0).sum(axis=1)
    cut = lambda x: [row[:m] for row, m in zip(x, n, strict=True)]
    return asked.assign(ids=cut(found.id), scores=cut(found.score), keys=cut(found.key), s1=found.s1, p1=found.p1, s2=found.s2)
