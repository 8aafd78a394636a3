"""Runs of repeated words within a document, by recursive frequency splitting and a lag scan of what survives.

In a run of period q and four or more periods every word occurs four times at least.  A word that occurs less often within its
segment is in no run of it, so the segment is cut there, and the pieces are counted anew until every word is frequent enough in its
own segment.  Prose falls apart at once.  The surviving segments are scanned lag by lag: words q apart must be equal over three
periods or more, hence also at three neighbouring multiples of q, so a lag looks at every q-th word only and the lags of a
segment of m words cost m log m looks.  A document is worked on in one task alone and nothing is shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS, SHORTEST = 4, 6  # a run holds so many periods and words at least
ROUNDS = 64  # splitting stops after so many rounds; it only saves work, the scan is exact without it
TOGETHER = 1_000_000  # words of several documents that are split together; bounds memory only

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Numbers(dict):
    """A number for each word, given out at first sight."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def split_words(text: str | None) -> list[bytes]:
    """Words end at ASCII white space (\\x20, \\x09-\\x0D)."""
    return (text or "").encode("utf-8", "replace").split()


def segments(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches in which every word occurs ``PERIODS`` times at least, ``segment`` (rising) being cut no further apart."""
    at, done = np.arange(len(words)), []
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, key, count = np.unique(segment[at] * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        stays = count[key] >= PERIODS
        first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(segment[at]) != 0)])
        whole = np.logical_and.reduceat(stays, first)
        size = np.diff(np.r_[first, len(at)])
        done.append((at[first[whole]], size[whole]))
        at = at[stays & np.repeat(~whole, size)]
        if len(at):  # the pieces are segments of their own from now on
            opens = np.r_[True, (np.diff(at) != 1) | (np.diff(segment[at]) != 0)]
            number = np.cumsum(opens) - 1
            segment = segment.copy()
            segment[at] = number
            at = at[(np.bincount(number) >= SHORTEST)[number]]
    if len(at):
        first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(segment[at]) != 0)])
        done.append((at[first], np.diff(np.r_[first, len(at)])))
    starts, sizes = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
    long = sizes >= SHORTEST
    return starts[long], (starts + sizes)[long]


def _stretch(w: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The longest [l, r) around ``at`` in which w[i] == w[i + lag], within low <= i < high - lag."""
    right, step = at, 64
    while right < high - lag:
        end = min(right + step, high - lag)
        other = w[right:end] != w[right + lag:end + lag]
        k = int(other.argmax())
        if other[k]:
            right += k
            break
        right, step = end, 2 * step
    left, step = at, 64
    while left > low:
        begin = max(left - step, low)
        other = (w[begin:left] != w[begin + lag:left + lag])[::-1]
        k = int(other.argmax())
        if other[k]:
            left -= k
            break
        left, step = begin, 2 * step
    return left, right


def scan(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs within the segments, in places of ``words``."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: a lag looks at a beginning of the array
    starts, sizes = starts[order], (ends - starts)[order]
    if not len(starts):
        return []
    begin = np.r_[0, np.cumsum(sizes)]
    own = np.repeat(np.arange(len(sizes)), sizes)
    w = words[np.arange(begin[-1]) - begin[own] + starts[own]]
    stop = begin[own + 1]
    reach = np.zeros(len(w), np.int64)  # how far the known runs over a place go
    found = []
    for lag in range(1, int(sizes[0]) // PERIODS + 1):
        upto = int(begin[np.searchsorted(-sizes, -max(SHORTEST, PERIODS * lag), "right")])
        at = np.arange(0, upto - 3 * lag, lag)
        at = at[w[at] == w[at + lag]]
        at = at[w[at + lag] == w[at + 2 * lag]]
        at = at[(w[at + 2 * lag] == w[at + 3 * lag]) & (at + 3 * lag < stop[at])]
        at = at[reach[at] <= at + 3 * lag]  # else a multiple of a known period
        for step in (lag * np.arange(1, 16)) // 8 if lag >= 8 else ():
            if not len(at):
                break
            at = at[w[at + step] == w[at + step + lag]]
        i = 0
        while i < len(at):
            place = int(at[i])
            segment = own[place]
            left, right = _stretch(w, place, lag, int(begin[segment]), int(begin[segment + 1]))
            end = right + lag
            if end - left >= max(SHORTEST, PERIODS * lag) and reach[left] < end:
                reach[left:end] = np.maximum(reach[left:end], end)
                shift = int(starts[segment] - begin[segment])
                found.append((left + shift, end + shift, lag))
            i = max(i + 1, int(np.searchsorted(at, right)))  # the other places of this stretch
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each list of words its runs (start, length, period), by start, then period."""
    numbers, out = Numbers(), [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    begin = np.r_[0, np.cumsum(sizes)]
    if len(words):
        for start, end, period in scan(words, *segments(words, np.repeat(np.arange(len(texts)), sizes))):
            doc = int(np.searchsorted(begin, start, "right")) - 1
            out[doc].append((start - int(begin[doc]), end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(stays)]
    return b" ".join(words).decode("utf-8", "replace")


def find_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, runs, collapsed) of every row: its maximal runs, by start and period, and the text with each run cut to one period.

    A run is a stretch of words with smallest period q, of at least ``PERIODS`` periods and ``SHORTEST`` words, that no neighbouring
    word extends; runs may overlap or lie in each other.  Words are numbered from 0.  A null, empty or blank text has no runs and
    collapses to ''.  Rows are worked on alone, so repeated ids and null ids keep a row each; an empty table gives an empty table;
    other columns, whatever their names, are left aside.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, held, count, lo = batch["id"], [], 0, 0
            for i, value in enumerate(batch["text"], 1):
                held.append(split_words(value))
                count += len(held[-1])
                if count >= TOGETHER or i == len(batch):
                    runs = runs_of(held)
                    yield pd.DataFrame({"id": ids.iloc[lo:i].to_numpy(), "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
                                        "collapsed": [collapsed(t, r) for t, r in zip(held, runs)]})
                    held, count, lo = [], 0, i

    # ids travel as text: a column of long integers with a null in it would turn into doubles
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    found = known.mapInPandas(search, f"id string, runs {RUNS}, collapsed string")
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "runs", "collapsed")
