"""Stretches of words that repeat with a period, found while the words arrive.

The words of a text are appended to :class:`Catchers`, all at once or a few at a time. Every completed block of ``m = 2 ** k`` words, at
a multiple of ``m``, is a catcher for the periods above ``m`` up to ``2 * m`` (the smallest blocks also catch those up to ``m``): for
each appended word the suffix of ``m`` words that it ends is compared with the one block of each size that lies so far back. Equal
words begin a thread, which is led back to where the period begins and is advanced by the words that follow. A thread of two periods
is a square; squares of one period merge into the run that the thread has become when a word breaks it.

A run of ``q``-periodic words counts from ``PERIODS`` periods and ``least_length`` words on, so that a whole block with its repetition lies in
it, whichever word it begins at. Blocks are compared by a rolling hash and then word by word, so the result is exact.

Each text is handled by itself in one pass of bounded Arrow batches, without a shuffle.

Defined cases: null and empty texts have no words and no runs; rows are handled one by one, so repeated ids give repeated rows; a
null id stays null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmeter.llm.common import map_rows, text_bytes

#: Periods that a run has at least.
PERIODS = 3
#: Words that a run has at least.
LEAST_LENGTH = 24

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD1B54A32D192ED03)
_RUN = "struct<start:long,length:long,period:long>"


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_POWERS = _Powers()


class Catchers:
    """Squares and runs of a sequence of whole numbers that grows at its end."""

    def __init__(self, least_length: int = LEAST_LENGTH):
        self.least = max(least_length, PERIODS)
        # The smallest blocks: such a block and its repetition lie whole in each run of a period up to twice its length.
        self.first = ((self.least + 1) // 3).bit_length() - 1
        self.n = 0
        self._words, self._sums = np.zeros(1, np.int64), np.zeros(2, np.uint64)
        self.open: dict[int, int] = {}  # period -> first word of the stretch that the last word belongs to
        self.closed: list[tuple[int, int, int]] = []  # (first word, word after the last, period) of squares that ended

    @property
    def words(self) -> np.ndarray:
        return self._words[:self.n]

    def append(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Take the next words; returns ``(start, period)`` of the stretches that became squares by them."""
        old, new = self.n, self.n + len(words)
        _POWERS.reach(new + 1)
        if new > len(self._words):
            self._words = np.concatenate([self._words, np.zeros(new, np.int64)])
            self._sums = np.concatenate([self._sums, np.zeros(new, np.uint64)])
        self._words[old:new] = words
        terms = (words.astype(np.uint64) + np.uint64(1)) * _MIX * _POWERS.up[old:new]
        self._sums[old + 1:new + 1] = np.cumsum(terms, dtype=np.uint64) + self._sums[old]
        self.n = new
        squares = self._advance(old)
        k = self.first
        while new > 1 << k:
            squares += self._compare(k, old)
            k += 1
        return squares

    def _advance(self, old: int) -> list[tuple[int, int]]:
        """Lead open threads over the words from ``old`` on; those that break are closed."""
        squares = []
        for q, first in list(self.open.items()):
            end = old + self._equal_from(old - q, old)
            if old - first < 2 * q <= end - first:
                squares.append((first, q))
            if end < self.n:
                del self.open[q]
                if end - first >= 2 * q:
                    self.closed.append((first, end, q))
        return squares

    def _equal_from(self, i: int, j: int) -> int:
        """How many words from ``i`` and from ``j`` (later) on are equal."""
        n, step, rest = 0, 64, self.n - j
        while n < rest:
            w = min(step, rest - n)
            apart = np.flatnonzero(self._words[i + n:i + n + w] != self._words[j + n:j + n + w])
            if len(apart):
                return n + int(apart[0])
            n, step = n + w, 2 * step
        return n

    def _equal_before(self, i: int, j: int) -> int:
        """How many words before ``i`` and before ``j`` (later) are equal."""
        n, step = 0, 64
        while n < i:
            w = min(step, i - n)
            apart = np.flatnonzero(self._words[i - n - w:i - n] != self._words[j - n - w:j - n])
            if len(apart):
                return n + w - 1 - int(apart[-1])
            n, step = n + w, 2 * step
        return n

    def _compare(self, k: int, old: int) -> list[tuple[int, int]]:
        """Hold the suffixes of ``2 ** k`` words that end behind ``old`` against the blocks that catch them."""
        m, new = 1 << k, self.n
        begin = max(1, old - m + 1)
        if begin > new - m:
            return []
        low = m if k > self.first else 0
        starts = np.arange(begin, new - m + 1)
        # Blocks lie at multiples of m: one of them is so far back that the distance is in (low, low + m].
        found = [self._hits(starts, back, m) for back in range(low, 2 * m, m)]
        starts, periods = (np.concatenate(x) for x in zip(*found))
        return self._follow(starts, periods, m) if len(starts) else []

    def _hits(self, starts: np.ndarray, back: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        starts = starts[max(0, back + 1 - int(starts[0])):]
        blocks = (starts - back - 1) // m * m
        sums, down = self._sums, _POWERS.down
        same = (sums[starts + m] - sums[starts]) * down[starts] == (sums[blocks + m] - sums[blocks]) * down[blocks]
        return starts[same], (starts - blocks)[same]

    def _follow(self, starts: np.ndarray, periods: np.ndarray, m: int) -> list[tuple[int, int]]:
        """Begin threads at suffixes that equal a block one period before, except inside squares that tell them already."""
        order = np.lexsort((starts, periods))
        starts, periods, squares = starts[order], periods[order], []

        def untold(first: int, end: int, q: int, multiples: bool) -> np.ndarray:
            other = periods % q != 0 if multiples else periods != q
            return other | (starts - periods < first) | (starts + m > end)

        for first, end, q in [*self.closed, *((s, self.n, q) for q, s in self.open.items())]:
            left = untold(first, end, q, end - first >= 2 * q)
            starts, periods = starts[left], periods[left]
        while len(starts):
            j, q = int(starts[0]), int(periods[0])
            first, end = j - q - self._equal_before(j - q, j), j + self._equal_from(j - q, j)
            square = end - first >= 2 * q
            left = untold(first, end, q, square)
            left[0] = False
            starts, periods = starts[left], periods[left]
            if square:
                squares.append((first, q))
            if end == self.n:
                self.open[q] = first
            elif square:
                self.closed.append((first, end, q))
        return squares

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of the runs so far, by start and period; the period is the smallest one."""
        least: dict[tuple[int, int], int] = {}
        for first, end, q in [*self.closed, *((s, self.n, q) for q, s in self.open.items())]:
            if end - first >= max(self.least, PERIODS * q):
                least[first, end] = min(q, least.get((first, end), q))
        return sorted((first, end - first, q) for (first, end), q in least.items())


def loop_tail(doc_id: int | None, words: list) -> list:
    """The words with a repeated tail where the CRC of the id ends in 0: a self-check that plants runs at known places."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def runs_of(words: list, least_length: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a list of words."""
    if len(words) < max(least_length, PERIODS):
        return []
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    catchers = Catchers(least_length)
    catchers.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    return catchers.runs()


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list], list] | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs, strongest, collapsed`` per document.

    Words end at blanks and U+0009 to U+000D; ``change`` may replace a document's words first. ``strongest`` is the run of the greatest
    length by period (the first, then that of the smallest period, of equal ones), null without runs. ``collapsed`` is the text, words
    joined by a blank, that keeps of each run the first period.
    """
    def make():
        def step(columns):
            for doc_id, text in zip(*columns):
                words = text.split()
                if change:
                    words = change(doc_id, words)
                runs = runs_of(words, least_length)
                best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                kept = words
                if runs:
                    stays = np.ones(len(words), bool)
                    for start, length, period in runs:
                        stays[start + period:start + length] = False
                    kept = [words[k] for k in np.flatnonzero(stays)]
                as_row = lambda r: dict(zip(("start", "length", "period"), r))
                yield doc_id, len(words), [as_row(r) for r in runs], best and as_row(best), b" ".join(kept)

        return step

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return map_rows(given, make, f"doc_id long, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string")


def run_digest(docs: DataFrame) -> DataFrame:
    """Runs of ``docs`` with looped tails, as counts, the strongest run and checksums."""
    found = periodic_runs(docs, loop_tail)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = [F.col(f"strongest.{name}").alias(name) for name in ("start", "length", "period")]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best,
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
