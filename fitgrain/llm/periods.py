"""Periodic runs of words, caught online: completed blocks of 2, 4, 8, … words wait for their copies as words are appended."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fitgrain.llm.common import raw, texts

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Words appended at once, at least; results do not depend on it.
APPEND = 4096
#: One text in so many gets a planted period, by a checksum of its id.
PLANT_EVERY = 10

Run = tuple[int, int, int]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of blocks from those of their halves."""
    both = left * np.uint64(0x9E3779B97F4A7C15) + right
    both ^= both >> np.uint64(29)
    return both * np.uint64(0xBF58476D1CE4E5B9)


class Level:
    """Hashes of all blocks of ``size`` words, for catchers that wait ``least`` to ``most`` words away."""

    def __init__(self, size: int, least: int, most: int) -> None:
        self.size, self.least, self.most = size, least, most
        self.first, self.hashes, self.checked = 0, np.zeros(0, np.uint64), 0

    @property
    def end(self) -> int:
        return self.first + len(self.hashes)

    def retire(self, ahead: int) -> None:
        """Drop hashes that no catcher and no larger block, made up to ``ahead``, needs again."""
        gone = min(self.end - self.most - self.size, ahead) - self.first
        if gone > len(self.hashes) // 2:
            self.hashes, self.first = self.hashes[gone:].copy(), self.first + gone

    def caught(self) -> tuple[np.ndarray, np.ndarray]:
        """``(position, distance)`` of new blocks equal to an aligned one whose catcher waits there, by position."""
        at = np.arange(self.checked, self.end)
        self.checked = self.end
        found = []
        for back in range((self.most - self.least) // self.size + 1 if self.most >= self.least else 0):
            origin = ((at - self.least) // self.size - back) * self.size
            waits = (origin >= 0) & (at - origin <= self.most)
            here, there = at[waits], origin[waits]
            same = self.hashes[here - self.first] == self.hashes[there - self.first]
            found.append(np.stack([here[same], here[same] - there[same]]))
        if not found:
            return at[:0], at[:0]
        both = np.concatenate(found, axis=1)
        return tuple(both[:, np.argsort(both[0], kind="stable")])


class RunCatcher:
    """Finds runs while words are appended.

    A run of period p repeats at distance p over at least ``(min_periods - 1)``
    times p words, and over that share of ``min_length``. Such a stretch
    holds an aligned block of any power of two whose double is at most one
    longer; the largest is the block of period p. The catcher of a completed
    block compares each appended word's suffix of its size with it, as long as
    their distance is one of its periods. What it catches is compared on to
    the left, and to the right as far as there are words and again with each
    append. Catches inside a known stretch of their period or a divisor merge
    into it.
    """

    def __init__(self, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> None:
        if min_periods < 2:
            raise ValueError("a run has two periods at least")
        self.min_length, self.min_periods = min_length, min_periods
        self.words, self.n = np.zeros(0, np.int64), 0
        self.levels = [self._level(1)]
        self.open: dict[int, tuple[int, int]] = {}
        self.closed: list[Run] = []

    def _level(self, size: int) -> Level:
        """The level of a block size, with the periods whose block it is."""
        times, least_stretch = self.min_periods - 1, self.min_length * (self.min_periods - 1) // self.min_periods
        below = -(-(4 * size - 1) // times)
        if 4 * size - 1 <= least_stretch:
            return Level(size, 1, 0)
        return Level(size, 1 if 2 * size - 1 <= least_stretch or size == 1 else -(-(2 * size - 1) // times), below - 1)

    def append(self, more: np.ndarray) -> None:
        """Append words, given as numbers of at least 0."""
        if self.n + len(more) > len(self.words):
            self.words = np.concatenate([self.words[: self.n], np.zeros(max(self.n, len(more)), np.int64)])
        self.words[self.n : self.n + len(more)] = more
        self.n += len(more)
        for period, (start, end) in list(self.open.items()):
            del self.open[period]
            self._keep(start, end + self._same(end, period, 1), period)
        level = self.levels[0]
        level.hashes = np.concatenate([level.hashes, (more.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)])
        for number in range(1, 64):
            self._catch(level)
            if number == len(self.levels):
                above = self._level(2 * level.size)
                if self.n < above.least + above.size:
                    break
                self.levels.append(above)
            above = self.levels[number]
            start, stop = above.end - level.first, len(level.hashes) - level.size
            if start < stop:
                above.hashes = np.concatenate([above.hashes, _joined(level.hashes[start:stop], level.hashes[start + level.size :])])
            level.retire(above.end)
            level = above

    def _catch(self, level: Level) -> None:
        """Follow the level's new catches; those of a known stretch are left out."""
        positions, distances = level.caught()
        if not len(positions):
            return
        new = np.ones(len(positions), bool)

        def merge(start: int, end: int, period: int) -> None:
            lo, hi = np.searchsorted(positions, [start + period, end - level.size + 1])
            if lo < hi:
                new[lo:hi] &= (distances[lo:hi] % period != 0) | (positions[lo:hi] - distances[lo:hi] < start)

        for start, length, period in self.closed:
            if start + length > positions[0]:
                merge(start, start + length, period)
        for period, (start, end) in self.open.items():
            merge(start, end, period)
        k = 0
        while new[k:].any():
            k += int(np.argmax(new[k:]))
            new[k] = False
            at, period = int(positions[k]), int(distances[k])
            end = at + self._same(at, period, 1)
            if end < at + level.size:
                continue
            start = at - period - self._same(at - 1, period, -1)
            self._keep(start, end, period)
            merge(start, end, period)

    def _same(self, at: int, period: int, step: int) -> int:
        """How many words from ``at`` on, to the right or left, equal those ``period`` before them."""
        most = self.n - at if step > 0 else at - period + 1
        count, width = 0, 16
        while count < most:
            width = min(2 * width, most - count)
            lo = at + count if step > 0 else at - count - width + 1
            same = self.words[lo : lo + width] == self.words[lo - period : lo - period + width]
            if not same.all():
                return count + int(np.argmin(same[::step]))
            count += width
        return count

    def _keep(self, start: int, end: int, period: int) -> None:
        """A stretch up to the last word stays open; another is a run if it is long enough."""
        if end == self.n:
            self.open[period] = start, end
        elif end - start >= max(self.min_length, self.min_periods * period):
            self.closed.append((start, end - start, period))

    def runs(self) -> list[Run]:
        """``(start, length, period)`` of the runs in the words so far, by start and period.

        A stretch found with several periods is a run of the smallest.
        """
        least: dict[tuple[int, int], int] = {}
        still = ((start, end - start, period) for period, (start, end) in self.open.items())
        for start, length, period in [*self.closed, *still]:
            if length >= max(self.min_length, self.min_periods * period):
                least[start, length] = min(period, least.get((start, length), period))
        return sorted(((start, length, period) for (start, length), period in least.items()), key=lambda r: (r[0], r[2]))


def word_runs(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[Run]:
    """The runs of a whole text's words. A long text is appended in ever larger pieces."""
    if len(words) < min_length:
        return []
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    catcher = RunCatcher(min_length, min_periods)
    while catcher.n < len(ids):
        catcher.append(ids[catcher.n : catcher.n + max(APPEND, catcher.n // 2)])
    return catcher.runs()


def planted(doc_id: int | None, words: list) -> list:
    """The words, of one text in ten with a tail made periodic by a rule of its id; a row without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % PLANT_EVERY or not n:
        return words
    g = h // PLANT_EVERY
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without what each run repeats after its first period."""
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep) if k]


SCHEMA = pa.schema([
    *((c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])


def run_row(doc_id: int | None, text: bytes, change: Callable[[int | None, list], list] | None, min_length: int, min_periods: int) -> tuple:
    words = text.split()
    if change:
        words = change(doc_id, words)
    runs = word_runs(words, min_length, min_periods)
    best = (None,) * 4
    if runs:
        start, length, period = runs[0]
        for s, n, p in runs[1:]:
            if n * period > length * p:
                start, length, period = s, n, p
        best = start, length, period, 1000 * length // period
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return doc_id, len(runs), *best, sha256(listed.encode()).hexdigest(), sha256(b" ".join(collapsed(words, runs))).hexdigest()


def periodic_runs(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, change: Callable[[int | None, list], list] | None = None
) -> DataFrame:
    """The runs of each row's words: their number, the run of greatest exponent, and digests of all runs and of the words kept.

    Words are the runs of characters other than ASCII white space. ``change``
    may replace a row's words first. Null, empty and blank texts have no words
    and no run; so have texts of under ``min_length`` words. Each row is judged
    by itself, so repeated rows, rows without an id and an empty table need no
    rule. The work grows with the words times the logarithm of their number.
    """
    names = SCHEMA.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [run_row(d, t, change, min_length, min_periods) for d, t in zip(batch.column(0).to_pylist(), raw(batch.column(1)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    layout = ", ".join(f"{c} {'string' if c.endswith('256') else 'long'}" for c in names)
    return texts(documents, id_col, text_col).mapInArrow(run, layout)
