"""Periodic runs of words: every maximal stretch that repeats with some period, found on a harmonic grid.

A run of period p and at least 2p words covers a word at a multiple of p and the word p after it. So only the pairs (i, i + p) with i a
multiple of p are looked at: n/1 + n/2 + ... of them. How far the text agrees after and before both words of a pair is found for all pairs
at once, by bisection over prefix hashes in NumPy. Runs are verified word by word before they count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a run has at least.
LEAST = 12
#: Pairs that are looked at together; a text's memory stays within a few times this, beside its words.
_PAIRS = 1 << 18
_PRIMES = np.array([[2147483647], [2147483629]], np.int64)
_BASES = np.array([[1210893617], [1904216561]], np.int64)


class Prefixes:
    """Hashes of a sequence's substrings, by two primes; equal substrings are always found equal."""

    powers = np.ones((2, 1), np.int64)

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        if Prefixes.powers.shape[1] <= n:
            p = np.ones((2, 1), np.int64)
            step = _BASES
            while p.shape[1] <= n:  # the next half is the first half times its length's power
                p = np.concatenate((p, p * step % _PRIMES), axis=1)
                step = step * step % _PRIMES
            Prefixes.powers = p
        self.sums = np.zeros((2, n + 1), np.int64)
        np.cumsum((ids + 1) * Prefixes.powers[:, :n] % _PRIMES, axis=1, out=self.sums[:, 1:])

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the substrings at i and at j > i have equal hashes."""
        a = (self.sums[:, i + length] - self.sums[:, i]) % _PRIMES * Prefixes.powers[:, j - i] % _PRIMES
        return (a == (self.sums[:, j + length] - self.sums[:, j]) % _PRIMES).all(axis=0)

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from i and j on (forward), or before i and j, up to ``most``: one bisection for all pairs."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            ok = self.same(i, j, middle) if forward else self.same(i - middle, j - middle, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(periods, grid points) of all pairs in blocks; a block holds whole periods."""
    periods = np.arange(1, n // 2 + 1)
    ends = np.cumsum((n - 1) // periods)
    begin = 0
    while begin < len(periods):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + _PAIRS, "right")))
        p = periods[begin:end]
        times = (n - 1) // p
        before = np.cumsum(times) - times
        yield np.repeat(p, times), (np.arange(int(times.sum())) - np.repeat(before, times)) * np.repeat(p, times)
        begin = end


def _candidates(ids: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period), each stretch once with its smallest period, by start and period; not yet verified."""
    n, prefixes, found = len(ids), Prefixes(ids), []
    for p, i in _grid(n):
        keep = ids[i] == ids[i + p]  # the leftmost grid point of a run has its word p further on
        p, i = p[keep], i[keep]
        half = (p + 1) // 2  # what agrees before and after makes up p words, so one side has half of them
        after, before = i + p + half <= n, i >= half
        keep = np.zeros(len(p), bool)
        keep[after] = prefixes.same(i[after], (i + p)[after], half[after])
        before &= ~keep
        keep[before] = prefixes.same((i - half)[before], (i + p - half)[before], half[before])
        p, i = p[keep], i[keep]
        if len(p):
            left = prefixes.reach(i, i + p, np.minimum(i, p), False)
            keep = left < p  # with p words or more before it, the grid point before has the run
            p, i, left = p[keep], i[keep], left[keep]
            length = left + prefixes.reach(i, i + p, n - i - p, True) + p
            keep = length >= np.maximum(least, 2 * p)
            found.append(np.stack((i - left, length, p), axis=1)[keep])
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _is_run(ids: np.ndarray, start: int, length: int, period: int) -> bool:
    end = start + length
    same = np.array_equal(ids[start : end - period], ids[start + period : end])
    return same and (start == 0 or ids[start - 1] != ids[start - 1 + period]) and (end == len(ids) or ids[end] != ids[end - period])


def _compared(ids: np.ndarray, least: int) -> np.ndarray:
    """The same rows by comparing words for every period: for texts where hashes fail, if there ever are any."""
    seen: dict[tuple[int, int], int] = {}
    for p in range(1, len(ids) // 2 + 1):
        edge = np.diff(np.concatenate(([0], (ids[p:] == ids[:-p]).astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= p and b - a + p >= least:
                seen.setdefault((int(a), int(b - a + p)), p)
    return np.array(sorted((s, length, p) for (s, length), p in seen.items()), np.int64).reshape(-1, 3)


def runs_of(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers (0 to 2 ** 31), by start, then period."""
    if len(ids) < max(2, least):
        return np.zeros((0, 3), np.int64)
    rows = _candidates(ids, least)
    if not all(_is_run(ids, *map(int, r)) for r in rows):
        rows = _compared(ids, least)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(n: int, rows: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: in every run, the first period does."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col, n_words, runs, collapsed), one row for each row of ``docs``.

    Words are what spaces and the characters 9 to 13 part, numbered from 0. ``runs`` has (start, length, period) of every run by start,
    then period: a stretch that repeats with its smallest period, of at least ``least`` words and two periods, which no neighbouring word
    extends. ``collapsed`` joins by one space the words that no run contains after its first period. A null or empty text has no words.
    Repeated rows and ids are rows of their own; other columns are not read. Nothing is shuffled. Memory goes with the longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            sizes, lists, texts = [], [], []
            for body in batch.column("body"):
                words = body.as_py().split()
                known: dict[bytes, int] = {}
                rows = runs_of(np.array([known.setdefault(w, len(known)) for w in words], np.int64), least) if len(words) >= least else ()
                sizes.append(len(words))
                lists.append([{"start": s, "length": n, "period": p} for s, n, p in (map(int, r) for r in rows)])
                if len(rows):
                    words = [w for w, stays in zip(words, collapsed(len(words), rows), strict=True) if stays]
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(lists, shape), pa.array(texts, pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("id"), body.alias("body")).mapInArrow(work, schema).select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
