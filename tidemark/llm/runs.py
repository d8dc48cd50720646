"""Stretches of a text that repeat with a period: harmonic grid probing.

A run of period p and at least 4p words has equal words p apart along 3p places or more,
so three multiples of p in a row lie there: probing word jp against word (j+1)p for every
p and j, n ln n probes in all, misses none. Periods up to the root of n are probed one by
one along their grid, larger ones together, one step j at a time. Survivors are thinned
by probes in between and extended both ways by comparing chunks; grid points in a run
already found, of a period that divides p, are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame

from .common import append, columns_of
from .interactions import word_lists

_CHUNK = 64


def _forward(c: np.ndarray, k: int, p: int) -> int:
    """The first place from k on whose word is not that p further, or the last such place of the text + 1."""
    end, step = len(c) - p, _CHUNK
    while k < end:
        to = min(k + step, end)
        differ = c[k:to] != c[k + p:to + p]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, step = to, min(2 * step, 1 << 16)
    return end


def _backward(c: np.ndarray, k: int, p: int) -> int:
    """The first place of the stretch, up to k, of words that equal those p further."""
    step = _CHUNK
    while k > 0:
        to = max(k - step, 0)
        differ = (c[to:k] != c[to + p:k + p])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return k - at
        k, step = to, min(2 * step, 1 << 16)
    return 0


def _prime_factors(p: int) -> list[int]:
    out, f = [], 2
    while f * f <= p:
        if p % f == 0:
            out.append(f)
            while p % f == 0:
                p //= f
        f += 1
    return out + [p] if p > 1 else out


class _Found:
    """The runs of one text so far; periods must come in ascending order."""

    def __init__(self, c: np.ndarray):
        self.c, self.runs = c, []
        self.period, self.end = np.zeros(len(c), dtype=np.int32), np.zeros(len(c), dtype=np.int64)

    def left(self, at: np.ndarray, p: np.ndarray | int) -> np.ndarray:
        """Which survivors (grid points `at` of periods p) to extend: not those in a known run whose period divides p, nor those that differ in between."""
        q = self.period[at]
        keep = (q == 0) | (p % np.maximum(q, 1) != 0) | (at + p >= self.end[at])
        for num, den in ((1, 2), (3, 2), (1, 4), (5, 4), (3, 4), (7, 4)):
            k = at[keep] + (p if isinstance(p, int) else p[keep]) * num // den
            keep[keep] = self.c[k] == self.c[k + (p if isinstance(p, int) else p[keep])]
        return keep

    def extend(self, at: np.ndarray, p: int) -> None:
        c, i = self.c, 0
        at = at[self.left(at, p)]
        while i < len(at):
            k = int(at[i])
            e, s = _forward(c, k, p) + p, _backward(c, k, p)
            if e - s >= max(6, 4 * p) and not any(_forward(c, s, p // f) + p // f >= e for f in _prime_factors(p)):
                self.runs.append((s, e - s, p))
                free = self.period[s:e] == 0
                self.period[s:e][free], self.end[s:e][free] = p, e
            i = max(i + 1, int(np.searchsorted(at, e - p)))


def find_runs(c: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word array, by start, then period.

    A run: consecutive words of smallest period p, max(6, 4p) or more of them, that no neighbour extends.
    """
    n = len(c)
    if n < 6:
        return []
    found, top, root = _Found(c), n // 4, isqrt(n)
    for p in range(1, min(root, top) + 1):
        grid = c[::p]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
        if len(at):
            found.extend(at, p)
    low, kept = root + 1, []
    before = earlier = None
    for j in range((n - 1) // low if top >= low else 0):
        high = min(top, (n - 1) // (j + 1))  # periods low..high have grid points j and j + 1
        if high < low:
            break
        a = c[j * low:j * high + 1:j] if j else c[0]
        same = a == c[(j + 1) * low:(j + 1) * high + 1:j + 1]
        if earlier is not None:
            at = np.flatnonzero(same & before[:len(same)] & earlier[:len(same)])
            if len(at):
                p = at + low
                k = (j - 2) * p
                keep = found.left(k, p)
                if keep.any():
                    kept.append((p[keep], k[keep]))
        earlier, before = before, same
    if kept:
        p, k = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((k, p))
        p, k = p[order], k[order]
        for own in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
            found.extend(k[own], int(p[own[0]]))
    return sorted(found.runs, key=lambda r: (r[0], r[2]))


def scan(text: str | None, repeat: Callable[[int], tuple[int, int] | None] = lambda n: None) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs and collapsed text; repeat(n) may give (a, p): words from a on are then words a to a + p - 1 over and over."""
    number: dict[bytes, int] = {}
    codes = [np.fromiter((number.setdefault(w, len(number)) for w in ws), dtype=np.int32, count=len(ws)) for ws in word_lists((text or "").encode())]
    c = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int32)
    n = len(c)
    if n and (change := repeat(n)):
        a, p = change
        c = np.concatenate([c[:a], c[a + np.arange(n - a) % p]])
    runs = find_runs(c)
    kept = np.ones(n, dtype=bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    words = list(number)
    c = c[kept]
    pieces = [b" ".join([words[i] for i in c[k:k + (1 << 16)]]) for k in range(0, len(c), 1 << 16)]
    return n, runs, b" ".join(pieces).decode()


def periodic_runs(docs: DataFrame, repeat: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """docs(doc_id, text) with n_words, runs (array of start, length, period in words) and collapsed.

    Words are maximal runs of characters other than U+0020 and U+0009 to U+000D, of the
    whole text. Runs are as in find_runs(), by start, then period. Collapsed is the text,
    words joined by one space, without the words of a run after its first period. A null
    or empty text has no words, no runs and an empty collapsed text. repeat(doc_id, n)
    may plant a repetition, as in scan(). Every row gives one row, ids null or repeated or
    not; the other columns stay, but for those of the new names, which are replaced.
    """
    d = docs.drop("n_words", "runs", "collapsed")
    plant = repeat or (lambda doc_id, n: None)

    def make():
        def of(ids: list[int | None], texts: list[str | None]) -> Iterator[list]:
            out = [scan(t, lambda n, i=i: plant(i, n)) for i, t in zip(ids, texts, strict=True)]
            return [[o[0] for o in out], [[{"start": s, "length": m, "period": p} for s, m, p in o[1]] for o in out], [o[2] for o in out]]

        return of

    return append(d, ["doc_id", "text"], "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", make, ("text",))


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) through periodic_runs() with a repetition planted where crc32 of the decimal doc_id ends in 0; a null id has none."""

    def repeat(doc_id: int | None, n: int) -> tuple[int, int] | None:
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is None or h % 10:
            return None
        g = h // 10
        a = g % n
        return a, 1 + (n - a) // (3 + g % 8)

    return periodic_runs(columns_of(docs, "doc_id", "text"), repeat)
