"""Vectorised rolling hashes and winnowing over code points.

A text is an array of code points.  ``window_hashes`` gives a 64-bit hash of every k-gram, ``winnow`` picks from each
stretch of ``w`` consecutive k-grams the smallest hash (the rightmost of equal ones).  Two texts that have a run of
``k + w - 1`` equal characters therefore have a picked k-gram of that run in common, whatever stands around it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, factor in ((up, base), (down, inverse)):
        out[0] = 1
        filled = 1
        while filled < n:  # doubling: the next stretch is the known one times base**filled
            step = min(filled, n - filled)
            out[filled : filled + step] = out[:step] * np.uint64(pow(factor, filled, 1 << 64))
            filled += step
    return up, down


def window_hashes(points: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hash of ``points[i:i + k]`` for each i (uint64; empty if there are fewer than k points)."""
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64)
    size = 1 << max(10, int(n).bit_length())
    up, down = _powers(size, (_BASE + 2 * salt) & _MASK)
    with np.errstate(over="ignore"):
        terms = mix(points.astype(np.uint64) + np.uint64(0x51ED27 + salt)) * up[:n]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each j, the place of the smallest of ``h[j:j + w]`` (the rightmost of equal ones)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    rows = -(-len(h) // w)
    top = np.uint64(_MASK)
    a = np.full(rows * w, top, np.uint64)
    a[: len(h)] = h
    a = a.reshape(rows, w)
    at = np.arange(rows * w, dtype=np.int64).reshape(rows, w)
    low = np.minimum.accumulate(a, axis=1)
    low_at = np.maximum.accumulate(np.where(a == low, at, -1), axis=1)
    back = a[:, ::-1]
    tail = np.minimum.accumulate(back, axis=1)
    fresh = np.ones_like(back, bool)
    fresh[:, 1:] = back[:, 1:] < tail[:, :-1]
    big = rows * w
    tail_at = np.minimum.accumulate(np.where(fresh, at[:, ::-1], big), axis=1)[:, ::-1].ravel()
    tail, low, low_at = tail[:, ::-1].ravel(), low.ravel(), low_at.ravel()
    j = np.arange(n)
    end = j + w - 1
    whole = j % w == 0  # the window is a block: its prefix minimum is the answer
    return np.where(whole | (low[end] <= tail[j]), low_at[end], tail_at[j])


def winnow(points: np.ndarray, starts: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picked k-grams of several texts laid end to end.

    ``starts`` has the first place of each text and, last, the total length.  Returns the text number, the place
    within the text and the hash of each pick, in order.  Windows that span two texts are left out.
    """
    h = window_hashes(points, k)
    picks = sliding_argmin(h, w)
    if not len(picks):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    j = np.arange(len(picks))
    text = np.searchsorted(starts, j, side="right") - 1
    inside = j + (k + w - 1) <= starts[text + 1]
    picks, text = picks[inside], text[inside]
    if not len(picks):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    keep = np.ones(len(picks), bool)
    keep[1:] = (picks[1:] != picks[:-1]) | (text[1:] != text[:-1])
    picks, text = picks[keep], text[keep]
    return text, picks - starts[text], h[picks]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
