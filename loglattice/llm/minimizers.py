"""Content-chosen anchors: which windows of a sequence may repeat somewhere.

The least hash of the ``k``-grams in a window depends on the window's content alone, so equal windows have
equal minima.  Consecutive windows with one minimum form a run; the k-gram that has it is the run's
anchor.  A window can repeat only if the minimum of its run occurs in another run, or twice in its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Odd multipliers of the mixing steps; fixed values.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram of a sequence of unsigned numbers, by doubling."""
    h = (x.astype(np.uint64) + np.uint64(1)) * _A
    h ^= h >> np.uint64(32)
    size = 1
    while 2 * size <= k:
        right = h[size:]
        h = h[:-size] * _B + (right ^ (right >> np.uint64(29)))
        size *= 2
    if size < k:
        right = h[k - size :]
        h = h[: len(right)] * _A + (right ^ (right >> np.uint64(30))) * _B
    h = h * _C
    return h ^ (h >> np.uint64(31))


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``w`` consecutive values."""
    m, size = x, 1
    while 2 * size <= w:
        m = pick(m[:-size], m[size:])
        size *= 2
    return pick(m[: len(m) - (w - size)], m[w - size :]) if size < w else m


@dataclass
class Runs:
    """Runs of windows: the minimum, first and last window start, anchor start, and whether a window of
    the run may equal another window of it."""

    minimum: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    within: np.ndarray


_EMPTY = Runs(*[np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64, bool)])


def runs(x: np.ndarray, ends: np.ndarray, window: int, k: int) -> Runs:
    """Runs of all windows that lie inside one of the sequences that ``x`` has one after the other.

    ``ends`` are their ends.  A run has at most ``window - k + 1`` windows; what goes on is another run.
    """
    w = window - k + 1
    if len(x) < window:
        return _EMPTY
    h = gram_hashes(x, k)
    least = sliding(h, w, np.minimum)
    starts = np.append(0, ends[:-1])
    valid = np.zeros(len(least) + 1, dtype=np.int32)
    long_ = ends - starts >= window
    np.add.at(valid, starts[long_], 1)
    np.add.at(valid, ends[long_] - window + 1, -1)
    ok = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
    new[starts[long_]] = True
    new &= ok
    first = np.flatnonzero(new)
    if not len(first):
        return _EMPTY
    stop = np.flatnonzero(~ok)
    nexts = np.append(first[1:], len(least))
    if len(stop):
        at = np.searchsorted(stop, first)
        nexts = np.minimum(nexts, np.append(stop, len(least))[at])
    if (nexts - first).max() > w:  # a repeated anchor keeps the minimum longer than one anchor can
        parts = -(-(nexts - first) // w)
        which = np.repeat(np.arange(len(first)), parts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = first[which] + step * w
        nexts = np.minimum(nexts[which], first + w)
    last = nexts - 1
    value = least[first]

    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    spots = np.flatnonzero(sliding(padded, w, np.maximum) == h)
    at = np.searchsorted(spots, first)
    open_ = np.flatnonzero(h[spots[at]] != value)
    while len(open_):
        at[open_] += 1
        open_ = open_[h[spots[at[open_]]] != value[open_]]
    anchor = spots[at]
    after = np.minimum(at + 1, len(spots) - 1)
    within = (after > at) & (h[spots[after]] == value) & (spots[after] <= last + w - 1)
    return Runs(value, first, last, anchor, within)
