"""Content-defined frames for exact repeats of ``window`` tokens, without a row for each position.

A window of w tokens is anchored at the position of its smallest k-token fingerprint (leftmost of equals).
The anchor's place in a window depends on the window's content alone, so equal windows have equal
anchors at equal offsets, and it is enough to compare windows that hang on equal anchors. Consecutive
windows mostly share an anchor: a table of anchors has about 2 / (w - k) of the positions' rows.

An anchor at q with windows starting at q-hi..q-lo ("offsets" lo..hi) is a frame. Its hood is the text that
its windows cover together. Equal hoods (with equal lo, hi) are equal window by window.
"""

from __future__ import annotations

import numpy as np

from .flat import Ranges, segments, sliding

#: Offsets are compared in blocks of this many (half a window at most) before they are compared one by one.
STEP = 32
_SEGMENT = 1 << 22


def anchors(tokens: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """(row, q, first window start, last window start, anchor fingerprint, hood rank pair), positions within the row."""
    parts = []
    if len(offsets) == 2 and len(tokens) > _SEGMENT + window:
        pieces = ((a, b, np.array([0, b - a])) for a, b in segments(offsets, _SEGMENT, window - 1))
    else:
        pieces = [(0, len(tokens), offsets)]
    for low, high, off in pieces:
        row, q, a, b, h, r1, r2 = _anchors(tokens[low:high], off, window, k)
        base = off[row] - low
        parts.append((row, q - base, a - base, b - base, h, r1, r2))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _anchors(tokens, offsets, window, k):
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < window:
        return [none] * 7
    names = Ranges(tokens)
    grams = names.every(k)
    width = window - k + 1
    least = sliding(grams, width)
    row_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    row = row_of[: len(least)]
    whole = row == row_of[window - 1 :]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(least)) - 1
    good = whole[start]
    start, end = start[good], end[good]
    if not len(start):
        return [none] * 7
    # where the minima stand: positions that are the least of some window
    most = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero(most[: len(grams)] == grams)
    value, rank = np.unique(grams[at], return_inverse=True)
    key = rank.astype(np.int64) * (n + 1) + at
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    code = np.searchsorted(value, least[start]).astype(np.int64) * (n + 1)
    low, high = np.searchsorted(key, code + start), np.searchsorted(key, code + end)
    times = high - low + 1  # a run of windows with equal minima is cut where an occurrence of the minimum ends
    which = np.repeat(np.arange(len(start)), times)
    first = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) == 0
    q = at[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]]
    a = np.where(first, start[which], np.append(0, q[:-1]) + 1)
    b = np.minimum(end[which], q)
    r1, r2 = names.pair(a, b + window - a)
    return row_of[a].astype(np.int64), q, a, b, grams[q].view(np.int64), r1, r2


def blocks(names: Ranges, q, lo, hi, window: int):
    """A row for each block of STEP offsets that a frame's windows touch.

    (frame, block, first and last offset within it, names of the core's four parts, rank pair of the hood.)
    The core is what all windows of the whole block have in common: windows differ if their cores do. Its parts are its
    first eighth, the second, the second quarter and the second half, so that each is as long as all before it.
    """
    step = min(STEP, window // 2)
    j0, j1 = lo // step, hi // step
    times = j1 - j0 + 1
    frame = np.repeat(np.arange(len(q)), times)
    j = np.arange(len(frame)) - np.repeat(np.cumsum(times) - times, times) + j0[frame]
    vlo, vhi = np.maximum(lo[frame], j * step), np.minimum(hi[frame], j * step + step - 1)
    at, size = q[frame] - j * step, window - step + 1
    cut = [0, size // 8, size // 4, size // 2, size]
    parts = [names.of(at + x, at + y).view(np.int64) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    hood = names.pair(q[frame] - vhi, window + vhi - vlo)
    return frame, j, vlo, vhi, parts, hood


def single(names: Ranges, q, lo, hi, window: int):
    """A row for each window of blocks: (item, offset, names of what it has on the left and on the right of its block's core)."""
    times = hi - lo + 1
    frame = np.repeat(np.arange(len(q)), times)
    o = np.arange(len(frame)) - np.repeat(np.cumsum(times) - times, times) + lo[frame]
    step = min(STEP, window // 2)
    core = q[frame] - o // step * step
    start = q[frame] - o
    return frame, o, (names.of(start, core).view(np.int64), names.of(core + window - step + 1, start + window).view(np.int64))


def suffixes(names: Ranges, q, lo, hi, window: int):
    """A row for each window start: (frame, offset, names of its prefixes of a quarter, half and whole of the window's length)."""
    times = hi - lo + 1
    frame = np.repeat(np.arange(len(q)), times)
    o = np.arange(len(frame)) - np.repeat(np.cumsum(times) - times, times) + lo[frame]
    start = q[frame] - o
    return frame, o, [names.of(start, start + n).view(np.int64) for n in (max(window // 4, 1), max(window // 2, 1), window)]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, as maximal spans in order (touching ones are one)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
