"""Sorting suffixes with a difference cover.

The suffixes of a block of text, compared over their first `depth` bytes. A sample of positions, those whose remainder modulo
PERIOD lies in a difference cover, is ranked beforehand over `depth - PERIOD` bytes. Suffixes are then sorted one bucket
of first bytes at a time: by PERIOD bytes, and ties by the rank of the sample positions that lie at the same distance behind
both suffixes (a cover has one within PERIOD), then by the last PERIOD bytes. So no comparison looks at more than two short pieces
of text however long the common beginning is, and a bucket's memory is bounded.
"""

from __future__ import annotations

import numpy as np

PERIOD = 80
#: Suffixes that are sorted at once.
BUCKET = 1 << 17


def cover(period: int = PERIOD) -> np.ndarray:
    """Remainders of which any two differ by every number modulo `period`: the first root-many and every root-th."""
    root = int(np.ceil(period**0.5))
    return np.unique(np.concatenate([np.arange(root), np.arange(0, period + root, root) % period]))


def shifts(period: int = PERIOD) -> np.ndarray:
    """For two remainders, the least distance behind both at which both meet the cover."""
    inside = np.isin(np.arange(period), cover(period))
    both = np.zeros((period, period), np.int16)
    for i in range(period):
        for j in range(period):
            k = np.arange(period)
            both[i, j] = np.argmax(inside[(i + k) % period] & inside[(j + k) % period])
    return both


SHIFTS, INSIDE = shifts(), np.isin(np.arange(PERIOD), cover())


def pieces(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The PERIOD bytes from each place, as strings that compare by bytes."""
    windows = np.lib.stride_tricks.sliding_window_view(text, PERIOD)
    return windows[at].view(f"S{PERIOD}").ravel()


def ranks(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.unique(pieces(text, at), return_inverse=True)[1]


def sample_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the sample the rank of the `depth - PERIOD` bytes from there; -1 elsewhere. `depth` is five periods:
    the ranks of one period are doubled twice, each time with those of the place where the first half ends."""
    assert depth == 5 * PERIOD
    at = np.arange(len(text) - PERIOD + 1)
    at = at[INSIDE[at % PERIOD]]
    rank = np.full(len(text) + depth, -1, np.int64)
    rank[at] = ranks(text, at)
    for half in (PERIOD, 2 * PERIOD):
        at = at[rank[at + half] >= 0]
        pair = rank[at] * (len(text) + 1) + rank[at + half]
        rank = np.full(len(text) + depth, -1, np.int64)
        rank[at] = np.unique(pair, return_inverse=True)[1]
    return rank


def classes(text: np.ndarray, suffixes: np.ndarray, depth: int = 5 * PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in sorted order, and for each the number of its class: suffixes of a class have `depth` equal bytes. Every
    suffix must have `depth` bytes in `text`."""
    rank = sample_ranks(text, depth)
    order = np.argsort(text[suffixes].astype(np.int64) << 8 | text[suffixes + 1], kind="stable")
    suffixes = suffixes[order]
    head = text[suffixes].astype(np.int64) << 8 | text[suffixes + 1]
    begins = np.flatnonzero(np.diff(head, prepend=-1))
    out, of, classes_so_far, begin = [], [], 0, 0
    while begin < len(suffixes):  # buckets: suffixes with the same two bytes stay together
        later = begins[begins > begin]
        fitting = later[later <= begin + BUCKET]
        end = int(fitting[-1]) if len(fitting) else int(later[0]) if len(later) else len(suffixes)
        if len(suffixes) - begin <= BUCKET:
            end = len(suffixes)
        own, number = _bucket(text, suffixes[begin:end], rank, depth)
        out.append(own)
        of.append(number + classes_so_far)
        classes_so_far += int(number[-1]) + 1
        begin = end
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out]), np.concatenate([empty, *of])


def _bucket(text: np.ndarray, suffixes: np.ndarray, rank: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One bucket in sorted order with class numbers from 0. Ties are split about a pivot, all groups of ties at once."""
    key = ranks(text, suffixes)  # where a suffix's group begins in the sorted order, once groups have places
    order = np.argsort(key, kind="stable")
    at, key = suffixes[order], key[order]
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    start = np.repeat(begins, np.diff(np.append(begins, len(at))))  # the first place of each suffix's group
    open_ = np.ones(len(at), bool)
    while True:
        begins, sizes = np.unique(start, return_counts=True)
        size = np.repeat(sizes, sizes)
        active = np.flatnonzero(open_ & (size > 1))
        if not len(active):
            break
        pivot = at[start[active] + size[active] // 2]
        own = at[active]
        k = SHIFTS[own % PERIOD, pivot % PERIOD]
        left, right = rank[own + k], rank[pivot + k]
        compared = np.sign(left - right)
        same = np.flatnonzero(compared == 0)
        if len(same):
            tail = depth - PERIOD
            a, b = pieces(text, own[same] + tail), pieces(text, pivot[same] + tail)
            compared[same] = np.where(a < b, -1, np.where(a == b, 0, 1))
        moved = np.lexsort((compared, start[active]))
        at[active] = own[moved]
        group, compared = start[active], compared[moved]
        open_[active] = compared != 0  # equal to the pivot: a whole class
        change = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(compared, prepend=2) != 0))
        start[active] = np.repeat(active[change], np.diff(np.append(change, len(active))))
    return at, np.unique(start, return_inverse=True)[1]
