"""Peaks of a stretch of a series: the distance rule on a grid, and records that lead from one stretch to the next."""

from __future__ import annotations

import numpy as np

OPEN, KEPT, DROPPED = range(3)


def settle(i: np.ndarray, v: np.ndarray, state: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """States of peaks at the places ``i`` with heights ``v``: higher ones, of equal ones the later, drop those nearer than ``distance``.

    Peaks that are not ``own`` may have unseen neighbours: they stay open unless one that is kept drops them, and own peaks beside an open
    higher one stay open too. A cell of the grid is one distance wide, so it holds one kept peak at most, and the first and last open
    one of a cell tell whether there is an open one near: constant work a peak.
    """
    state = state.copy()
    kept: dict[int, int] = {}
    opened: dict[int, tuple[int, int]] = {}
    for k in np.lexsort((i, v))[::-1].tolist():
        at = int(i[k])
        cell = at // distance
        if state[k] == OPEN:
            if any(abs(kept.get(c, at + distance) - at) < distance for c in (cell - 1, cell, cell + 1)):
                state[k] = DROPPED
                continue
            near = cell in opened or opened.get(cell - 1, (0, at - distance))[1] > at - distance or opened.get(cell + 1, (at + distance, 0))[0] < at + distance
            if not own[k] or near:
                low, high = opened.get(cell, (at, at))
                opened[cell] = (min(low, at), max(high, at))
            else:
                state[k] = KEPT
        if state[k] == KEPT:
            kept[cell] = at
    return state


def records(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seen from the end: values higher than all after them, nearest first, and the lowest value after each (infinite after the last)."""
    back = v[::-1]
    top = np.maximum.accumulate(back)
    which = np.flatnonzero(np.r_[True, back[1:] > top[:-1]]) if len(v) else np.zeros(0, int)
    return back[which], np.r_[np.inf, np.minimum.accumulate(back)][which]


def as_stretch(values: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """A short series with the same records: each record and then the lowest value after it (itself where none is), the farthest record first."""
    return np.stack([values, np.minimum(lows, values)], 1)[np.argsort(values, kind="stable")[::-1]].ravel()


def bases(x: np.ndarray) -> np.ndarray:
    """For each value, the lowest one since the last higher one before it: a stack of falling values, each with the lowest one it covers."""
    out, stack = np.empty(len(x)), []
    for i, v in enumerate(x.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        stack.append((v, low))
        out[i] = low
    return out


def prominences(v: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Prominence of each value of a stretch, with stretches that stand for what is before and after it (farthest record outermost)."""
    whole = np.concatenate([before, v, after[::-1]])
    here = slice(len(before), len(before) + len(v))
    return v - np.maximum(bases(whole)[here], bases(whole[::-1])[::-1][here])
