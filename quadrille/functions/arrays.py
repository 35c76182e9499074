"""Predicates of kernel.py on numpy arrays, with the same results, for blocks in which all is compared with all. Null is NaN."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .kernel import TOLERANCE

#: Pairs that are looked at in one step, so that what is calculated stays in the cache.
STEP = 65_536


def _distance(a, b) -> np.ndarray:
    dx, dy = b[0] - a[0], b[1] - a[1]
    return np.sqrt(dx * dx + dy * dy)


def _turn(a, b, c) -> np.ndarray:
    value = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    slack = TOLERANCE * np.fmax(1.0, _distance(a, b) * _distance(a, c))
    return (value > slack).astype(np.int8) - (value < -slack).astype(np.int8)


def _on(p, a, b) -> np.ndarray:
    slack = TOLERANCE * np.fmax(1.0, _distance(a, b))
    found = _turn(a, b, p) == 0
    for k in (0, 1):
        found &= (p[k] >= np.fmin(a[k], b[k]) - slack) & (p[k] <= np.fmax(a[k], b[k]) + slack)
    return found


def meet(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether the segments of two arrays of lines ax, ay, bx, by meet, place by place: kernel.segments_meet."""
    a, b, c, d = s[:2], s[2:], t[:2], t[2:]
    proper = (_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a) * _turn(c, d, b) < 0)
    return proper | _on(a, c, d) | _on(b, c, d) | _on(c, a, b) | _on(d, a, b)


def meeting(s: np.ndarray, t: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Which segments of s meet which of t, or of s itself (each pair once): (first line, first column, matrix).

    The four turns of a pair are matrix products. Where all lie further from 0 than any tolerance here and than the rounding of the products, their
    signs decide; the other pairs are tested by meet()."""
    own = t is None
    t = s if own else t
    with np.errstate(all="ignore"):
        both = np.nan_to_num(np.concatenate((s, t), axis=1))
        x, y = both[0::2], both[1::2]
        centre = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
        across = float(np.hypot(x.max() - x.min(), y.max() - y.min()))
        length = float(np.hypot(both[2] - both[0], both[3] - both[1]).max())
        sure = 1.001 * TOLERANCE * max(1.0, length * across) + 1e-14 * length * (across + float(np.abs(both).max()))
        (ax, ay, bx, by), (cx, cy, dx, dy) = ((f[0] - centre[0], f[1] - centre[1], f[2] - centre[0], f[3] - centre[1]) for f in (s, t))
        ux, uy, vx, vy, one = bx - ax, by - ay, dx - cx, dy - cy, np.ones
        line, ends = np.stack((ux, uy, uy * ax - ux * ay), axis=1), [np.stack((ay, -ax, one(ax.size)), axis=1), np.stack((by, -bx, one(bx.size)), axis=1)]
        to_ends, to_line = [np.stack((cy, -cx, one(cx.size))), np.stack((dy, -dx, one(dx.size)))], np.stack((vx, vy, vy * cx - vx * cy))
        n, m, at = s.shape[1], t.shape[1], 0
        held = [np.empty(max(STEP, m)) for _ in range(5)]
        while at < n:
            low = at if own else 0
            wide = m - low
            end = min(n, at + max(1, STEP // wide))
            p, q, turned, other, least = (f[: (end - at) * wide].reshape(end - at, wide) for f in held)
            hit = None
            for left, right in (((line, to_ends[0]), (line, to_ends[1])), ((ends[0], to_line), (ends[1], to_line))):
                np.matmul(left[0][at:end], left[1][:, low:], out=turned)
                np.matmul(right[0][at:end], right[1][:, low:], out=other)
                np.multiply(turned, other, out=p)
                apart = p < 0
                hit = apart if hit is None else hit & apart
                np.abs(turned, out=turned)
                np.abs(other, out=other)
                np.minimum(turned, other, out=q if hit is apart else turned)
                if hit is not apart:
                    np.minimum(q, turned, out=least)
            close = ~(least > sure)
            if own:
                close[:, : end - at] &= np.triu(np.ones((end - at, end - at), bool), 1)
                hit[:, : end - at] &= np.triu(np.ones((end - at, end - at), bool), 1)
            i, j = np.nonzero(close)
            if i.size:
                hit[i, j] = meet(s[:, at + i], t[:, low + j])
            yield at, low, hit
            at = end


def within(s: np.ndarray, t: np.ndarray | None, eps: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Which points (lines x, y) of s are within eps of which of t, or of s itself (each pair once, none with itself), as meeting() gives it."""
    own = t is None
    t = s if own else t
    n, m, at = s.shape[1], t.shape[1], 0
    while at < n:
        low = at if own else 0
        end = min(n, at + max(1, STEP // max(1, m - low)))
        x, y = (t[k][None, low:] - s[k][at:end, None] for k in (0, 1))
        x *= x
        y *= y
        x += y
        hit = x <= eps * eps
        if own:
            hit[:, : end - at] &= np.triu(np.ones((end - at, end - at), bool), 1)
        yield at, low, hit
        at = end


def united(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels `top` (the least node of each node's set) after the sets of a and b are joined, pair by pair."""
    while True:
        open_ = top[a] != top[b]
        if not open_.any():
            return top
        a, b = a[open_], b[open_]
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        top = top.copy()
        np.minimum.at(top, high, low)  # only labels themselves move, so no node leaves its set
        while ((further := top[top]) != top).any():
            top = further
