"""Points against edges in numpy: the predicates of :mod:`geometry`, for whole arrays.

Arrays are broadcast against each other.  The signs are the same as those of the SQL expressions, and the plain formulas
round as doubles do there.
"""

from __future__ import annotations

import math

import numpy as np

from .geometry import PLAIN

BOUND = float(PLAIN.rstrip("D"))
CUT = 134217729.0


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The products and what their rounding loses."""
    p, c, d = a * b, CUT * a, CUT * b
    c, d = c - (c - a), d - (d - b)
    return p, ((c * d - p) + c * (b - d) + (a - c) * d) + (a - c) * (b - d)


def orientation(x1, y1, x2, y2, x, y) -> np.ndarray:
    """1 where (x, y) lies left of the edge from (x1, y1) to (x2, y2), -1 right of it, 0 on its line: exactly."""
    left, right = (x1 - x) * (y2 - y), (y1 - y) * (x2 - x)
    det, bound = left - right, BOUND * (np.abs(left) + np.abs(right))
    sign = (det > bound).astype(np.int8) - (-det > bound)
    near = np.nonzero(np.abs(det) <= bound)
    if near[0].size:
        a, b, c, d, e, f = (np.broadcast_to(v, sign.shape)[near] for v in (x1, y1, x2, y2, x, y))
        terms = [t for u, v in ((a, d), (-a, f), (-e, d), (-b, c), (b, e), (f, c)) for t in _products(u, v)]
        sign[near] = [(s > 0) - (s < 0) for s in map(math.fsum, zip(*(t.tolist() for t in terms)))]
    return sign


def is_left(sign: np.ndarray, x1, y1, x2, y2) -> np.ndarray:
    """Whether the point, moved right by an infinitely small step and up by one smaller still, lies left of the edge; ``sign`` is its orientation."""
    return (sign > 0) | ((sign == 0) & ((y2 < y1) | ((y2 == y1) & (x2 > x1))))


def plain_left(x1, y1, x2, y2, x, y) -> np.ndarray:
    """Whether the edge is met on the way to the right, by the usual formula in doubles; for edges that pass the ordinate."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return x < (x2 - x1) * (y - y1) / (y2 - y1) + x1


def touched(x1, y1, x2, y2, x, y, plain: bool, sign: np.ndarray | None = None) -> np.ndarray:
    """Whether the point lies on the edge, by the sign of its exact or its plain determinant."""
    near = (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
    if plain:
        return near & ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0)
    if sign is None:
        sign = orientation(x1, y1, x2, y2, x, y)
    return near & (sign == 0)


def meets(x1, y1, x2, y2, left, x, y, my: float, plain: bool, boundary: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Whether an edge is met an odd number of times on the way from a point to the centre of its cell, whose ordinate is
    ``my`` and whose side of the edge is ``left``; and whether the point lies on it.

    The way goes up or down first, then across.  Both parts meet in a corner, whose side of an edge is one exact
    answer for both.  ``plain`` sides differ from exact ones next to an edge only: those edges are counted once more.
    """
    own = orientation(x1, y1, x2, y2, x, y)
    side, corner = is_left(own, x1, y1, x2, y2), is_left(orientation(x1, y1, x2, y2, x, my), x1, y1, x2, y2)
    met = (((x1 > x) != (x2 > x)) & (side != corner)) ^ (((y1 > my) != (y2 > my)) & (corner != left))
    if plain:
        met ^= ((y1 > y) != (y2 > y)) & (plain_left(x1, y1, x2, y2, x, y) != (side == (y2 > y1)))
    return met, touched(x1, y1, x2, y2, x, y, plain, own) if boundary else None


def _level(v: np.ndarray, low: float, high: float, inverse: float, n: int) -> np.ndarray:
    """The strip of each ordinate, never falling with it: -1 below ``low``, ``n`` above ``high``."""
    at = np.minimum(np.floor((np.clip(v, low, high) - low) * inverse), n - 1).astype(np.int64)
    at[v < low] = -1
    at[v > high] = n
    return at


def strip_parity(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, px: np.ndarray, py: np.ndarray, plain: bool,
                 solid: int, work: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Whether each point meets an odd number of edges on its way to the right, and whether it lies on one of the first ``solid`` edges.

    The edges form closed rings: each vertex ends an even number of them.  Points are sorted into strips of their ordinate and bins of
    their abscissa.  In a strip an edge is tested with the points whose bins it crosses; points left of those get one constant, from
    which strips below an edge's end are left out as well: [its ordinate <= py][px < its abscissa] is added for every end in the
    strip, which the other edges of that vertex cancel.  So nothing is repeated that is not near, and memory is bounded by ``work``.
    """
    count = len(px)
    x_low, x_high, y_low, y_high = px.min(), px.max(), py.min(), py.max()
    wide, high = x_high - x_low, y_high - y_low
    along, up = np.abs(x2 - x1).sum(), np.abs(y2 - y1).sum()
    strips = int(np.clip(math.sqrt(count * max(high, 1e-9) / max(wide, 1e-9) * min(max(along / max(up, 1e-300), 1e-3), 1e3)), 1, count))
    bins = int(np.clip(math.ceil(2 * count / strips), 1, 2 * count))
    inverse, x_inverse = strips / high if high > 0 else 0.0, bins / wide if wide > 0 else 0.0
    step = high / strips
    y_slack = 1e-6 * step + 1e-12 * max(abs(y_low), abs(y_high))
    x_slack = 1e-9 * wide + 1e-12 * max(abs(x_low), abs(x_high))

    def bin_of(v: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor((np.clip(v, x_low, x_high) - x_low) * x_inverse), bins - 1).astype(np.int64)

    cell = _level(py, y_low, y_high, inverse, strips) * bins + bin_of(px)
    order = np.argsort(cell, kind="stable")
    px, py = px[order], py[order]
    start = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=strips * bins))))
    s1, s2 = (_level(y, y_low, y_high, inverse, strips) for y in (y1, y2))
    first, last = np.maximum(np.minimum(s1, s2), 0), np.minimum(np.maximum(s1, s2), strips - 1)
    near = np.flatnonzero((first <= last) & (np.maximum(x1, x2) >= x_low - x_slack))
    before, met, on = np.zeros(count + 1, np.int64), np.zeros(count, np.int64), np.zeros(count, bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(y1 == y2, 0.0, (x2 - x1) / (y2 - y1))
    ends = np.cumsum(last[near] - first[near] + 1)
    cut = 0
    while cut < len(near):
        upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + work // 4, "right")))
        mine = near[cut:upto]
        cut = upto
        n = last[mine] - first[mine] + 1
        e = np.repeat(mine, n)
        s = np.arange(len(e)) + np.repeat(first[mine] - (np.cumsum(n) - n), n)
        a1, b1, a2, b2, tilt = x1[e], y1[e], x2[e], y2[e], slope[e]
        low, top = np.minimum(b1, b2), np.maximum(b1, b2)
        floor = y_low + s * step
        xa = a1 + (np.clip(floor - y_slack, low, top) - b1) * tilt
        xb = np.where(low == top, a2, a1 + (np.clip(floor + (step + y_slack), low, top) - b1) * tilt)
        w, east = np.minimum(xa, xb) - x_slack, np.maximum(xa, xb) + x_slack
        row = s * bins
        begin = start[row + np.where(w > x_high, bins, bin_of(w))]
        end = np.maximum(start[row + np.where(east < x_low, 0, bin_of(east) + 1)], begin)
        own1, own2 = s1[e], s2[e]
        left = (own1 < s) != (own2 < s)
        before += np.bincount(start[row[left]], minlength=count + 1) + np.bincount(begin[left], minlength=count + 1)
        hits = end - begin
        some = np.flatnonzero(hits)
        done, sums = 0, np.cumsum(hits[some])
        while done < len(some):
            until = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + work, "right")))
            k = some[done:until]
            done = until
            for i, j in _runs(begin[k], end[k], work):
                r = k[j]
                u1, v1, u2, v2, x, y = a1[r], b1[r], a2[r], b2[r], px[i], py[i]
                if plain:
                    side = plain_left(u1, v1, u2, v2, x, y)
                else:
                    sign = orientation(u1, v1, u2, v2, x, y)
                    side = is_left(sign, u1, v1, u2, v2) == (v2 > v1)
                odd = ((v1 > y) != (v2 > y)) & side
                odd ^= (own1[r] == s[r]) & (v1 <= y) & (x < u1)
                odd ^= (own2[r] == s[r]) & (v2 <= y) & (x < u2)
                met += np.bincount(i[odd], minlength=count)
                at = i[touched(u1, v1, u2, v2, x, y, plain, None if plain else sign) & (e[r] < solid)]
                on[at] = True
    out = np.empty((2, count), bool)
    out[0, order] = (np.cumsum(before[:count]) + met) & 1
    out[1, order] = on
    return out[0], out[1]


def _runs(begin: np.ndarray, end: np.ndarray, work: int):
    """The numbers of each run begin ... end - 1 and the place of the run, in pieces of about ``work``."""
    if len(begin) == 1 and end[0] - begin[0] > work:
        for i in range(int(begin[0]), int(end[0]), work):
            each = np.arange(i, min(i + work, int(end[0])))
            yield each, np.zeros(len(each), np.int64)
        return
    n = end - begin
    place = np.repeat(np.arange(len(n)), n)
    yield np.arange(len(place)) + np.repeat(begin - (np.cumsum(n) - n), n), place
