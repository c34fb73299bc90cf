"""Nearest neighbours in one tile: a packed tree of boxes and a search that goes down it level by level, with numpy.

Objects are boxes (points: boxes without extent) in two dimensions, degrees with longitudes scaled by the query's latitude,
or three, the unit sphere. A query keeps the nodes that may hold one of its nearest, so its cost follows the depth of the
tree and not the number of objects around it. What is returned is a superset by rounding only: the caller measures and ranks.
"""

from __future__ import annotations

import numpy as np

#: Children of a node, and queries that go down the tree together.
FAN, CHUNK = 4, 2_000
#: Rounding between this search and the caller's measure, as a share of the squared distance.
EPS = 1e-9


def _curve(mid: np.ndarray) -> np.ndarray:
    """Place of each row of ``mid`` on a Z-curve over its bounding box."""
    low, span = mid.min(0), np.ptp(mid, 0)
    bits = 20
    grid = ((mid - low) / np.where(span > 0, span, 1.0) * ((1 << bits) - 1)).astype(np.int64)
    out = np.zeros(len(mid), np.int64)
    for b in range(bits):
        for d in range(mid.shape[1]):
            out |= ((grid[:, d] >> b) & 1) << (b * mid.shape[1] + d)
    return out


class Tree:
    """Packed trees, one for each segment (0, 1, ... without gaps): levels of (lo, hi, count, cells, first child)."""

    def __init__(self, seg: np.ndarray, lo: np.ndarray, hi: np.ndarray, cells: np.ndarray | None, ends: np.ndarray | None = None):
        """``cells``: first and last row, first and last column of each object, or None if all are eligible. ``ends``: latitude
        and longitude of both ends of objects that are straight lines from corner to corner of their boxes."""
        self.order = np.lexsort((_curve((lo + hi) / 2), seg))
        self.ends = None if ends is None else list(np.ascontiguousarray(ends[self.order].T))
        s, lo, hi = seg[self.order], lo[self.order], hi[self.order]
        count = np.ones(len(s), np.int64)
        # of the members: least and largest first, least and largest last, of rows and of columns
        span = None if cells is None else cells[self.order][:, [0, 0, 1, 1, 2, 2, 3, 3]]
        self.levels = [(lo, hi, count, span, None)]
        self.segments = int(s[-1]) + 1
        while len(s) > self.segments:
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            pos = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
            heads = np.flatnonzero(pos % FAN == 0)
            ends = np.r_[heads, len(s)]
            lo, hi, count, s = np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads), np.add.reduceat(count, heads), s[heads]
            if span is not None:
                least, most = np.minimum.reduceat(span, heads), np.maximum.reduceat(span, heads)
                span = np.where(np.arange(8) % 2 == 0, least, most)
            self.levels.append((lo, hi, count, span, ends))
        side = lambda t: None if t is None else list(np.ascontiguousarray(t.T))
        self.levels = [(side(lo), side(hi), count, side(span), ends) for lo, hi, count, span, ends in self.levels]

    def search(self, q: np.ndarray, scale: np.ndarray | None, seg: np.ndarray, at: np.ndarray | None, k: int, cap: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, object, least squared distance) of all that may be among the k nearest of their query's segment, with a
        squared distance of ``cap`` at most. ``at``: row and column of each query, which see the neighbouring cells only."""
        q, scale, at = ([None] if t is None else list(np.ascontiguousarray(t.T)) for t in (q, scale, at))
        parts = []
        for a in range(0, len(q[0]), CHUNK):
            rows = np.arange(a, min(a + CHUNK, len(q[0])))
            bound = cap[rows].astype(float)
            if k == 1:
                bound = np.minimum(bound, self._first(q, scale, seg, at, rows))
            parts.append(self._some(q, scale, seg, at, k, bound, slack, rows))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _apart(self, depth, qi, node, q, scale, far):
        """Least or largest (``far``) squared distance of members from queries."""
        if depth == 0 and self.ends is not None:
            return self._to_line(qi, node, q, scale)
        lo, hi, total = self.levels[depth][0], self.levels[depth][1], 0.0
        for d in range(len(lo)):
            x = q[d].take(qi)
            under, over = lo[d].take(node) - x, x - hi[d].take(node)
            off = np.minimum(under, over) if far else np.maximum(np.maximum(under, over), 0.0)
            if scale[0] is not None:
                off = off * scale[d].take(qi)
            total = total + off * off
        return total

    def _beside(self, depth, qi, node, at, whole):
        """Whether any or all (``whole``) members are in cells next to the query's; None if that does not matter."""
        span = self.levels[depth][3]
        if span is None:
            return None
        r, c = at[0].take(qi), at[1].take(qi)
        i, j, k, m = (1, 2, 5, 6) if whole else (0, 3, 4, 7)
        return (span[i].take(node) <= r + 1) & (span[j].take(node) >= r - 1) & (span[k].take(node) <= c + 1) & (span[m].take(node) >= c - 1)

    def _children(self, depth, qi, node):
        ends = self.levels[depth][4]
        first = ends.take(node)
        n = ends.take(node + 1) - first
        return np.repeat(qi, n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def _first(self, q, scale, seg, at, rows):
        """Squared distance of one object for each of ``rows``, found by going down to the nearest child only; else infinite."""
        qi, node, bound = rows, seg[rows], np.full(len(rows), np.inf)
        for depth in range(len(self.levels) - 1, -1, -1):
            near, some = self._apart(depth, qi, node, q, scale, False), self._beside(depth, qi, node, at, False)
            if some is not None:
                near = np.where(some, near, np.inf)
            heads = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
            hit = np.flatnonzero(near == np.repeat(np.minimum.reduceat(near, heads), np.diff(np.r_[heads, len(qi)])))
            hit = hit[np.r_[True, qi[hit[1:]] != qi[hit[:-1]]] & np.isfinite(near[hit])]
            qi, node = qi[hit], node[hit]
            if len(qi) == 0:
                return bound
            if depth:
                qi, node = self._children(depth, qi, node)
        bound[qi - rows[0]] = self._apart(0, qi, node, q, scale, True)
        return bound

    def _some(self, q, scale, seg, at, k, bound, slack, rows):
        qi, node, start = rows, seg[rows], rows[0]
        limit = self._loose(bound, slack)
        told = k == 1 and bool(np.isfinite(bound).all())  # then nodes have nothing to add before the objects
        for depth in range(len(self.levels) - 1, -1, -1):
            near = self._apart(depth, qi, node, q, scale, False)
            keep = np.flatnonzero(near <= limit.take(qi - start))
            qi, node, near = qi.take(keep), node.take(keep), near.take(keep)
            some = self._beside(depth, qi, node, at, False)
            if some is not None:
                keep = np.flatnonzero(some)
                qi, node, near = qi.take(keep), node.take(keep), near.take(keep)
            if len(qi) == 0:
                return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if depth == 0 or not told:
                far = near if depth == 0 and self.ends is not None else self._apart(depth, qi, node, q, scale, True)
                whole = self._beside(depth, qi, node, at, True) if depth else None
                if whole is not None:
                    far = np.where(whole, far, np.inf)
                heads = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
                if k == 1:
                    least = np.minimum.reduceat(far, heads)
                else:
                    held = self.levels[depth][2].take(node)
                    by = np.lexsort((far, qi))
                    n = np.cumsum(held[by])
                    base = np.repeat(n[heads] - held[by][heads], np.diff(np.r_[heads, len(qi)]))
                    least = np.minimum.reduceat(np.where(n - base >= k, far[by], np.inf), heads)
                seen = qi[heads] - start
                bound[seen] = np.minimum(bound[seen], least)
                limit[seen] = self._loose(bound[seen], slack)
                keep = np.flatnonzero(near <= limit.take(qi - start))
                qi, node, near = qi.take(keep), node.take(keep), near.take(keep)
            if depth:
                qi, node = self._children(depth, qi, node)
        return qi, self.order[node], near

    def _to_line(self, qi, node, q, scale):
        """Squared distance of each query from the line of its node."""
        a_y, a_x, b_y, b_x = (e.take(node) for e in self.ends)
        by = [s.take(qi) for s in scale]
        dy, dx, py, px = (b_y - a_y) * by[0], (b_x - a_x) * by[1], (q[0].take(qi) - a_y) * by[0], (q[1].take(qi) - a_x) * by[1]
        n = dy * dy + dx * dx
        t = np.clip((py * dy + px * dx) / np.where(n == 0, 1.0, n), 0.0, 1.0)
        py, px = py - t * dy, px - t * dx
        return py * py + px * px

    @staticmethod
    def _loose(bound: np.ndarray, slack: float) -> np.ndarray:
        return (np.sqrt(bound) * (1 + EPS) + slack) ** 2 + 1e-24


def first_copies(seg: np.ndarray, at: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Objects that can be among the k first: of those at one spot, the k of least rank."""
    by = np.lexsort((rank, *at.T, seg))
    new = np.r_[True, (seg[by][1:] != seg[by][:-1]) | (at[by][1:] != at[by][:-1]).any(1)]
    heads = np.flatnonzero(new)
    pos = np.arange(len(by)) - np.repeat(heads, np.diff(np.r_[heads, len(by)]))
    return by[pos < k]


def laddered(on_q: np.ndarray, on_p: np.ndarray, rung: np.ndarray, may: np.ndarray | None, lo: np.ndarray, hi: np.ndarray, cells: np.ndarray | None, rank: np.ndarray | None, q: np.ndarray, scale: np.ndarray | None, at: np.ndarray | None, k: int, cap: np.ndarray, slack: float = 0.0, ends: np.ndarray | None = None):
    """(query, object) of the k nearest among the objects of a query's key ``on`` on the first rung that has any in reach.

    ``may``: the rungs (0 to 62) that a query takes, as bits. ``rank``: order of objects at one spot, or None for boxes.
    ``ends``: both ends of objects that are lines; those with equal ends are at one spot.
    """
    pairs, seg = np.unique(np.stack([rung, on_p], 1), axis=0, return_inverse=True)
    seg = seg.reshape(-1)
    kept = np.arange(len(seg)) if rank is None else first_copies(seg, lo if ends is None else ends, rank, k)
    tree = Tree(seg[kept], lo[kept], hi[kept], None if cells is None else cells[kept], None if ends is None else ends[kept])
    open_, found = np.ones(len(q), bool), []
    for r in np.unique(pairs[:, 0]):
        a, b = np.searchsorted(pairs[:, 0], r, "left"), np.searchsorted(pairs[:, 0], r, "right")
        keys = pairs[a:b, 1]
        spot = np.minimum(np.searchsorted(keys, on_q), len(keys) - 1)
        go = open_ & (keys[spot] == on_q)
        if may is not None:
            go &= (may >> r) & 1 == 1
        go = np.flatnonzero(go)
        if not len(go):
            continue
        i, o, d = tree.search(q[go], None if scale is None else scale[go], a + spot[go], None if at is None else at[go], k, cap[go], slack)
        sure = d <= cap[go][i] * (1 - 4 * EPS)
        open_[go[i[sure]]] = False
        found.append((go[i], kept[o]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
