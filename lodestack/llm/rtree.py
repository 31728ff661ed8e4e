"""R-tree over count vectors, for joins of sets that must share most of their elements.

A point holds how many of a set's elements fall in each of a number of hash groups: more groups
for larger sets, always a power of two, so that a longer point folds into a shorter one. What two
sets share is at most the sum of the coordinate-wise minima of their points; what any two sets
below two nodes share is at most that sum over the nodes' upper corners. Both are held against the
overlap that the sizes ask for. Trees are built over points folded to LEAST groups; pairs that they
leave are looked at again with as many groups as both points have.
"""

from __future__ import annotations

import numpy as np

LEAST, MOST, EACH, FANOUT, LEAF = 32, 512, 16, 8, 16
_FULL = 255  # a count that reached the width of its column stands for any larger one
_CHUNK = 8_192


def point(hashes: np.ndarray) -> np.ndarray:
    dims = LEAST
    while dims < MOST and dims * EACH < len(hashes):
        dims *= 2
    counts = np.bincount((hashes & np.uint64(dims - 1)).astype(np.int64), minlength=dims)
    return np.minimum(counts, _FULL).astype(np.uint8)


class Points:
    """Points of one or more lengths and the sizes of their sets."""

    def __init__(self, raw: list[bytes], sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.dims = np.fromiter(map(len, raw), np.int64, len(raw))
        self.place = np.zeros(len(raw), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for d in np.unique(self.dims).tolist():
            own = np.flatnonzero(self.dims == d)
            self.place[own] = np.arange(len(own))
            self.tables[d] = np.frombuffer(b"".join(raw[k] for k in own), np.uint8).reshape(len(own), d)
        self.base = self.folded(np.arange(len(raw)), LEAST)

    def folded(self, which: np.ndarray, d: int) -> np.ndarray:
        """The points `which`, none shorter than d, folded to d groups."""
        out = np.zeros((len(which), d), np.int32)
        for own, x in self.tables.items():
            at = np.flatnonzero(self.dims[which] == own)
            for s in range(0, len(at), _CHUNK):
                k = at[s : s + _CHUNK]
                y = x[self.place[which[k]]].astype(np.int32)
                y[y == _FULL] = 1 << 22
                out[k] = y if own == d else y.reshape(len(k), -1, d).sum(1)
        return out

    def refine(self, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs the bound leaves with all the groups that both points have."""
        ok = np.ones(len(i), bool)
        both = np.minimum(self.dims[i], self.dims[j])
        for d in self.tables:
            at = np.flatnonzero(both == d) if d > LEAST else []
            step = _CHUNK // (d // LEAST)
            for s in range(0, len(at), step):
                k = at[s : s + step]
                shared = np.minimum(self.folded(i[k], d), self.folded(j[k], d)).sum(1, dtype=np.int64)
                ok[k] = shared * (num + den) >= num * (self.sizes[i[k]] + self.sizes[j[k]])
        return ok


def may_link(top, low, high, i, j, num: int, den: int) -> np.ndarray:
    """Whether sets below i and j can have a Jaccard similarity of num/den or more."""
    ok = (den * high[i] >= num * low[j]) & (den * high[j] >= num * low[i])
    at = np.flatnonzero(ok)
    for s in range(0, len(at), _CHUNK):
        k = at[s : s + _CHUNK]
        shared = np.minimum(top[i[k]], top[j[k]]).sum(1, dtype=np.int64)
        ok[k] = shared * (num + den) >= num * (low[i[k]] + low[j[k]])
    return ok


def _packed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sort-tile order: slabs by size, inside them by the coordinates that vary most."""
    order = np.argsort(sizes, kind="stable")
    slab = max(LEAF, int(np.sqrt(len(order) * LEAF)))
    axes = np.argsort(-points.var(0))[:2]
    return np.concatenate([(part := order[s : s + slab])[np.lexsort((points[part, axes[1]], points[part, axes[0]]))] for s in range(0, len(order), slab)])


def join(of: Points, members: slice, num: int, den: int, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) among `members` that the bound can't rule out, counted from the first of
    them; with `block`, only pairs across blocks."""
    points, sizes = of.base[members], of.sizes[members]
    order = _packed(points, sizes)
    levels = [(points[order], sizes[order], sizes[order])]
    step = LEAF
    while len(levels[-1][1]) > 1:
        top, low, high = levels[-1]
        at = np.arange(0, len(low), step)
        levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        step = FANOUT
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 2, -1, -1):
        top, low, high = levels[depth]
        fan = LEAF if depth == 0 else FANOUT
        grid = np.arange(fan)
        found = []
        for s in range(0, len(i), 1024):
            a = (i[s : s + 1024, None] * fan + grid)[:, :, None].repeat(fan, 2).ravel()
            b = (j[s : s + 1024, None] * fan + grid)[:, None, :].repeat(fan, 1).ravel()
            keep = (a < len(low)) & (b < len(low)) & ((a < b) if depth == 0 else (a <= b))
            a, b = a[keep], b[keep]
            if depth == 0 and block is not None:
                keep = block[order[a]] != block[order[b]]
                a, b = a[keep], b[keep]
            ok = may_link(top, low, high, a, b, num, den)
            a, b = a[ok], b[ok]
            if depth == 0:
                ok = of.refine(order[a] + members.start, order[b] + members.start, num, den)
                a, b = a[ok], b[ok]
            found.append((a, b))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    if len(levels) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[i], order[j]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the pairs connect it with."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        root = new[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root
