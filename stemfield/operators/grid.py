"""Points by small cells, in numpy: neighbours within a radius without a list of edges.

Cells are the radius by root 3 wide, so points of one cell are neighbours and all others of a point lie in the 5 x 5 x 5 cells around its own.
Distances are ``sqrt((dx * dx + dy * dy) + dz * dz)``, as in the joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Distances held at a time.
CHUNK = 1_000_000


def cell_side(radius: float) -> float:
    """A trifle under the exact width, so that rounding parts no two points of a cell."""
    return radius / math.sqrt(3) * (1 - 1e-6)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dx, dy, dz = (a[:, None, i] - b[None, :, i] for i in range(3))
    return np.sqrt(dx * dx + dy * dy + dz * dz)


class Grid:
    """Finite points 0..n-1 and their neighbours at most ``radius`` apart. ``cells``: given cell numbers, if they aren't to be found here."""

    def __init__(self, xyz: np.ndarray, radius: float, cells: np.ndarray | None = None):
        self.xyz, self.radius = np.asarray(xyz, float).reshape(-1, 3), radius
        c = np.floor(self.xyz * (1.0 / cell_side(radius))).astype(np.int64) if cells is None else np.asarray(cells, np.int64).reshape(-1, 3)
        c = c - c.min(0) + 2 if len(c) else c
        size = [int(v) + 3 for v in c.max(0)] if len(c) else [1, 1, 1]
        if size[0] * size[1] * size[2] >= 2**62:
            raise ValueError("the points span too many cells of this radius")
        self.step = (size[1] * size[2], size[2])
        self.key = c[:, 0] * self.step[0] + c[:, 1] * self.step[1] + c[:, 2]
        self.order = np.argsort(self.key, kind="stable")
        self.sorted = self.key[self.order]
        self.columns = np.array([x * self.step[0] + y * self.step[1] for x in range(-2, 3) for y in range(-2, 3)])

    def __len__(self) -> int:
        return len(self.xyz)

    def around(self, key: int) -> np.ndarray:
        """Points of the cells around a cell, its own too."""
        low = np.searchsorted(self.sorted, key + self.columns - 2)
        high = np.searchsorted(self.sorted, key + self.columns + 2, "right")
        return np.concatenate([self.order[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])

    def by_cell(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Cells of some points, and those of the points that are in each, ascending."""
        points = np.sort(points)
        own = self.key[points]
        order = np.argsort(own, kind="stable")
        points, own = points[order], own[order]
        if not len(own):
            return
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for k, part in zip(own[first].tolist(), np.split(points, first[1:]), strict=True):
            yield k, part

    def neighbours(self, v: int) -> np.ndarray:
        """Of one point, ascending."""
        near = self.around(int(self.key[v]))
        near = near[distances(self.xyz[near], self.xyz[[v]])[:, 0] <= self.radius]
        return np.sort(near[near != v])

    def reach(self, front: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Points of the mask, ascending, that have a neighbour among the front (each is its own neighbour)."""
        found = []
        open_ = mask.copy()
        for key, own in self.by_cell(np.asarray(front, np.int64)):
            near = self.around(key)
            near = near[open_[near]]
            if not len(near):
                continue
            hit = self.key[near] == key
            at = np.flatnonzero(~hit)
            step = max(1, CHUNK // max(1, len(at)))
            for i in range(0, len(own), step):
                if not len(at):
                    break
                ok = (distances(self.xyz[near[at]], self.xyz[own[i : i + step]]) <= self.radius).any(1)
                hit[at[ok]] = True
                at = at[~ok]
            got = near[hit]
            open_[got] = False
            found.append(got)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs ``i < j`` of neighbours, in pieces."""
        for key, own in self.by_cell(np.arange(len(self))):
            near = self.around(key)
            step = max(1, CHUNK // len(near))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                a, b = np.nonzero((distances(self.xyz[part], self.xyz[near]) <= self.radius) & (part[:, None] < near[None]))
                yield part[a], near[b]

    def cell_links(self) -> tuple[np.ndarray, np.ndarray]:
        """A component number for each point, and the least point of its cell. Of two cells only whether any of their points are neighbours
        counts, and of cells that are joined already not even that."""
        from .labels import union_find

        first = np.flatnonzero(np.concatenate([[True], self.sorted[1:] != self.sorted[:-1]])) if len(self) else np.zeros(0, int)
        keys, rows = self.sorted[first], np.split(self.order, first[1:]) if len(first) else []
        n = len(keys)
        cell_of = np.empty(len(self), np.int64)
        cell_of[self.order] = np.repeat(np.arange(n), np.diff(np.append(first, len(self)))) if n else 0
        least = np.array([r[0] for r in rows], np.int64)
        low = np.array([self.xyz[r].min(0) for r in rows]).reshape(-1, 3)
        high = np.array([self.xyz[r].max(0) for r in rows]).reshape(-1, 3)
        label = np.arange(n)
        ahead = sorted(((x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3) if (x, y, z) > (0, 0, 0)), key=lambda o: sum(v * v for v in o))
        for x, y, z in ahead:
            there = np.searchsorted(keys, other := keys + x * self.step[0] + y * self.step[1] + z)
            a = np.flatnonzero((there < n) & (keys[np.minimum(there, n - 1)] == other)) if n else np.zeros(0, int)
            b = there[a]
            gap = np.maximum(0, np.maximum(low[b] - high[a], low[a] - high[b]))
            may = (label[a] != label[b]) & ((gap**2).sum(1) <= self.radius**2 * (1 + 1e-9))
            a, b = a[may], b[may]
            if not len(a):
                continue
            d = self.xyz[least[a]] - self.xyz[least[b]]
            linked = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) <= self.radius
            joined = _joined(union_find, label, a[linked], b[linked], n)
            for i in np.flatnonzero(~linked).tolist():
                if joined[a[i]] != joined[b[i]] and self._touch(rows[a[i]], rows[b[i]], low[b[i]], high[b[i]]):
                    linked[i] = True
                    old, new = joined[a[i]], joined[b[i]]
                    joined[joined == max(old, new)] = min(old, new)
            label = joined
        return label[cell_of] if n else np.zeros(0, np.int64), least[cell_of] if n else np.zeros(0, np.int64)

    def _touch(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether any of ``a`` and ``b``, which the box low, high holds, are neighbours."""
        away = np.maximum(0, np.maximum(low - self.xyz[a], self.xyz[a] - high))
        a = a[(away**2).sum(1) <= self.radius**2 * (1 + 1e-9)]
        step = max(1, CHUNK // len(b))
        return any((distances(self.xyz[a[i : i + step]], self.xyz[b]) <= self.radius).any() for i in range(0, len(a), step))


def _joined(union_find, label: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Labels of ``n`` cells after more links."""
    every = np.arange(n)
    _, out = union_find(np.concatenate([every, a]), np.concatenate([label, b]))
    return out.copy()
