"""Sequential kernels on one connected component: growing unbranched segments, and assembling them into trees. Plain numpy, run in grouped-map tasks.

Graphs are over 0..n-1: lists of neighbour arrays, or a grid of points, which finds neighbours as they are asked for. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np

from .grid import Grid


def adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    ends, other = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.lexsort((other, ends))
    return np.split(other[order], np.searchsorted(ends[order], np.arange(1, n)))


def radius_pairs(xyz: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` at most ``radius`` apart, by cells. For small sets; ``Grid.pairs`` gives them in pieces."""
    found = list(Grid(xyz, radius).pairs())
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def reach(adj: Grid | list[np.ndarray], front: Iterable[int], mask: np.ndarray) -> np.ndarray:
    """Vertices of the mask next to the front, ascending."""
    front = np.asarray(list(front) if not isinstance(front, np.ndarray) else front, np.int64)
    if isinstance(adj, Grid):
        return adj.reach(front, mask)
    near = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(adj[v], np.int64) for v in front.tolist()]]))
    return near[mask[near]]


def parts_of(adj: Grid | list[np.ndarray], members: Iterable[int]) -> list[list[int]]:
    """Connected parts of a vertex set, largest first, then by smallest vertex; each sorted."""
    left, out = np.zeros(len(adj), bool), []
    members = sorted(set(members))
    left[members] = True
    for v in members:
        if left[v]:
            left[v] = False
            layers = [front := np.array([v])]
            while len(front := reach(adj, front, left)):
                left[front] = False
                layers.append(front)
            out.append(np.sort(np.concatenate(layers)).tolist())
    return sorted(out, key=lambda p: (-len(p), p[0]))


def hop_counts(adj: Grid | list[np.ndarray], inside: set[int], starts: Iterable[int]) -> dict[int, int]:
    """Hops from the starts to the vertices of ``inside`` that can be reached within it."""
    found = {v: 0 for v in starts}
    left = np.zeros(len(adj), bool)
    left[list(inside)] = True
    left[list(found)] = False
    front, hops = np.array(list(found), np.int64), 0
    while len(front := reach(adj, front, left)):
        left[front] = False
        hops += 1
        found |= dict.fromkeys(front.tolist(), hops)
    return found


def principal(rows: np.ndarray) -> np.ndarray:
    """Main axis of a few points, from the first towards the last."""
    off = rows - rows.mean(0)
    axis = np.linalg.svd(off, full_matrices=False)[2][0]
    return axis if (rows[-1] - rows[0]) @ axis >= 0 else -axis


class Segment:
    """One segment that grows in waves from its seeds."""

    def __init__(self, adj: Grid | list[np.ndarray], free: np.ndarray, seeds: Iterable[int], hops: int, xyz: np.ndarray | None = None, angle: float = 80.0, least: int = 1):
        self.adj, self.free, self.hops, self.xyz, self.angle, self.least = adj, free, hops, xyz, angle, least
        seeds = list(dict.fromkeys(seeds))
        if not all(free[s] for s in seeds):
            raise ValueError("a seed lies outside the mask")
        self.wave = {s: 1 for s in seeds}
        self.open = free.copy()
        self.open[seeds] = False
        self.touched = set(seeds)
        self.number = 1
        self.grow(seeds)

    def members(self, wave: int) -> list[int]:
        return sorted(v for v, w in self.wave.items() if w == wave)

    def centroid(self, wave: int) -> np.ndarray | None:
        own = self.members(wave)
        return self.xyz[own].mean(0) if own else None

    def centroids(self) -> np.ndarray:
        """Of the waves that have members, in order."""
        own: dict[int, list[int]] = defaultdict(list)
        for v, w in sorted(self.wave.items()):
            own[w].append(v)
        return np.array([self.xyz[own[w]].mean(0) for w in sorted(own) if w < self.number])

    def grow(self, front: list[int]) -> None:
        while front:
            ring, layer = [], front
            for _ in range(self.hops):
                layer = reach(self.adj, layer, self.open)
                self.open[layer] = False
                ring += layer.tolist()
            self.touched.update(ring)
            if not ring:
                break
            parts = parts_of(self.adj, ring)
            self.number += 1
            front = self.choose(parts)
            if front and len(parts) > 1:
                self.settle_branch(front, [v for p in parts if p is not front for v in p])
            self.wave |= dict.fromkeys(front, self.number)

    def choose(self, parts: list[list[int]]) -> list[int]:
        fit = [p for p in parts if len(p) >= self.least]
        if not fit:
            return []
        if self.xyz is None or self.number <= 3:
            return fit[0]
        before = self.centroid(self.number - 1)
        line = self.centroids()
        if before is None or len(line) < 3:
            return fit[0]
        axis = principal(line)
        best, top = [], 0.0
        for p in fit:
            step = self.xyz[p].mean(0) - before
            cosine = float(step @ axis / max(float(np.linalg.norm(step)), 1e-300))
            if cosine >= math.cos(math.radians(self.angle)) and len(p) * cosine > top:
                best, top = p, len(p) * cosine
        return best

    def settle_branch(self, chosen: list[int], other: list[int]) -> None:
        """Where a ring splits, take back vertices of the waves just before that are nearer to the parts left out."""
        if self.number < 4:
            return
        inside = set(chosen)
        far = max(hop_counts(self.adj, inside, chosen[:1]).items(), key=lambda t: (t[1], -t[0]))[0]
        depth = max(1, max(hop_counts(self.adj, inside, [far]).values()) // self.hops)
        last = self.number - 1
        unsure = last - depth + 1
        pure = max(1, unsure - 2)
        if unsure < 2:
            pure, unsure = 1, min(3, last)
        anchors = [v for v, w in self.wave.items() if pure <= w < unsure]
        doubtful = [v for v, w in self.wave.items() if unsure <= w <= last]
        if not anchors or not doubtful:
            return
        area = {*anchors, *doubtful, *chosen, *other}
        to_chosen, to_other, to_anchor = (hop_counts(self.adj, area, s) for s in (chosen, other, anchors))
        known = sorted(to_anchor[v] for v in doubtful if v in to_anchor)
        middle = known[(len(known) - 1) // 2] if len(known) % 2 else (known[len(known) // 2 - 1] + known[len(known) // 2]) // 2 if known else None
        for v in doubtful:
            a, b = to_chosen.get(v), to_other.get(v)
            if b is None or (a is not None and a <= b):
                continue
            tie = a is not None and b > 0 and 0.8 < a / b < 1.2 and (middle is None or to_anchor.get(v, middle + 1) <= middle)
            if not tie:
                del self.wave[v]

    def rejected(self) -> list[int]:
        return sorted(self.touched - self.wave.keys())


def label_segments(adj: Grid | list[np.ndarray], xyz: np.ndarray, agh: np.ndarray, ceiling: float, hops: int = 2, angle: float = 80.0, ring_least: int = 3, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Segment and wave number of each vertex (0: none). Seeds are first the parts near the ground, largest first; until one is accepted, then the
    vertices that any search so far left out at its rim, also one whose segment was too small, lowest first; where there are none, the lowest vertex that is free."""
    n = len(adj)
    segment, node = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free = np.zeros(n, bool)
    for part in parts_of(adj, range(n)):
        free[part] = len(part) >= least
    by_height = sorted(np.flatnonzero(free).tolist(), key=lambda v: (xyz[v, 2], v))
    lowest, rim, number, waves = 0, set(), 0, 0
    while True:
        clusters = None
        if number == 0:
            if near := [v for v in np.flatnonzero(free).tolist() if agh[v] <= ceiling]:
                clusters = parts_of(adj, near)
        elif rim:
            clusters = [[v] for v in sorted((v for v in rim if free[v]), key=lambda v: (xyz[v, 2], v))]
            rim = set()
        if not clusters:
            while lowest < len(by_height) and not free[by_height[lowest]]:
                lowest += 1
            if lowest == len(by_height):
                break
            clusters = [[by_height[lowest]]]
        for seeds in clusters:
            if not all(free[s] for s in seeds):
                continue
            grown = Segment(adj, free, seeds, hops, xyz, angle, ring_least)
            own = list(grown.wave)
            free[own] = False
            if len(own) >= least:
                number += 1
                segment[own] = number
                node[own] = [waves + w for w in grown.wave.values()]
                waves += grown.number
            rim.update(grown.rejected())
    order = sorted(Counter(segment[segment > 0].tolist()).items(), key=lambda t: (-t[1], t[0]))
    rank = np.zeros(number + 1, np.int64)
    for i, (s, _) in enumerate(order, 1):
        rank[s] = i
    return rank[segment], node


def assembly_rule(share: float, threshold: float, target: int, enabled: bool) -> str:
    return "B" if enabled and share >= threshold and target > 0 else "A"


def contacts(pairs: Iterable[tuple[np.ndarray, np.ndarray]], nbs: np.ndarray, node: np.ndarray) -> tuple[dict[int, set[int]], Counter]:
    """Nodes next to each node, and the number of point pairs between two branches (both ways), of pairs that come in pieces."""
    links: dict[int, set[int]] = defaultdict(set)
    between: Counter = Counter()
    for src, dst in pairs:
        m, o = node[src], node[dst]
        for a, b in np.unique(np.column_stack([m, o])[(m > 0) & (o > 0) & (m != o)], axis=0).tolist():
            links[a].add(b)
            links[b].add(a)
        m, o = nbs[src], nbs[dst]
        found, n = np.unique(np.column_stack([m, o])[(m > 0) & (o > 0) & (m != o)], axis=0, return_counts=True)
        for (a, b), k in zip(found.tolist(), n.tolist(), strict=True):
            between[a, b] += k
            between[b, a] += k
    return links, between


def assemble(src: np.ndarray, dst: np.ndarray, nbs: np.ndarray, node: np.ndarray, agh: np.ndarray, ceiling: float, threshold: float = 0.8, rule_b: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``assemble_pairs`` of whole arrays of pairs."""
    return assemble_pairs([(src, dst)], nbs, node, agh, ceiling, threshold, rule_b)


def assemble_pairs(pairs: Iterable[tuple[np.ndarray, np.ndarray]], nbs: np.ndarray, node: np.ndarray, agh: np.ndarray, ceiling: float, threshold: float = 0.8, rule_b: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Tree and branch of each point of one component. Branches near the ground found trees (else the largest branch, for the time being);
    round by round, the largest branches at the rim join the tree of most votes. Points of a component without ground have no tree."""
    n = len(nbs)
    size = Counter(nbs[nbs > 0].tolist())
    if not size:
        return np.zeros(n, np.int64), nbs.copy()
    owner = {int(m): int(b) for m, b in zip(node, nbs, strict=True) if m > 0 and b > 0}
    links, point_links = contacts(pairs, nbs, node)
    nodes_of: dict[int, list[int]] = defaultdict(list)
    for m, b in sorted(owner.items()):
        nodes_of[b].append(m)
    low = {b: float(agh[nbs == b].min()) for b in size}
    grounded = [b for b in sorted(size) if low[b] <= ceiling]
    founders = grounded or [min(size, key=lambda b: (-size[b], b))]
    tree = {b: t for t, b in enumerate(founders, 1)}
    branch = {b: b for b in size}
    votes: dict[int, Counter] = defaultdict(Counter)

    def spread(b: int) -> None:
        """Each skeleton edge to an open branch brings it as many votes as there are point edges between the two."""
        votes.pop(b, None)
        if tree[b] > 0:
            for m in nodes_of[b]:
                for o in links[m]:
                    c = owner.get(o, 0)
                    if c and c not in tree:
                        votes[c][tree[b]] += point_links[c, b]

    for b in founders:
        spread(b)
    while votes:
        joined = []
        for b in sorted(votes, key=lambda b: (-size[b], b)):
            poll = [(-v, t) for t, v in votes[b].items() if v > 0]
            if not poll:
                continue
            touch = Counter(owner[o] for m in nodes_of[b] for o in links[m] if owner.get(o, b) != b)
            share = sum(any(owner.get(o, b) != b and owner.get(o) in tree for o in links[m]) for m in nodes_of[b]) / max(1, len(nodes_of[b]))
            target = min(touch, key=lambda c: (-touch[c], c)) if touch else 0
            if assembly_rule(share, threshold, target, rule_b) == "A":
                tree[b] = min(poll)[1]
            else:
                tree[b], branch[b] = tree.get(target, 0), branch[target]
            joined.append(b)
        if not joined:
            break
        for b in joined:
            spread(b)
    of_tree = np.array([tree.get(int(b), 0) if b > 0 else 0 for b in nbs])
    of_branch = np.array([branch[int(b)] if b > 0 and tree.get(int(b), 0) > 0 else 0 for b in nbs])
    order = sorted(Counter(of_branch[of_branch > 0].tolist()).items(), key=lambda t: (-t[1], t[0]))
    rank = {b: i for i, (b, _) in enumerate(order, 1)}
    return (of_tree if grounded else np.zeros(n, np.int64)), np.array([rank.get(int(b), 0) for b in of_branch])
