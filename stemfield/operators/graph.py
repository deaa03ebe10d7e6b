"""Graph operators on edge tables ``src, dst, w`` (each pair once): shortest paths, slices, proto nodes, quotient graphs, linear paths."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_table
from .grid import Grid
from .labels import LOCAL_EDGES, label_components, label_found, ranked, union_find
from .neighbours import finite, near_pairs
from .tiles import radius_components

#: Largest turn of a linear path, in degrees.
TURN_LIMIT = 60.0


def both_ways(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *cols).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def induced(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """Edges with both ends in ``subset (pid)``."""
    inside = subset.select("pid").distinct()
    return edges.join(inside.withColumnRenamed("pid", "src"), "src", "left_semi").join(inside.withColumnRenamed("pid", "dst"), "dst", "left_semi").select(*edges.columns)


def dijkstra(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and parents (-1: none) from ``start`` over undirected edges of positive weight."""
    ends, other, weight = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    order = np.lexsort((other, ends))
    ends, other, weight = ends[order], other[order], weight[order]
    first = np.searchsorted(ends, np.arange(n + 1))
    dist, parent = np.full(n, np.inf), np.full(n, -1)
    dist[start] = 0
    heap, done = [(0.0, start)], np.zeros(n, bool)
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        for u, step in zip(other[first[v] : first[v + 1]].tolist(), weight[first[v] : first[v + 1]].tolist(), strict=True):
            if step > 0 and d + step < dist[u] - 1e-12:
                dist[u], parent[u] = d + step, v
                heapq.heappush(heap, (d + step, u))
    return dist, parent


def shortest_paths(vertices: DataFrame, edges: DataFrame, target: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``pid, distance, parent`` from the vertex ``target``; unreachable vertices have an infinite distance and a null parent.

    Edges of weight 0 are ignored. Few edges are solved by one task, many by rounds of relaxation until nothing changes.
    """
    if vertices.where(F.col("pid") == target).isEmpty():
        raise ValueError(f"the target {target} is no vertex")
    edges = edges.where("w > 0").select("src", "dst", "w")
    if edges.limit(local_edges + 1).count() <= local_edges:

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            nodes, ends = np.unique(np.concatenate([frame["src"], frame["dst"], [target]]).astype(np.int64), return_inverse=True)
            n = len(frame)
            dist, parent = dijkstra(len(nodes), ends[:n], ends[n : 2 * n], frame["w"].to_numpy(), int(ends[-1]))
            ok = np.isfinite(dist)
            return pd.DataFrame({"node": nodes[ok], "distance": dist[ok], "parent": pd.array(np.where(parent[ok] < 0, 0, nodes[parent[ok]]), "Int64")}).assign(parent=lambda f: f["parent"].mask(parent[ok] < 0))

        found = edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda f: solve(f), "node long, distance double, parent long")
    else:
        arcs = persist_table(both_ways(edges), "arcs")
        found = front = persist_table(vertices.where(F.col("pid") == target).select(F.col("pid").alias("node"), F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("parent")).distinct(), "front")
        while not front.isEmpty():
            reached = front.join(arcs, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("node").alias("p"))).alias("m"))
            known = found.select(F.col("node").alias("dst"), F.col("distance").alias("had"))
            front = persist_table(reached.join(known, "dst", "left").where("had is null or m.d < had - 1e-12").select(F.col("dst").alias("node"), F.col("m.d").alias("distance"), F.col("m.p").alias("parent")), "front")
            found = persist_table(found.join(front, "node", "left_anti").unionByName(front), "found")
    out = vertices.select("pid").join(found, F.col("pid") == F.col("node"), "left")
    start = F.col("pid") == target
    return out.select("pid", F.when(start, 0.0).otherwise(F.coalesce("distance", F.lit(float("inf")))).alias("distance"), "parent")


def shortest_paths_from_point(points: DataFrame, edges: DataFrame, x: float, y: float, z: float) -> DataFrame:
    """From the vertex nearest to a point, ties to the smaller pid."""
    d2 = sum((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip("xyz", (x, y, z), strict=True))
    nearest = points.agg(F.min(F.struct(d2.alias("d"), "pid")).alias("m")).first()["m"]
    return shortest_paths(points, edges, nearest["pid"])


def slice_labels(distances: DataFrame, length: float) -> DataFrame:
    """``pid, slice``: floor(distance / length) + 1, 0 where unreachable."""
    if not length > 0:
        raise ValueError("the slice length must be positive")
    d = F.col("distance")
    return distances.select("pid", F.when(d.isNull() | (d == float("inf")), 0).otherwise(F.floor(d / F.lit(float(length))) + 1).cast("int").alias("slice"))


def proto_nodes(points: DataFrame, slices: DataFrame, max_distance: float, min_size: int = 1) -> DataFrame:
    """``pid, proto``: components of the odd slices and of the even slices, numbered by their first slice and, in it, by first pid."""
    own = points.join(slices.where("slice > 0"), "pid").withColumn("parity", F.col("slice") % 2)
    own = persist_table(own.select("pid", "x", "y", "z", "slice", "parity"), "sliced")
    odd, even = (radius_components(own.where(F.col("parity") == p), max_distance) for p in (1, 0))
    labelled = label_found(odd.unionAll(even), min_size).where("label > 0").join(own.select("pid", "slice"), "pid")
    order = labelled.groupBy("label").agg(F.min(F.struct("slice", "pid")).alias("at"))
    number = order.select("label", F.row_number().over(Window.orderBy("at.slice", "at.pid")).alias("proto"))
    return points.select("pid").join(labelled.join(number, "label").select("pid", "proto"), "pid", "left").select("pid", F.coalesce("proto", F.lit(0)).alias("proto"))


def quotient_graph(points: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse points to their labels: ``label, x, y, z, n`` (centroids) and ``la < lb, vx, vy, vz`` (median edge vector from la to lb, by component)."""
    own = points.select("pid", "x", "y", "z").join(labels.where("label > 0").select("pid", "label"), "pid")
    nodes = own.groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))
    end = lambda s: own.select(F.col("pid").alias(s), F.col("label").alias(f"l{s}"), *[F.col(c).alias(f"{c}{s}") for c in "xyz"])
    crossing = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").where("lsrc <> ldst")
    forward = F.col("lsrc") < F.col("ldst")
    signed = crossing.select(F.least("lsrc", "ldst").alias("la"), F.greatest("lsrc", "ldst").alias("lb"), *[(F.when(forward, 1.0).otherwise(-1.0) * (F.col(f"{c}dst") - F.col(f"{c}src"))).alias(c) for c in "xyz"])
    return nodes, medians(signed)


def radius_quotient(points: DataFrame, radius: float, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``quotient_graph`` over the pairs of points at most ``radius`` apart, which are neither written nor shuffled."""
    own = points.select("pid", "x", "y", "z").join(labels.where("label > 0").select("pid", "label"), "pid")
    nodes = own.groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))
    own = persist_table(own.where(finite(("x", "y", "z"))), "labelled")
    close = near_pairs(own, own, radius).where((F.col("a.label") < F.col("b.label")) & (F.sqrt("d2") <= radius))
    return nodes, medians(close.select(F.col("a.label").alias("la"), F.col("b.label").alias("lb"), *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in "xyz"]))


def medians(vectors: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """``la, lb, vx, vy, vz``: the exact median of each component. Sketches give two limits that the middle surely lies between (each is off by
    one part in ``accuracy`` at most); only values between them are held and sorted."""
    shares = F.array(*[F.lit(0.5 + k * 3 / accuracy) for k in (-1, 1)])
    limits = vectors.groupBy("la", "lb").agg(*[F.percentile_approx(c, shares, F.lit(accuracy)).alias(f"t{c}") for c in "xyz"]).toDF("_a", "_b", "tx", "ty", "tz")
    limits = persist_table(limits, "limits")
    placed = vectors.join(limits, (F.col("la") == F.col("_a")) & (F.col("lb") == F.col("_b")))
    aggs = []
    for c in "xyz":
        low, high = F.col(f"t{c}")[0], F.col(f"t{c}")[1]
        aggs += [F.count(c).alias(f"n{c}"), F.sum((F.col(c) < low).cast("long")).alias(f"u{c}"), F.array_sort(F.collect_list(F.when((F.col(c) >= low) & (F.col(c) <= high), F.col(c)))).alias(f"m{c}")]
    found = placed.groupBy("la", "lb").agg(*aggs)
    at = lambda c, k: F.element_at(f"m{c}", (k - F.col(f"u{c}")).cast("int"))
    mid = lambda c: 0.5 * at(c, F.floor((F.col(f"n{c}") + 1) / 2)) + 0.5 * at(c, F.floor((F.col(f"n{c}") + 2) / 2))
    return found.select("la", "lb", *[mid(c).alias(f"v{c}") for c in "xyz"])


def linear_path(ids: np.ndarray, coords: np.ndarray, edges: np.ndarray, root: int, turn: float = TURN_LIMIT) -> list[int]:
    """From root the neighbour of smallest z (then the shorter edge, the smaller id), then always the unvisited neighbour that
    turns least, ties to the smaller id; stops where every turn exceeds the limit."""
    at = {int(v): i for i, v in enumerate(ids)}
    near: dict[int, set[int]] = {int(v): set() for v in ids}
    for a, b in edges:
        near[int(a)].add(int(b))
        near[int(b)].add(int(a))
    path, least = [root], math.cos(math.radians(turn)) - 1e-12
    step = None
    while True:
        here = coords[at[path[-1]]]
        choice = sorted(near[path[-1]] - set(path))
        if not choice:
            return path
        moves = {v: coords[at[v]] - here for v in choice}
        if step is None:
            best = min(choice, key=lambda v: (coords[at[v]][2], np.linalg.norm(moves[v]), v))
        else:
            cosine = {v: float(m @ step / max(np.linalg.norm(m) * np.linalg.norm(step), 1e-300)) for v, m in moves.items()}
            best = min(choice, key=lambda v: (-cosine[v], v))
            if cosine[best] < least:
                return path
        step = moves[best]
        path.append(best)


def straightest(rows: np.ndarray, moves: np.ndarray, step: np.ndarray, least: float) -> int:
    """The row whose move turns least, ties to the smaller; -1 if all turn too far."""
    cosine = moves @ step / np.maximum(np.linalg.norm(moves, axis=1) * np.linalg.norm(step), 1e-300)
    close = np.flatnonzero(cosine >= cosine.max() - 1e-9)
    exact = [(-float(moves[i] @ step / max(np.linalg.norm(moves[i]) * np.linalg.norm(step), 1e-300)), int(rows[i]), i) for i in close.tolist()]
    turn, _, i = min(exact)
    return -1 if -turn < least else i


def radius_linear_path(points: DataFrame, radius: float, root: int, turn: float = TURN_LIMIT) -> DataFrame:
    """``longest_linear_path`` over the pairs of points at most ``radius`` apart: the path is sequential, so one task holds the points, but no
    pairs; it looks for the neighbours of the path's last point only."""
    if not radius > 0:
        raise ValueError("the radius must be positive")
    core = points.select("pid", "x", "y", "z").where(finite(("x", "y", "z")) | (F.col("pid") == root))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid")
        ids, xyz = frame["pid"].to_numpy(np.int64), frame[["x", "y", "z"]].to_numpy(float)
        path = np.flatnonzero(ids == root).tolist()
        if path and np.isfinite(xyz[path[0]]).all():
            grid, open_, step = Grid(xyz, radius), np.ones(len(xyz), bool), None
            while True:
                open_[path[-1]] = False
                choice = grid.neighbours(path[-1])
                choice = choice[open_[choice]]
                if not len(choice):
                    break
                moves = xyz[choice] - xyz[path[-1]]
                if step is None:
                    low = np.flatnonzero(xyz[choice, 2] == xyz[choice, 2].min()).tolist()
                    best = min(low, key=lambda i: (np.linalg.norm(moves[i]), choice[i]))
                elif (best := straightest(choice, moves, step, math.cos(math.radians(turn)) - 1e-12)) < 0:
                    break
                step = moves[best]
                path.append(int(choice[best]))
        steps = np.linalg.norm(np.diff(xyz[path], axis=0), axis=1)
        return pd.DataFrame({"ord": range(len(path)), "pid": ids[path], "length": np.concatenate([[0.0], np.cumsum(steps)])[: len(path)]})

    return core.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda f: solve(f), "ord long, pid long, length double")


def longest_linear_path(points: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    """``ord, pid, length``: the linear path from ``root`` and its length so far. Sequential, so one task holds the root's component."""
    own = label_components(points, edges)
    home = own.where(F.col("pid") == root).select("label")
    inside = points.join(own.join(F.broadcast(home), "label", "left_semi"), "pid", "left_semi")  # one row is broadcast
    rows = inside.select(F.lit(0).alias("k"), "pid", "x", "y", "z", F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"))
    arcs = induced(edges.select("src", "dst"), inside).select(F.lit(0).alias("k"), F.lit(None).cast("long").alias("pid"), *[F.lit(None).cast("double").alias(c) for c in "xyz"], "src", "dst")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        v, e = frame[frame["pid"].notna()], frame[frame["src"].notna()]
        ids, xyz = v["pid"].to_numpy(np.int64), v[["x", "y", "z"]].to_numpy()
        path = linear_path(ids, xyz, e[["src", "dst"]].to_numpy(np.int64), root)
        line = xyz[[int(np.flatnonzero(ids == p)[0]) for p in path]]
        steps = np.linalg.norm(np.diff(line, axis=0), axis=1)
        return pd.DataFrame({"ord": range(len(path)), "pid": path, "length": np.concatenate([[0.0], np.cumsum(steps)])})

    return rows.unionByName(arcs).groupBy("k").applyInPandas(solve, "ord long, pid long, length double")


__all__ = ["both_ways", "dijkstra", "induced", "linear_path", "longest_linear_path", "medians", "proto_nodes", "quotient_graph", "radius_linear_path", "radius_quotient", "ranked", "shortest_paths", "shortest_paths_from_point", "slice_labels", "union_find"]
