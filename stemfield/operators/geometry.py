"""Planar and solid geometry: hulls, interpolation, height above ground, surfaces, cylinders, principal axes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .filters import grid_zmin, in_polygon, polygon_filter, statistical_filter, upward_conic_filter, voxel_component_filter
from .neighbours import finite as finite_points
from .neighbours import knn_join


# hulls and polygons


def hull(xy: np.ndarray) -> np.ndarray:
    """Strict convex hull, counter-clockwise, open; fewer than 3 rows if the points are degenerate."""
    pts = np.unique(np.asarray(xy, float), axis=0)
    if len(pts) < 3:
        return pts

    def half(rows):
        chain: list[np.ndarray] = []
        for p in rows:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def convex_hull(points: DataFrame) -> list[tuple[float, float]]:
    """Hull of the XY positions. Every partition reduces its rows to its own hull first; the driver joins those."""

    def run(frames):
        best = np.zeros((0, 2))
        for f in frames:
            best = hull(np.concatenate([best, f[["x", "y"]].to_numpy()]))
        yield pd.DataFrame({"x": best[:, 0], "y": best[:, 1]})

    parts = points.select("x", "y").mapInPandas(run, "x double, y double").toPandas()
    out = hull(parts.to_numpy())
    if len(out) < 3:
        raise ValueError("a hull needs three points that aren't on one line")
    return [(float(x), float(y)) for x, y in out]


def buffer_polygon(polygon: Sequence[Sequence[float]], distance: float) -> list[tuple[float, float]]:
    """Move every vertex outward along the bisector of its edges, by distance / cos(half the turn), the cosine at least 0.1."""
    if distance < 0:
        raise ValueError("the buffer must not be negative")
    p = np.asarray(polygon, float)
    turn = np.roll(p, -1, 0)
    sign = 1.0 if (p[:, 0] * turn[:, 1] - turn[:, 0] * p[:, 1]).sum() >= 0 else -1.0
    edge = turn - p
    edge = edge / np.maximum(np.linalg.norm(edge, axis=1, keepdims=True), 1e-300)
    normal = sign * np.column_stack([edge[:, 1], -edge[:, 0]])
    both = normal + np.roll(normal, 1, 0)
    size = np.linalg.norm(both, axis=1, keepdims=True)
    bisector = np.where(size > 1e-12, both / np.maximum(size, 1e-300), normal)
    cosine = np.maximum((bisector * normal).sum(1, keepdims=True), 0.1)
    return [(float(x), float(y)) for x, y in p + bisector * distance / cosine]


def polygon_area(polygon: Sequence[Sequence[float]]) -> float:
    p = np.asarray(polygon, float)
    if len(p) < 3:
        raise ValueError("a polygon has at least 3 vertices")
    q = np.roll(p, -1, 0)
    return float(abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2)


# interpolation and ground


def interpolate_idw(known: DataFrame, queries: DataFrame, k: int = 8, power: float = 2.0, max_distance: float = math.inf, exact: float = float(np.finfo(float).eps)) -> DataFrame:
    """``pid, z``: inverse-distance weighted z of the k nearest known points (XY). NaN for non-finite queries and where
    the nearest lies beyond ``max_distance``; the nearest's own z within ``exact``."""
    if k < 1 or not power > 0:
        raise ValueError("k must be at least 1 and the power positive")
    finite = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < math.inf) & (F.abs("y") < math.inf)
    near = knn_join(queries.where(finite), known, k, ("x", "y")).join(known.select("pid", F.col("z").alias("_z")), "pid")
    d = F.sqrt("d2")
    weighted = near.withColumn("w", F.when(d > exact, F.lit(1.0) / F.pow(d, F.lit(float(power)))))
    nearest = weighted.groupBy("qid").agg(F.min(F.struct(d.alias("d"), "rank", F.col("_z").alias("z"))).alias("n"), (F.sum(F.col("_z") * F.col("w")) / F.sum("w")).alias("mean"))
    value = F.when(F.col("n.d") > max_distance, math.nan).when(F.col("n.d") <= exact, F.col("n.z")).otherwise(F.col("mean"))
    return queries.select("pid").join(nearest.select(F.col("qid").alias("pid"), value.alias("z")), "pid", "left").select("pid", F.coalesce("z", F.lit(math.nan)).alias("z"))


def aboveground_height(points: DataFrame, ground: DataFrame, resolution: float, k: int = 8, power: float = 2.0, polygon: Sequence | None = None) -> DataFrame:
    """``points`` with ``AGH``: z less the ground height of the nearest cell of a lattice over the ground's box; NaN farther than sqrt(2) steps
    from it, for non-finite points and outside ``polygon``. Only cells that a point touches are interpolated."""
    if not resolution > 0:
        raise ValueError("the resolution must be positive")
    box = ground.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))], F.sum((~finite_points(("x", "y", "z"))).cast("int")).alias("bad")).first()
    if box["n"] < 3 or box["bad"]:
        raise ValueError("the ground needs at least 3 points, all finite")
    def snapped(c: str) -> Column:
        count = math.floor((box[f"{c}hi"] - box[f"{c}lo"]) / resolution) + 1
        return F.least(F.greatest(F.floor((F.col(c) - F.lit(box[f"{c}lo"])) / F.lit(resolution) + 0.5), F.lit(0)), F.lit(count - 1)).cast("long")

    finite = reduce(lambda a, b: a & b, [~F.isnan(c) & (F.abs(c) < math.inf) for c in "xyz"])
    placed = points.withColumns({"_ix": F.when(finite, snapped("x")), "_iy": F.when(finite, snapped("y"))})
    at = {c: F.lit(box[f"{c}lo"]) + F.col(f"_i{c}") * F.lit(float(resolution)) for c in "xy"}
    ids = F.col("_iy") * F.lit(2**31) + F.col("_ix")
    cells = placed.where("_ix is not null").select("_ix", "_iy").distinct().select(ids.alias("pid"), at["x"].alias("x"), at["y"].alias("y"))
    heights = interpolate_idw(ground, cells, k, power).select(F.col("pid").alias("_cell"), F.col("z").alias("_ground"))
    far = F.sqrt((F.col("x") - at["x"]) ** 2 + (F.col("y") - at["y"]) ** 2) > F.lit(math.sqrt(2) * resolution)
    value = F.when(far | F.col("_ground").isNull(), math.nan).otherwise(F.col("z") - F.col("_ground"))
    if polygon is not None:
        value = F.when(in_polygon(polygon), value).otherwise(math.nan)
    return placed.withColumn("_cell", ids).join(heights, "_cell", "left").withColumn("AGH", value).drop("_ix", "_iy", "_cell", "_ground")


def segment_ground(points: DataFrame, grid: float = 0.5, theta_deg: float = 60.0, voxel: float = 0.5, min_size: int = 50) -> DataFrame:
    """Points of large voxel components, then the lowest of each cell, then those in no upward cone of another."""
    return upward_conic_filter(grid_zmin(voxel_component_filter(points, voxel, min_size), grid), theta_deg)


def crop_by_ground_polygon(points: DataFrame, ground: DataFrame, buffer: float = 0.0, k: int = 6, n_sigma: float = 1.0) -> tuple[DataFrame, list | None, float]:
    """Points inside the buffered hull of the ground less its outliers; the polygon and its area. Nothing is cropped (None, 0.0) if there is no hull."""
    clean = statistical_filter(ground, k, n_sigma)
    try:
        polygon = buffer_polygon(convex_hull(clean), buffer)
    except ValueError:
        return points, None, 0.0
    return polygon_filter(points, polygon), polygon, polygon_area(polygon)


# surfaces


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Triangles (rows of positions in ``xy``, sorted) of the Delaunay triangulation, by inserting points and re-triangulating the
    cavity of triangles whose circle holds the point. A walk over neighbouring triangles finds the cavity."""
    xy = np.asarray(xy, float)
    if len(xy) < 3 or not np.isfinite(xy).all():
        raise ValueError("a triangulation needs at least 3 finite points")
    _, keep = np.unique(xy, axis=0, return_index=True)
    mid, span = xy.mean(0), max(np.ptp(xy[:, 0]), np.ptp(xy[:, 1]), 1e-12)
    n = len(xy)
    pts = np.concatenate([(xy - mid) / span, [[-1e4, -1e4], [1e4, -1e4], [0, 1e4]]])
    at_x, at_y = pts[:, 0].tolist(), pts[:, 1].tolist()
    corners, beside, rounds = [(n, n + 1, n + 2)], [[-1, -1, -1]], []  # counter-clockwise; beside[t][k]: across the side from corner k to the next

    def circle(a, b, c):
        ax, ay = at_x[a], at_y[a]
        bx, by, cx, cy = at_x[b] - ax, at_y[b] - ay, at_x[c] - ax, at_y[c] - ay
        d = 2 * (bx * cy - by * cx)
        bb, cc = bx * bx + by * by, cx * cx + cy * cy
        if d == 0:
            return (math.inf, math.inf, math.nan)
        ux, uy = (cy * bb - by * cc) / d, (bx * cc - cx * bb) / d
        return (ax + ux, ay + uy, (ux * ux + uy * uy) * (1 - 1e-12))

    rounds.append(circle(n, n + 1, n + 2))
    last = 0
    for i in keep.tolist():
        px, py = at_x[i], at_y[i]
        t, steps = last, 0
        while True:
            v, moved = corners[t], False
            for k in range(3):
                a, b = v[k], v[k - 2]
                if (at_x[b] - at_x[a]) * (py - at_y[a]) - (at_y[b] - at_y[a]) * (px - at_x[a]) < 0 and beside[t][k] >= 0:
                    t, moved = beside[t][k], True
                    break
            steps += 1
            if not moved or steps > 10 * len(corners) + 10:
                break
        x, y, r = rounds[t]
        if not (x - px) ** 2 + (y - py) ** 2 < r:
            t = next((m for m in (*(u for u in beside[t] if u >= 0), *range(len(rounds))) if (rounds[m][0] - px) ** 2 + (rounds[m][1] - py) ** 2 < rounds[m][2]), -1)
            if t < 0:
                continue
        bad, stack, rim = {t}, [t], []
        while stack:
            t = stack.pop()
            for k in range(3):
                u = beside[t][k]
                if u in bad:
                    continue
                if u >= 0:
                    x, y, r = rounds[u]
                    if (x - px) ** 2 + (y - py) ** 2 < r:
                        bad.add(u)
                        stack.append(u)
                        continue
                rim.append((corners[t][k], corners[t][k - 2], u, t))
        rim = [s for s in rim if s[2] not in bad]
        if len(rim) != len(bad) + 2 or {a for a, *_ in rim} != {b for _, b, *_ in rim} or len({a for a, *_ in rim}) != len(rim):
            return delaunay_scan(xy)  # by rounding, the cavity is no disc
        starts, made = {}, []
        gone = list(bad)
        for a, b, u, t in rim:
            if gone:
                m = gone.pop()
                corners[m], rounds[m] = (i, a, b), circle(i, a, b)
                beside[m] = [-1, u, -1]
            else:
                m = len(corners)
                corners.append((i, a, b))
                rounds.append(circle(i, a, b))
                beside.append([-1, u, -1])
            made.append(m)
            starts[a] = m
        for (a, b, u, t), m in zip(rim, made, strict=True):
            if u >= 0:
                v = corners[u]
                for k in range(3):
                    if v[k] == b and v[k - 2] == a:
                        beside[u][k] = m
            o = starts[b]
            beside[m][2], beside[o][0] = o, m  # across the side of b and i
        last = m
    tri = np.array(corners, np.int64)
    p, q = pts[tri[:, 1]] - pts[tri[:, 0]], pts[tri[:, 2]] - pts[tri[:, 0]]
    tri = tri[np.abs(p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]) > 1e-18]
    return np.sort(tri[(tri < n).all(1)], 1)


def delaunay_scan(xy: np.ndarray) -> np.ndarray:
    """``delaunay`` by trying all triangles for every point; its time grows with the square of the points."""
    xy = np.asarray(xy, float)
    if len(xy) < 3 or not np.isfinite(xy).all():
        raise ValueError("a triangulation needs at least 3 finite points")
    _, keep = np.unique(xy, axis=0, return_index=True)
    mid, span = xy.mean(0), max(np.ptp(xy[:, 0]), np.ptp(xy[:, 1]), 1e-12)
    n = len(xy)
    pts = np.concatenate([(xy - mid) / span, [[-1e4, -1e4], [1e4, -1e4], [0, 1e4]]])
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t):
        a, b, c = pts[t[:, 0]], pts[t[:, 1]], pts[t[:, 2]]
        b, c = b - a, c - a
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        bb, cc = (b**2).sum(1), (c**2).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.column_stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d])
        return a + u, (u**2).sum(1)

    centre, r2 = circles(tri)
    for i in keep:
        bad = ((centre - pts[i]) ** 2).sum(1) < r2 * (1 - 1e-12)
        if not bad.any():
            continue
        sides = np.sort(np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), 1)
        rim, times = np.unique(sides, axis=0, return_counts=True)
        rim = rim[times == 1]
        new = np.column_stack([rim, np.full(len(rim), i)])
        p, q = pts[new[:, 0]] - pts[i], pts[new[:, 1]] - pts[i]
        new = new[np.abs(p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]) > 1e-18]
        c, r = circles(new)
        tri, centre, r2 = np.concatenate([tri[~bad], new]), np.concatenate([centre[~bad], c]), np.concatenate([r2[~bad], r])
    return np.sort(tri[(tri < n).all(1)], 1)


def triangulation(points: DataFrame) -> DataFrame:
    """``tri_id, v1, v2, v3`` (pids) and ``ax..cz`` of the XY Delaunay triangulation; one task, for surfaces of moderate size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid").drop_duplicates(["x", "y"])
        xyz, ids = frame[["x", "y", "z"]].to_numpy(), frame["pid"].to_numpy()
        t = delaunay(xyz[:, :2])
        t = t[np.lexsort((t[:, 2], t[:, 1], t[:, 0]))]
        out = {"tri_id": np.arange(len(t)), **{f"v{i + 1}": ids[t[:, i]] for i in range(3)}}
        return pd.DataFrame(out | {f"{p}{c}": xyz[t[:, i], j] for i, p in enumerate("abc") for j, c in enumerate("xyz")})

    schema = "tri_id long, v1 long, v2 long, v3 long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz")
    return points.select("pid", "x", "y", "z").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda f: run(f.drop(columns="_all")), schema)


def mesh_distance_z(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """``pid, dz``: z less the surface's z at the point; NaN beside the surface. Points and triangles meet in XY cells of the mean triangle's size."""
    size = triangles.agg(F.avg(F.greatest(F.greatest("ax", "bx", "cx") - F.least("ax", "bx", "cx"), F.greatest("ay", "by", "cy") - F.least("ay", "by", "cy")))).first()[0]
    if not size:
        return points.select("pid", F.lit(math.nan).alias("dz"))
    cellof = lambda c: F.floor(c / F.lit(size)).cast("long")
    span = lambda c: F.explode(F.sequence(cellof(F.least(f"a{c}", f"b{c}", f"c{c}")), cellof(F.greatest(f"a{c}", f"b{c}", f"c{c}"))))
    spread = triangles.withColumn("gx", span("x")).withColumn("gy", span("y"))
    ok = ~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z")
    placed = points.where(ok).select("pid", "x", "y", "z", cellof(F.col("x")).alias("gx"), cellof(F.col("y")).alias("gy"))
    den = "((by - cy) * (ax - cx) + (cx - bx) * (ay - cy))"
    met = placed.join(spread, ["gx", "gy"]).where(f"{den} <> 0").withColumn("u", F.expr(f"((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / {den}")).withColumn("v", F.expr(f"((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / {den}"))
    hit = met.where("u >= -1e-12 and v >= -1e-12 and u + v <= 1 + 1e-12").withColumn("dz", F.expr("z - (u * az + v * bz + (1 - u - v) * cz)"))
    best = hit.groupBy("pid").agg(F.min_by("dz", "tri_id").alias("dz"))
    return points.select("pid").join(best, "pid", "left").select("pid", F.coalesce("dz", F.lit(math.nan)).alias("dz"))


# cylinders


def point_in_cylinder(p: Sequence[Column], c: Sequence[Column], axis: Sequence[Column], radius: Column, half: Column) -> Column:
    """Whether p lies in the closed cylinder about a unit axis; false unless radius and half height are positive and finite."""
    d = [a - b for a, b in zip(p, c, strict=True)]
    t = reduce(lambda a, b: a + b, [a * b for a, b in zip(d, axis, strict=True)])
    off = reduce(lambda a, b: a + b, [a * a for a in d]) - t * t
    return (radius > 0) & (half > 0) & (radius < math.inf) & (half < math.inf) & (F.abs(t) <= half) & (off <= radius * radius)


def cylinder_aabb(c: Sequence[Column], axis: Sequence[Column], radius: Column, half: Column) -> list[tuple[Column, Column]]:
    """Lower and upper limit of each coordinate."""
    reach = [half * F.abs(a) + radius * F.sqrt(F.greatest(F.lit(0.0), 1 - a * a)) for a in axis]
    return [(m - r, m + r) for m, r in zip(c, reach, strict=True)]


def aabbs_overlap(a: Sequence[tuple[Column, Column]], b: Sequence[tuple[Column, Column]]) -> Column:
    return reduce(lambda p, q: p & q, [(lo <= hi2) & (lo2 <= hi) for (lo, hi), (lo2, hi2) in zip(a, b, strict=True)])


def lattice_inside(cylinders: np.ndarray, low: np.ndarray, high: np.ndarray, res: float) -> np.ndarray:
    """Lattice centres ``(k + 0.5) * res`` in the box, as rows, and whether any cylinder (cx cy cz ax ay az r h) holds each."""
    axes = [np.arange(math.ceil(a / res - 0.5 - 1e-9), math.floor(b / res - 0.5 + 1e-9) + 1) for a, b in zip(low, high, strict=True)]
    grid = (np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3) + 0.5) * res
    inside = np.zeros(len(grid), bool)
    for c in np.atleast_2d(cylinders):
        d = grid - c[:3]
        t = d @ c[3:6]
        inside |= (c[6] > 0) & (c[7] > 0) & (np.abs(t) <= c[7]) & ((d * d).sum(1) - t * t <= c[6] ** 2)
    return inside


def cylinder_box(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = np.atleast_2d(c)
    reach = c[:, 7:8] * np.abs(c[:, 3:6]) + c[:, 6:7] * np.sqrt(np.maximum(0, 1 - c[:, 3:6] ** 2))
    return (c[:, :3] - reach).min(0), (c[:, :3] + reach).max(0)


def lattice_volume(cylinders: np.ndarray, res: float, most: int = 1_000_000) -> float:
    """Volume of the lattice centres in the union of the cylinders; slabs of the box are tried one after the other."""
    low, high = cylinder_box(cylinders)
    first, last = math.ceil(low[0] / res - 0.5 - 1e-9), math.floor(high[0] / res - 0.5 + 1e-9)
    thick = max(1, int(most / max(1.0, np.prod((high[1:] - low[1:]) / res + 1))))
    found = 0
    for k in range(first, last + 1, thick):
        low[0], high[0] = (k + 0.5) * res, (min(k + thick - 1, last) + 0.5) * res
        found += int(lattice_inside(cylinders, low, high, res).sum())
    return found * res**3


def voxel_volume(cylinders: DataFrame, res: float, key: str = "nbs_id") -> DataFrame:
    """``key, volume``: lattice centres in the union of the cylinders (cx cy cz dx dy dz radius half) of each key, times res cubed.

    Of cylinders about one centre and axis, those that another of them contains are left out. Each set of cylinders is measured once,
    however many keys have it. Cylinders whose radius or half height is not positive and finite hold nothing.
    """
    if not res > 0:
        raise ValueError("the resolution must be positive")
    place = ["cx", "cy", "cz", "dx", "dy", "dz"]
    solid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(c) < math.inf) for c in [*place, "radius", "half"]]) & (F.col("radius") > 0) & (F.col("half") > 0)
    own = cylinders.select(key, *[F.when(solid, F.col(c).cast("double")).alias(c) for c in [*place, "radius", "half"]])
    own = own.groupBy(key, *place, "half").agg(F.max("radius").alias("radius")).groupBy(key, *place, "radius").agg(F.max("half").alias("half"))
    each = F.when(F.col("radius").isNotNull(), F.array(*[F.col(c) for c in [*place, "radius", "half"]]))
    own = persist_table(own.groupBy(key).agg(F.array_sort(F.collect_set(each)).alias("_set")), "cylinder-sets")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"_set": f["_set"], "volume": [lattice_volume(np.stack([np.asarray(c, float) for c in s]), res) if len(s) else 0.0 for s in f["_set"]]})

    context = cylinders.sparkSession.sparkContext
    volumes = own.select("_set").distinct().repartition(2 * context.defaultParallelism).mapInPandas(run, "_set array<array<double>>, volume double")
    return own.join(volumes, "_set").select(F.col(key).cast("long").alias(key), "volume")


def frustum(r1: Column, r2: Column, h: Column) -> tuple[Column, Column]:
    """Volume and lateral surface."""
    return F.lit(math.pi / 3) * h * (r1 * r1 + r2 * r2 + r1 * r2), F.lit(math.pi) * (r1 + r2) * F.sqrt(h * h + (r1 - r2) * (r1 - r2))


# principal axes


def pca_linearity(points: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """``key, n, x, y, z, dx, dy, dz, linearity`` of groups of at least 3 points whose scatter has linearity (l3 - l2) / l3 of at least the threshold.

    Moments about the group's centre are sums in Spark; only the eigenvectors of one 3x3 matrix a group are found in numpy. The axis points up.
    """
    mid = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    off = points.join(mid.where("n >= 3"), key)
    sums = off.groupBy(key, "n", "mx", "my", "mz").agg(*[F.sum((F.col(a) - F.col(f"m{a}")) * (F.col(b) - F.col(f"m{b}"))).alias(f"s{a}{b}") for a, b in pairs])

    def run(frames):
        for f in frames:
            m = np.zeros((len(f), 3, 3))
            for a, b in pairs:
                i, j = "xyz".index(a), "xyz".index(b)
                m[:, i, j] = m[:, j, i] = f[f"s{a}{b}"]
            val, vec = np.linalg.eigh(m) if len(f) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            d = vec[:, :, 2]
            first = np.where(np.abs(d[:, 2]) > 1e-12, d[:, 2], np.where(np.abs(d[:, 1]) > 1e-12, d[:, 1], d[:, 0]))
            d = d * np.where(first < 0, -1, 1)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                line = (val[:, 2] - val[:, 1]) / val[:, 2]
            ok = (val[:, 2] > 0) & (line >= threshold)
            yield pd.DataFrame({key: f[key], "n": f["n"], "x": f["mx"], "y": f["my"], "z": f["mz"], "dx": d[:, 0], "dy": d[:, 1], "dz": d[:, 2], "linearity": line})[ok]

    kind = dict(points.dtypes)[key]
    return sums.mapInPandas(run, f"{key} {kind}, n long, x double, y double, z double, dx double, dy double, dz double, linearity double")
