"""The model of one unbranched segment: slices along its axis, centres, an unrolled radius surface, and the nodes that result. Plain numpy."""

from __future__ import annotations

import math

import numpy as np

from ..config import Config
from .growth import radius_pairs
from .labels import union_find

OCTANT = math.pi / 4
QC_RADIUS = 2.0  # times the subsample resolution


def basis(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors across d; the first from the coordinate axis that d follows least."""
    e1 = np.cross(d, np.eye(3)[int(np.abs(d).argmin())])
    e1 /= np.linalg.norm(e1)
    return e1, np.cross(d, e1)


def circle_fit(u: np.ndarray, v: np.ndarray) -> tuple[float, float, float]:
    """Algebraic least-squares circle about the points; their centroid and mean distance where that has no solution."""
    um, vm = u.mean(), v.mean()
    a, b = u - um, v - vm
    rows = np.column_stack([2 * a, 2 * b, np.ones(len(a))])
    gram = rows.T @ rows
    if np.linalg.matrix_rank(gram) < 3:
        return float(um), float(vm), float(np.hypot(a, b).mean())
    x = np.linalg.solve(gram, rows.T @ (a * a + b * b))
    return float(um + x[0]), float(vm + x[1]), math.sqrt(max(0.0, x[2] + x[0] ** 2 + x[1] ** 2))


def octants(u: np.ndarray, v: np.ndarray) -> int:
    return len(np.unique(np.clip(np.floor((np.arctan2(v, u) + math.pi) / OCTANT), 0, 7)))


def inliers(xyz: np.ndarray, k: int, n_sigma: float) -> np.ndarray:
    """Statistical outlier removal among a slice's points."""
    n = len(xyz)
    if n <= k:
        return np.ones(n, bool)
    mean = np.empty(n)
    for a in range(0, n, 512):
        d = np.sqrt(((xyz[a : a + 512, None] - xyz[None]) ** 2).sum(2))
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        mean[a : a + 512] = np.partition(d, k - 1, axis=1)[:, :k].mean(1)
    return mean <= mean.mean() + n_sigma * mean.std(ddof=1)


def dominant_part(xyz: np.ndarray, uv: np.ndarray, radius: float, least: int, ratio: float, before: tuple | None) -> np.ndarray:
    """Points of the largest part, or of the second if it is nearly as large and nearer to the centre before."""
    label = np.arange(len(xyz))
    src, dst = radius_pairs(xyz, radius)
    if len(src):
        node, part = union_find(src, dst)
        label[node] = part
    ids, counts = np.unique(label, return_counts=True)
    order = [i for i in np.lexsort((ids, -counts)) if counts[i] >= least]
    if not order:
        return np.zeros(len(xyz), bool)
    pick = order[0]
    if len(order) > 1 and before is not None and counts[order[1]] >= ratio * counts[order[0]]:
        off = [((uv[label == ids[i]].mean(0) - before) ** 2).sum() for i in order[:2]]
        pick = order[1] if off[1] < off[0] else order[0]
    return label == ids[pick]


def centreline(centers: np.ndarray, valid: np.ndarray, axis: np.ndarray, window: int = 2) -> np.ndarray:
    """Missing centres from their valid neighbours (linear between, constant beyond; ``axis`` if there is none), then a moving mean."""
    s = np.arange(len(centers))
    full = np.column_stack([np.interp(s, s[valid], centers[valid, i]) for i in range(3)]) if valid.any() else axis.astype(float)
    if window <= 0 or len(s) < 2:
        return full
    total = np.concatenate([np.zeros((1, 3)), np.cumsum(full, 0)])
    lo, hi = np.maximum(0, s - window), np.minimum(len(s), s + window + 1)
    return (total[hi] - total[lo]) / (hi - lo)[:, None]


def rho_surface(rho: np.ndarray, phi: np.ndarray, slices: np.ndarray, n_slices: int, bins: int) -> np.ndarray:
    """Mean radius of each (angle bin, slice); NaN where empty."""
    b = np.clip(np.floor((phi + math.pi) / (2 * math.pi / bins)).astype(int), 0, bins - 1)
    at = b * n_slices + slices
    count = np.bincount(at, minlength=bins * n_slices)
    with np.errstate(invalid="ignore"):
        return (np.bincount(at, rho, bins * n_slices) / count).reshape(bins, n_slices)


def fill_gaps(surface: np.ndarray) -> np.ndarray:
    """Empty cells, slice by slice and bin by bin, as the mean of the nearest filled cell in each of four directions, weighted by 1 / steps;
    a cell filled earlier serves later ones."""
    out = surface.copy()
    bins, n = out.shape
    reach = max(bins // 2, n)
    for s in range(n):
        for b in np.flatnonzero(np.isnan(out[:, s])):
            found = []
            ring = np.isfinite(out[:, s])
            for sign in (1, -1):
                steps = np.flatnonzero(ring[(b + sign * np.arange(1, reach + 1)) % bins])
                if len(steps):
                    found.append((steps[0] + 1, out[(b + sign * (steps[0] + 1)) % bins, s]))
            for line, sign in ((out[b, s + 1 :], 1), (out[b, :s][::-1], -1)):
                steps = np.flatnonzero(np.isfinite(line))
                if len(steps):
                    found.append((steps[0] + 1, line[steps[0]]))
            if found:
                w = np.array([1 / k for k, _ in found])
                out[b, s] = (w * [r for _, r in found]).sum() / w.sum()
    return out


def smooth(surface: np.ndarray, s_phi: float, s_z: float) -> np.ndarray:
    """Three-point smoothing, periodic in the angle, mirrored at the ends of the axis."""
    out = (1 - s_phi) * surface + s_phi / 2 * (np.roll(surface, 1, 0) + np.roll(surface, -1, 0))
    if out.shape[1] == 1:
        return out
    edge = np.concatenate([out[:, 1:2], out, out[:, -2:-1]], 1)
    return (1 - s_z) * out + s_z / 2 * (edge[:, :-2] + edge[:, 2:])


def rho_keep(rho: np.ndarray, slices: np.ndarray, percentile: float) -> np.ndarray:
    """Points whose radius is at most the slice's quantile; all for a percentile of 1 or more."""
    keep = np.ones(len(rho), bool)
    if percentile < 1:
        for s in np.unique(slices):
            own = slices == s
            keep[own] = rho[own] <= np.quantile(rho[own], percentile)
    return keep


def cross_sections(surface: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Area and circumference of each slice of a filled surface, with central differences in the angle."""
    step = 2 * math.pi / len(surface)
    slope = (np.roll(surface, -1, 0) - np.roll(surface, 1, 0)) / (2 * step)
    ok = np.isfinite(surface)
    return np.where(ok, 0.5 * surface**2 * step, 0).sum(0), np.where(ok, np.sqrt(surface**2 + slope**2) * step, 0).sum(0)


def surface_points(surface: np.ndarray, centers: np.ndarray, e1: np.ndarray, e2: np.ndarray, height: float, res: float) -> np.ndarray:
    """Rows x, y, z, rho: the surface at the slices and at even steps between them."""
    bins, n = surface.shape
    phi = -math.pi + (np.arange(bins) + 0.5) * 2 * math.pi / bins
    ray = np.cos(phi)[:, None] * e1 + np.sin(phi)[:, None] * e2
    steps, out = max(1, math.ceil(height / res)), []
    for s in range(n):
        for k in range(steps if s < n - 1 else 1):
            f = k / steps
            a, b = surface[:, s], surface[:, min(s + 1, n - 1)]
            ok = np.isfinite(a) & (a > 0) & ((k == 0) | (np.isfinite(b) & (b > 0)))
            rho = (a + f * (b - a) if k else a)[ok]
            middle = centers[s] + f * (centers[min(s + 1, n - 1)] - centers[s])
            out.append(np.column_stack([middle + rho[:, None] * ray[ok], rho]))
    return np.concatenate(out)


def model_segment(xyz: np.ndarray, agh: np.ndarray, cfg: Config, with_surface: bool = False) -> dict | None:
    """Nodes of one segment (rows in point order); None if it is no line.

    Result: ``nodes`` (list of dicts in slice order), ``node`` (1-based number of each point's node, 0: none), ``surface`` (rows x y z rho).
    """
    m, res = cfg.tree.model, cfg.pipeline.subsample_res
    if len(xyz) < 3:
        return None
    mid = xyz.mean(0)
    off = xyz - mid
    value, vector = np.linalg.eigh(off.T @ off)
    if not value[2] > 0 or (value[2] - value[1]) / value[2] < m.nbs_linearity_threshold:
        return None
    d = vector[:, 2]
    up = xyz[xyz[:, 2].argmax()] - xyz[xyz[:, 2].argmin()]
    d = -d if up @ d < 0 else d
    e1, e2 = basis(d)
    t, uv = off @ d, np.column_stack([off @ e1, off @ e2])
    height = m.slice_height_scalar * res
    n = max(1, math.ceil((np.ptp(t)) / height))
    where = np.clip(np.floor((t - t.min()) / height).astype(int), 0, n - 1)
    axis = mid + (t.min() + (np.arange(n) + 0.5) * height)[:, None] * d
    centers, valid, kept, before = axis.copy(), np.zeros(n, bool), np.ones(len(xyz), bool), None
    sor = cfg.statistical_filter
    for s in range(n):
        own = np.flatnonzero(where == s)
        if len(own) < m.min_node_size:
            continue
        if m.qc_enable:
            clean = own[inliers(xyz[own], sor.k_neighbors, sor.n_sigma)]
            if len(clean) >= m.min_node_size:
                clean = clean[dominant_part(xyz[clean], uv[clean], QC_RADIUS * res, m.min_node_size, m.qc_continuity_ratio, before)]
            kept[own] = False
            if len(clean) < m.min_node_size:
                continue
            kept[clean] = True
            own = clean
        u, v = uv[own, 0], uv[own, 1]
        cu, cv = u.mean(), v.mean()
        if len(own) >= 10 and octants(u, v) >= m.min_octant_taubin:
            fu, fv, _ = circle_fit(u, v)
            if octants(u - fu, v - fv) >= m.min_octant_taubin:
                cu, cv = fu, fv
        valid[s], before = True, np.array([cu, cv])
        centers[s] = axis[s] + cu * e1 + cv * e2
    line = centreline(centers, valid, axis)
    rel = xyz - line[where]
    u, v = rel @ e1, rel @ e2
    rho, phi = np.hypot(u, v), np.arctan2(v, u)
    at = np.flatnonzero(kept)
    at = at[rho_keep(rho[at], where[at], m.rho_percentile)]
    middle = float(np.median(rho[at])) if len(at) else 0.01
    fine = m.surface_res_scalar * res
    bins = int(min(max(math.ceil(2 * math.pi * middle / fine), m.phi_bin_min), m.phi_bin_max)) if fine > 0 else m.phi_bin_max
    raw = rho_surface(rho[at], phi[at], where[at], n, bins)
    complete = np.isfinite(raw).mean(0)
    surface = smooth(fill_gaps(raw), 0.5, m.spl_z_smoothing)
    area, ring = cross_sections(surface)
    number, nodes = np.zeros(len(xyz), np.int64), []
    for s in range(n):
        own = at[where[at] == s]
        if len(own) >= m.min_node_size and complete[s] >= m.completeness_threshold and complete[s] > 0:
            nodes.append({
                "agh": float(np.mean(agh[own])), "height": height, "completeness": float(complete[s]), "n_points": len(own), **dict(zip(("center_x", "center_y", "center_z"), map(float, line[s]), strict=True)), **dict(zip(("direction_x", "direction_y", "direction_z"), map(float, d), strict=True)),
                "cross_area": float(area[s]), "circumference": float(ring[s]), "radius_area": math.sqrt(max(0.0, area[s] / math.pi)), "radius_circ": float(ring[s]) / (2 * math.pi),
            })
            number[own] = len(nodes)
    return {"nodes": nodes, "node": number, "first": int(at[0]) if len(at) else None, "surface": surface_points(surface, line, e1, e2, height, res) if with_surface else np.zeros((0, 4))}
