"""Trees from points above ground: components, segments, trial model, refinement, assembly, rescue of occluded branches; and the final model.

The sequential kernels run once a connected component (or segment) in grouped-map tasks; everything that crosses components is joins and aggregates.
A component is one task's work, so a cloud whose stems all touch needs subsampling or tiling first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..session import persist_table
from . import growth, slices
from .filters import above_threshold
from .geometry import cylinder_box, lattice_inside
from .grid import Grid
from .labels import relabel_by_occurrence, relabel_within_trees
from .neighbours import near_pairs
from .tiles import radius_components

NODE_COLS = ["agh", "height", "completeness", "n_points", "center_x", "center_y", "center_z", "direction_x", "direction_y", "direction_z", "cross_area", "circumference", "radius_area", "radius_circ"]
NODE_SCHEMA = ", ".join(f"{c} {'long' if c == 'n_points' else 'double'}" for c in NODE_COLS)


def ceiling(cfg: Config) -> float:
    return cfg.tree.nearground_agh_threshold + 2 * cfg.pipeline.subsample_res


def radius_of(cfg: Config) -> float:
    return cfg.tree.neighbor_radius if cfg.tree.neighbor_radius > 0 else 2 * cfg.pipeline.subsample_res


def with_components(points: DataFrame, radius: float) -> DataFrame:
    """``points`` with ``cc``, the smallest pid of the component."""
    found = radius_components(points, radius).select(F.col("pid").alias("_p"), F.col("component").alias("cc"))
    return points.join(found, F.col("pid") == F.col("_p"), "left").withColumn("cc", F.coalesce("cc", "pid")).drop("_p")


def global_ids(rows: DataFrame, group: str, local: str, out: str) -> DataFrame:
    """Numbers 1.. for the pairs (group, local > 0), in that order; one row a group is summed, not the points."""
    most = rows.groupBy(group).agg(F.max(local).alias("_m"))
    before = most.select(F.col(group).alias("_g"), F.coalesce(F.sum("_m").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, F.col(group) == F.col("_g")).withColumn(out, F.when(F.col(local) > 0, F.col(local) + F.col("_before")).otherwise(0)).drop("_g", "_before")


def label_segments(points: DataFrame, cfg: Config) -> DataFrame:
    """``points`` (with cc, AGH) with ``nbs_id`` and ``node_id``, unique over all components."""
    t, radius, top = cfg.tree, radius_of(cfg), ceiling(cfg)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid")
        xyz = frame[["x", "y", "z"]].to_numpy()
        nbs, node = growth.label_segments(Grid(xyz, radius), xyz, frame["AGH"].to_numpy(), top, t.nbs_neighbor_distance, t.linearity_angle_deg, t.frontier_min_cc_size, t.min_nbs_size)
        return pd.DataFrame({"pid": frame["pid"].to_numpy(), "cc": frame["cc"].to_numpy(), "nbs": nbs, "node": node})

    local = persist_table(points.select("pid", "cc", "x", "y", "z", "AGH").groupBy("cc").applyInPandas(run, "pid long, cc long, nbs long, node long"), "segments")
    ids = global_ids(global_ids(local, "cc", "nbs", "nbs_id"), "cc", "node", "node_id").select("pid", "nbs_id", "node_id")
    return points.drop("nbs_id", "node_id").join(ids, "pid")


def model_segments(points: DataFrame, cfg: Config, group: str = "tree_nbs_id", surface: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of every segment, the node of every point, and surface points (x, y, z, rho) if asked for.

    ``nodes`` has qsm_node_id (numbered by segment, then slice), nbs_id, tree_id, tree_nbs_id and the fitted values.
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid")
        got = slices.model_segment(frame[["x", "y", "z"]].to_numpy(), frame["AGH"].to_numpy(), cfg, surface)
        nan = {c: np.nan for c in NODE_COLS}
        rows = []
        if got is not None:
            tree = int(frame["tree_id"].to_numpy()[got["first"]]) if got["first"] is not None else 0
            rows += [{"kind": 0, "seg": key[0], "slot": i, "tree_id": tree, **n} for i, n in enumerate(got["nodes"], 1)]
            rows += [{**nan, "kind": 1, "seg": key[0], "slot": int(s), "pid": int(p)} for p, s in zip(frame["pid"], got["node"], strict=True) if s]
            rows += [{**nan, "kind": 2, "seg": key[0], "slot": 0, "center_x": a, "center_y": b, "center_z": c, "radius_area": r} for a, b, c, r in got["surface"].tolist()]
        out = pd.DataFrame(rows, columns=["kind", "seg", "slot", "pid", "tree_id", *NODE_COLS])
        return out.astype({"kind": "int32", "seg": "int64", "slot": "int64", "pid": "Int64", "tree_id": "Int64", "n_points": "Int64"} | {c: "float64" for c in NODE_COLS if c != "n_points"})

    have = points.withColumn("seg", F.col(group).cast("long")).where("seg > 0")
    for c, v in (("tree_id", F.lit(0)), ("AGH", F.lit(0.0))):
        have = have if c in have.columns else have.withColumn(c, v)
    rows = have.select("seg", "pid", "x", "y", "z", "AGH", F.col("tree_id").cast("long").alias("tree_id")).groupBy("seg").applyInPandas(run, f"kind int, seg long, slot long, pid long, tree_id long, {NODE_SCHEMA}")
    rows = persist_table(rows, "model")
    made = rows.where("kind = 0")
    starts = made.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).select(F.col("seg").alias("_s"), F.coalesce(F.sum("n").over(Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = (F.col("slot") + F.col("_before")).alias("qsm_node_id")
    nodes = made.join(starts, F.col("seg") == F.col("_s")).select(number, F.col("seg").alias("nbs_id"), "tree_id", F.col("seg").alias("tree_nbs_id"), *NODE_COLS)
    of_points = rows.where("kind = 1").join(starts, F.col("seg") == F.col("_s")).select("pid", number)
    cloud = rows.where("kind = 2").select(F.col("center_x").alias("x"), F.col("center_y").alias("y"), F.col("center_z").alias("z"), F.col("seg").alias("tree_nbs_id"), F.col("radius_area").alias("rho"))
    return nodes, of_points, cloud


def refine_kernel(points: pd.DataFrame, nodes: pd.DataFrame, cfg: Config) -> tuple[np.ndarray, list[dict], list[dict]]:
    """Branch of each point of one component after merging, and the reports. ``points`` has nbs_id, node_id, trial_node_id in pid order;
    ``nodes`` the trial nodes of the component."""
    r, res = cfg.tree.refine, cfg.pipeline.subsample_res * cfg.tree.refine.voxel_res_scalar
    nbs, node = points["nbs_id"].to_numpy().copy(), points["node_id"].to_numpy()
    if not res > 0:
        return nbs, [], []
    ok = nodes[np.isfinite(nodes["radius_area"]) & (nodes["radius_area"] > 0)]
    cyl = np.column_stack([ok[["center_x", "center_y", "center_z", "direction_x", "direction_y", "direction_z", "radius_area"]].to_numpy(float), ok["height"].to_numpy(float) / 2])
    boxes = [cylinder_box(c) for c in cyl]
    volume = np.array([lattice_inside(c, *b, res).sum() * res**3 for c, b in zip(cyl, boxes, strict=True)])
    seg, trial, count, complete, agh = (ok[c].to_numpy()[volume > 0] for c in ("nbs_id", "qsm_node_id", "n_points", "completeness", "agh"))
    cyl, boxes, volume = cyl[volume > 0], [b for b, v in zip(boxes, volume, strict=True) if v > 0], volume[volume > 0]

    def totals(of: np.ndarray) -> dict[int, float]:
        out = dict.fromkeys(np.unique(nbs[nbs > 0]).tolist(), 0.0)
        for b, v in zip(of.tolist(), volume.tolist(), strict=True):
            out[b] = out.get(b, 0.0) + v
        return out

    size = totals(seg)
    bigger = lambda a, b: (size[a], -a) > (size[b], -b)
    xyz = points[["x", "y", "z"]].to_numpy()
    owner = {int(m): int(b) for m, b in zip(node, nbs, strict=True) if m > 0 and b > 0}
    total, touch = {}, {}
    for b in owner.values():
        total[b] = total.get(b, 0) + 1
    for src, dst in Grid(xyz, radius_of(cfg)).pairs():
        ends = np.column_stack([node[src], node[dst]])
        for i, j in np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0).tolist():
            for a, b in ((i, j), (j, i)):
                if a in owner and b in owner and owner[a] != owner[b]:
                    touch.setdefault((owner[a], owner[b]), set()).add(a)
    into, merges = {}, []
    for donor in sorted(total):
        fit = [(len(t), size[b], -b) for (a, b), t in touch.items() if a == donor and bigger(b, donor) and len(t) / total[donor] >= cfg.tree.assembly.merge_threshold]
        if fit:
            n, _, minus = max(fit)
            into[donor] = -minus
            merges.append({"donor_nbs": donor, "receiver_nbs": -minus, "donor_vol": size[donor], "receiver_vol": size[-minus], "frac_connected": n / total[donor], "n_donor_skel_nodes": total[donor]})

    def root(b: int) -> int:
        while b in into:
            b = into[b]
        return b

    for m in merges:
        m["receiver_nbs"] = root(m["receiver_nbs"])
    of = np.array([root(int(b)) for b in seg], np.int64)
    size = totals(of)
    claimed, moves = {}, []
    for focal in sorted(np.unique(of).tolist(), key=lambda b: (-size[b], b)):
        own = of == focal
        low, high = cylinder_box(cyl[own])
        focal_complete, focal_points = float(complete[own].mean()), int(count[own].sum())
        reach = cyl[:, 6] + cyl[:, 7]
        margin = r.candidate_radius_scalar * cfg.pipeline.subsample_res
        for i in np.flatnonzero(~own):
            if i in claimed or not bigger(focal, int(of[i])):
                continue
            if (np.linalg.norm(cyl[own, :3] - cyl[i, :3], axis=1) > reach[own] + reach.max() + margin).all():
                continue
            lo, hi = np.maximum(low, boxes[i][0]), np.minimum(high, boxes[i][1])
            if (lo > hi).any():
                continue
            ratio = float((lattice_inside(cyl[i], lo, hi, res) & lattice_inside(cyl[own], lo, hi, res)).sum() * res**3 / volume[i])
            if ratio > r.overlap_threshold and complete[i] >= r.completeness_gate and focal_complete >= r.completeness_gate and focal_points >= r.min_points_gate:
                claimed[i] = focal
                moves.append({"trial_node_id": int(trial[i]), "from_nbs": int(of[i]), "to_nbs": int(focal), "node_overlap_ratio": ratio, "node_n_points": int(count[i]), "node_completeness": float(complete[i]), "node_agh": float(agh[i])})
    if r.mode != "apply":
        return nbs, merges, moves
    nbs = np.array([root(int(b)) if b > 0 else b for b in nbs])
    target = {int(trial[i]): b for i, b in claimed.items()}
    of_trial = points["trial_node_id"].to_numpy()
    nbs = np.array([target.get(int(t), int(b)) for t, b in zip(of_trial, nbs, strict=True)], np.int64)
    for m in np.unique(node[node > 0]):
        ids, n = np.unique(nbs[node == m], return_counts=True)
        nbs[node == m] = ids[n.argmax()]
    stay = []
    for m in moves:
        ids, n = np.unique(nbs[of_trial == m["trial_node_id"]], return_counts=True)
        if len(ids) and ids[n.argmax()] == m["to_nbs"]:
            stay.append(m)
    return nbs, merges, stay


def dense(values: np.ndarray) -> np.ndarray:
    ids, n = np.unique(values[values > 0], return_counts=True)
    rank = {int(v): i for i, v in enumerate(ids[np.lexsort((ids, -n))], 1)}
    return np.array([rank.get(int(v), 0) for v in values])


def occluded_branches(points: DataFrame, cfg: Config) -> DataFrame:
    """``points`` with the tree of branches that have none: in rounds, a branch joins the tree most of whose frontier points lie within reach, ties
    to the smaller tree; what has joined is the next frontier. Nothing changes for a tolerance of 0."""
    tolerance, res = cfg.tree.assembly.occlusion_tolerance, cfg.pipeline.subsample_res
    if not tolerance > 0:
        return points
    reach = tolerance + res
    core = ["pid", "x", "y", "z"]
    orphans = persist_table(points.where("tree_id = 0 and tree_nbs_id > 0").select(*core, F.col("tree_nbs_id").alias("branch")), "orphans")
    front = points.where("tree_id > 0").select(*core, "tree_id")
    joined = None
    while not orphans.isEmpty():
        close = near_pairs(front, orphans, reach).where(F.col("d2") <= reach * reach)
        votes = close.groupBy(F.col("b.branch").alias("branch"), F.col("a.tree_id").alias("tree_id")).agg(F.count(F.lit(1)).alias("n"))
        won = persist_table(votes.groupBy("branch").agg(F.min(F.struct((-F.col("n")).alias("m"), "tree_id")).alias("w")).select("branch", F.col("w.tree_id").alias("tree_id")), "rescued")
        if won.isEmpty():
            break
        joined = won if joined is None else joined.unionAll(won)
        front = persist_table(orphans.join(won, "branch").select(*core, "tree_id"), "front")
        orphans = persist_table(orphans.join(won, "branch", "left_anti").select(*core, "branch"), "orphans")
    if joined is None:
        return points
    side = joined.select(F.col("branch").alias("_b"), F.col("tree_id").alias("_t"))
    return points.join(side, (F.col("tree_nbs_id") == F.col("_b")) & (F.col("tree_id") == 0), "left").withColumn("tree_id", F.coalesce("_t", "tree_id")).drop("_b", "_t")


def tree_segmentation(points: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``points`` above the ground threshold with tree_id, tree_nbs_id, nbs_id; and the two refinement reports."""
    if "AGH" not in points.columns:
        raise ValueError("tree segmentation needs the height above ground (AGH)")
    above = above_threshold(points, cfg.tree.nearground_agh_threshold)
    above = persist_table(label_segments(with_components(above, radius_of(cfg)), cfg), "labelled")
    top, radius = ceiling(cfg), radius_of(cfg)
    nodes, trial, _ = model_segments(above, cfg, "nbs_id")
    home = above.where("nbs_id > 0").select(F.col("nbs_id").alias("_n"), "cc").distinct()
    nodes = persist_table(nodes.join(home, F.col("nbs_id") == F.col("_n")).drop("_n"), "trial-nodes")
    rows = above.join(trial.select("pid", F.col("qsm_node_id").alias("trial_node_id")), "pid", "left").select("cc", "pid", "x", "y", "z", "AGH", "nbs_id", "node_id", F.coalesce("trial_node_id", F.lit(0).cast("long")).alias("trial_node_id"))
    report = "kind int, cc long, pid long, tree long, branch long, donor_nbs long, receiver_nbs long, donor_vol double, receiver_vol double, frac_connected double, n_donor_skel_nodes long, trial_node_id long, from_nbs long, to_nbs long, node_overlap_ratio double, node_n_points long, node_completeness double, node_agh double"
    names = [c.split() for c in report.split(", ")]

    def run(key, own: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pid").reset_index(drop=True)
        if not len(own):
            return pd.DataFrame({n: pd.Series(dtype="Int64" if t in ("int", "long") else "float64") for n, t in names})
        nbs, merges, moves = refine_kernel(own, fitted.sort_values("qsm_node_id"), cfg) if cfg.tree.refine.enable else (own["nbs_id"].to_numpy(), [], [])
        pairs = Grid(own[["x", "y", "z"]].to_numpy(), radius).pairs()
        tree, branch = growth.assemble_pairs(pairs, dense(nbs), own["node_id"].to_numpy(), own["AGH"].to_numpy(), top, cfg.tree.assembly.merge_threshold)
        base = pd.DataFrame({"kind": 0, "cc": key[0], "pid": own["pid"], "tree": tree, "branch": branch})
        extra = pd.DataFrame([{"kind": 1, "cc": key[0], **m} for m in merges] + [{"kind": 2, "cc": key[0], **m} for m in moves])
        out = pd.concat([base, extra]).reindex(columns=[n for n, _ in names])
        return out.astype({n: "Int64" if t in ("int", "long") else "float64" for n, t in names})

    done = persist_table(rows.groupBy("cc").cogroup(nodes.groupBy("cc")).applyInPandas(run, report), "assembled")
    local = done.where("kind = 0").select("pid", "cc", "tree", "branch")
    ids = global_ids(global_ids(local, "cc", "tree", "tree_id"), "cc", "branch", "tree_nbs_id").select("pid", "tree_id", "tree_nbs_id")
    out = persist_table(above.drop("cc", "node_id").join(ids, "pid"), "trees")
    out = occluded_branches(out, cfg)
    out = relabel_by_occurrence(out.withColumnRenamed("tree_id", "_tree"), "_tree", "tree_id", positive_only=True).drop("_tree")
    out = relabel_within_trees(out.withColumnRenamed("tree_nbs_id", "_branch"), "tree_id", "_branch", "tree_nbs_id").drop("_branch")
    return out, done.where("kind = 1").select(*[n for n, _ in names[5:11]]), done.where("kind = 2").select(*[n for n, _ in names[11:]])


def model_trees(points: DataFrame, cfg: Config, surface: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, points with ``node_id`` (0: none), and the surface cloud of the final branches."""
    nodes, of_points, cloud = model_segments(points, cfg, "tree_nbs_id", surface)
    joined = points.drop("node_id").join(of_points, "pid", "left").withColumn("node_id", F.coalesce("qsm_node_id", F.lit(0).cast("long"))).drop("qsm_node_id")
    return nodes, joined, cloud


