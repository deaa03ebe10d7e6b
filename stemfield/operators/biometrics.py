"""Node and tree tables of a fitted model, and the refinement steps that are plain relational work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import frustum


def node_table(nodes: DataFrame, radius: str = "radius_area") -> DataFrame:
    """``nodes`` with ``volume`` and ``surface_area``: a frustum between the radii halfway to the neighbours along the branch (by agh);
    an end node uses its own radius and its neighbour's, a single node its own twice."""
    w = Window.partitionBy("nbs_id").orderBy("agh", "node_id")
    before, r, after = F.lag(radius).over(w), F.col(radius), F.lead(radius).over(w)
    inner = before.isNotNull() & after.isNotNull()
    rows = nodes.withColumns({"_r1": F.when(inner, (before + r) / 2).otherwise(F.coalesce(before, r)), "_r2": F.when(inner, (r + after) / 2).otherwise(F.coalesce(after, r))})
    volume, surface = frustum(F.col("_r1"), F.col("_r2"), F.col("height"))
    return rows.withColumns({"volume": volume, "surface_area": surface}).drop("_r1", "_r2")


def tree_table(nodes: DataFrame, breast_height: float = 1.3) -> DataFrame:
    """One row a tree (id > 0): sums of volume and surface, height (largest agh), diameters and place of the node nearest to breast
    height (ties to the smaller node id), points and nodes."""
    near = F.struct(F.abs(F.col("agh") - F.lit(breast_height)).alias("d"), "node_id")
    at = lambda c: F.min_by(c, near)
    return nodes.where("tree_id > 0").groupBy("tree_id").agg(
        F.sum("volume").alias("volume"), F.sum("surface_area").alias("surface_area"), F.max("agh").alias("height"), (2 * at("radius_area")).alias("dbh_area"), (2 * at("radius_circ")).alias("dbh_circ"),
        F.sum("n_points").alias("n_points"), F.count(F.lit(1)).alias("n_nodes"), at("center_x").alias("x"), at("center_y").alias("y"),
    )


def skeleton(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node_id, x, y, z, n_points`` (centroids of node_id > 0) and edges ``na < nb`` between nodes that a point edge joins."""
    own = points.where("node_id > 0")
    nodes = own.groupBy("node_id").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n_points"))
    side = own.select("pid", "node_id")
    crossing = edges.join(side.toDF("src", "a"), "src").join(side.toDF("dst", "b"), "dst").where("a <> b")
    return nodes, crossing.select(F.least("a", "b").alias("na"), F.greatest("a", "b").alias("nb")).distinct()


def nbs_adjacency(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``nbs_a < nbs_b, n``: point edges between branches."""
    side = points.where("nbs_id > 0").select("pid", "nbs_id")
    crossing = edges.join(side.toDF("src", "a"), "src").join(side.toDF("dst", "b"), "dst").where("a <> b")
    return crossing.groupBy(F.least("a", "b").alias("nbs_a"), F.greatest("a", "b").alias("nbs_b")).agg(F.count(F.lit(1)).alias("n"))


def seed_trees(points: DataFrame, ceiling: float) -> DataFrame:
    """``nbs_id, tree_id``: branches whose lowest height above ground is at most the ceiling, numbered in their order."""
    low = points.where("nbs_id > 0").groupBy("nbs_id").agg(F.min("AGH").alias("low")).where(F.col("low") <= ceiling)
    return low.select("nbs_id", F.row_number().over(Window.orderBy("nbs_id")).alias("tree_id"))


def snap_to_nodes(points: DataFrame) -> DataFrame:
    """``pid, nbs_id``: the commonest branch of each node's points, ties to the smaller id; points of node 0 keep theirs."""
    votes = points.where("node_id > 0").groupBy("node_id", "nbs_id").agg(F.count(F.lit(1)).alias("n"))
    won = votes.groupBy("node_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "nbs_id")).alias("w")).select(F.col("node_id").alias("_node"), F.col("w.nbs_id").alias("_won"))
    return points.join(won, F.col("node_id") == F.col("_node"), "left").select("pid", F.coalesce("_won", "nbs_id").alias("nbs_id"))


def merge_receivers(nodes: DataFrame, touching: DataFrame, volumes: DataFrame, threshold: float) -> DataFrame:
    """``donor, receiver, frac``: for each branch the larger neighbour (by volume, then smaller id) that touches most of its skeleton nodes,
    if that share reaches the threshold; ties to the larger volume, then the smaller id. ``touching`` is skeleton edges ``na, nb``."""
    owner = nodes.select("node_id", "nbs_id")
    arcs = touching.select("na", "nb").unionAll(touching.select(F.col("nb").alias("na"), F.col("na").alias("nb")))
    met = arcs.join(owner.toDF("na", "donor"), "na").join(owner.toDF("nb", "receiver"), "nb").where("donor <> receiver")
    count = met.groupBy("donor", "receiver").agg(F.countDistinct("na").alias("touch"))
    size = owner.groupBy(F.col("nbs_id").alias("donor")).agg(F.count(F.lit(1)).alias("total"))
    v = volumes.select("nbs_id", "volume")
    full = count.join(size, "donor").join(v.toDF("donor", "dv"), "donor").join(v.toDF("receiver", "rv"), "receiver")
    fit = full.where("rv > dv or (rv = dv and receiver < donor)").withColumn("frac", F.col("touch") / F.col("total")).where(F.col("frac") >= threshold)
    best = fit.groupBy("donor").agg(F.min(F.struct((-F.col("touch")).alias("t"), (-F.col("rv")).alias("v"), "receiver", "frac")).alias("b"))
    return best.select("donor", "b.receiver", "b.frac")


def merge_reason(overlap, node_complete, focal_complete, focal_points, threshold: float = 0.2, gate: float = 0.25, least: int = 20):
    """Why a node may not move to a focal branch, or ``ok``, as an expression; the gates are tried in order and the overlap must exceed its threshold."""
    low = F.when(~(overlap > threshold), "below_overlap_threshold").when(~(node_complete >= gate), "node_completeness_gate")
    return low.when(~(focal_complete >= gate), "focal_completeness_gate").when(~(focal_points >= least), "min_points_gate").otherwise("ok")
