"""Labels: connected components as ranked labels, relabelling by frequency, grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

#: Graphs of at most so many edges are solved by one task; larger ones by the distributed rounds.
LOCAL_EDGES = 500_000


def union_find(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of each one's component."""
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node, component`` of an edge table ``src, dst``; by one task where the edges are few, which gives the same result."""
    pairs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    if pairs.limit(local_edges + 1).count() > local_edges:
        return connected_components(pairs)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        node, component = union_find(frame["src"].to_numpy(), frame["dst"].to_numpy())
        return pd.DataFrame({"node": node, "component": component})

    return pairs.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda f: solve(f), "node long, component long")


def ranked(groups: DataFrame, key: str, min_size: int = 1) -> DataFrame:
    """``key, n`` to ``key, label``: 1 for the largest n, ties to the smaller key; 0 below ``min_size``. One row a group is sorted, not the points."""
    order = Window.orderBy(F.desc("n"), key)
    return groups.select(key, F.when(F.col("n") >= min_size, F.row_number().over(order)).otherwise(0).alias("label"))


def label_components(vertices: DataFrame, edges: DataFrame, min_size: int = 1) -> DataFrame:
    """``pid, label`` of all vertices; isolated ones are components of one."""
    return label_found(vertices.select("pid").join(components(edges), F.col("pid") == F.col("node"), "left").select("pid", F.coalesce("component", "pid").alias("component")), min_size)


def label_found(found: DataFrame, min_size: int = 1) -> DataFrame:
    """``pid, label`` of components that are known as ``pid, component``."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return found.join(ranked(sizes, "component", min_size), "component").select("pid", "label")


def subset_components(edges: DataFrame, subset: DataFrame, min_size: int = 1) -> DataFrame:
    """Components among the vertices of ``subset (pid)`` only."""
    inside = subset.select("pid").distinct()
    own = edges.join(inside.withColumnRenamed("pid", "src"), "src", "left_semi").join(inside.withColumnRenamed("pid", "dst"), "dst", "left_semi")
    return label_components(inside, own, min_size)


def relabel_by_occurrence(rows: DataFrame, column: str, out: str = "label", min_size: int = 1, positive_only: bool = False) -> DataFrame:
    """Values ranked by (count descending, value): 1 is the commonest; rarer than ``min_size`` (and, if asked, values <= 0) become 0."""
    counted = rows.where(F.col(column) > 0) if positive_only else rows
    sizes = counted.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(ranked(sizes, "_v", min_size).withColumnRenamed("label", out), F.col(column) == F.col("_v"), "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_v")


def group_by_label(rows: DataFrame, label: str, index: str = "pid") -> DataFrame:
    """``label, members`` of positive labels, members sorted."""
    return rows.where(F.col(label) > 0).groupBy(label).agg(F.array_sort(F.collect_list(index)).alias("members"))


def relabel_within_trees(rows: DataFrame, tree: str = "tree_id", branch: str = "nbs_id", out: str = "tree_nbs_id") -> DataFrame:
    """Branches numbered from 1 over all trees, by (tree, 0 last; points descending; branch); branches <= 0 become 0."""
    sizes = rows.where(F.col(branch) > 0).groupBy(F.col(tree).alias("_t"), F.col(branch).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.when(F.col("_t") > 0, 0).otherwise(1), "_t", F.desc("n"), "_b")
    numbered = sizes.select("_t", "_b", F.row_number().over(order).alias(out))
    return rows.drop(out).join(numbered, (F.col(tree) == F.col("_t")) & (F.col(branch) == F.col("_b")), "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_t", "_b")
