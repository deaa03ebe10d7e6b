"""Connected components of an edge table by hooking, pointer jumping and contraction.

Each round gives every vertex its smallest neighbour as parent, jumps the parents to the roots of that
forest, and contracts the edges onto the roots. The number of rounds is logarithmic; every table of a round is
written to the shared folder, so no plan grows with the rounds and a lost executor costs one step only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_table


def _lookup(edges: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace ``column`` by its parent. ``parents`` has one row a vertex, so a hot vertex skews one side only,
    and both sides are plain shuffles, which adaptive execution can split."""
    side = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    return edges.join(side, edges[column] == side["_node"], "left").withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every vertex of an edge; component is the smallest vertex reachable.

    Edges have no direction; loops only name a vertex, repeated edges and nulls in either end have no effect.
    An empty table gives an empty result.
    """
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    loops = ends.where("u = v").select(F.col("u").alias("node")).distinct()
    live = persist_table(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels = None
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = persist_table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("parent")), "cc-parents")
        while True:
            jumped = persist_table(_lookup(parents.withColumn("was", F.col("parent")), "parent", parents), "cc-jump")
            moved = not jumped.where("parent <> was").isEmpty()
            parents = jumped.drop("was")
            if not moved:
                break
        labels = parents if labels is None else persist_table(_lookup(labels, "parent", parents), "cc-labels")
        onto = _lookup(_lookup(live, "u", parents), "v", parents)
        live = persist_table(onto.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    found = loops.sparkSession.createDataFrame([], "node long, component long") if labels is None else labels.select("node", F.col("parent").alias("component"))
    return found.unionAll(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
