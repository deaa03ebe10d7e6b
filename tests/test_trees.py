import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemfield.config import load_config
from stemfield.operators import growth, slices, trees
from stemfield.operators.geometry import frustum, lattice_inside


def test_circle_and_surface():
    a = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    assert slices.circle_fit(1 + 0.2 * np.cos(a), 2 + 0.2 * np.sin(a)) == pytest.approx((1, 2, 0.2))
    grid = slices.rho_surface(np.array([0.1, 0.2, 0.15, 0.25]), np.array([-3.0, -3.0, 3.0, 3.0]), np.zeros(4, int), 1, 4)
    assert grid[0, 0] == pytest.approx(0.15) and math.isnan(grid[1, 0]) and grid[3, 0] == pytest.approx(0.20)
    keep = slices.rho_keep(np.array([0.1, 0.1, 0.1, 0.5, 0.1, 0.1, 0.1]), np.array([0, 0, 0, 0, 1, 1, 1]), 0.75)
    assert keep.tolist() == [True, True, True, False, True, True, True]


def test_centreline():
    c = np.array([[i, 1.0, 0] for i in range(5)])
    valid = np.array([True, True, False, True, True])
    assert slices.centreline(np.where(valid[:, None], c, np.nan), valid, c, 0)[2] == pytest.approx([2, 1, 0])
    line = np.column_stack([np.arange(1.0, 11)] * 3)
    assert slices.centreline(line, np.ones(10, bool), line, 1)[[0, 4, 9], 0] == pytest.approx([1.5, 5, 9.5])


def test_cylinder_model():
    r = np.random.default_rng(1)
    a, cfg = r.uniform(0, 2 * np.pi, 2000), load_config(text="")
    xyz = np.column_stack([0.1 * np.cos(a), 0.1 * np.sin(a), r.uniform(0, 0.5, 2000)]) + r.normal(0, 0.001, (2000, 3))
    got = slices.model_segment(xyz, xyz[:, 2], cfg, True)
    assert got["nodes"] and all(abs(n["radius_area"] - 0.1) < 0.01 for n in got["nodes"]) and len(got["surface"])
    ball = r.normal(0, 1, (300, 3))
    assert slices.model_segment(ball, ball[:, 2], cfg) is None


def test_cylinder_volume():
    grid = lattice_inside(np.array([0, 0, 0, 0, 0, 1, 0.1, 0.25]), np.full(3, -0.3), np.full(3, 0.3), 0.01)
    assert grid.sum() * 1e-6 == pytest.approx(math.pi * 0.01 * 0.5, rel=0.03)


def test_frustum(spark):
    v, s = frustum(F.lit(0.1), F.lit(0.1), F.lit(0.5))
    row = spark.range(1).select(v.alias("v"), s.alias("s")).first()
    assert row.v == pytest.approx(math.pi * 0.01 * 0.5) and row.s == pytest.approx(2 * math.pi * 0.1 * 0.5)


def test_growth_follows_a_line_and_stops_at_a_mask():
    n = 10
    adj = growth.adjacency(n, np.arange(n - 1), np.arange(1, n))
    free = np.ones(n, bool)
    free[7] = False
    grown = growth.Segment(adj, free, [0], 1, np.column_stack([np.zeros(n), np.zeros(n), np.arange(n)]))
    assert grown.wave == {i: i + 1 for i in range(7)} and grown.rejected() == []
    with pytest.raises(ValueError):
        growth.Segment(adj, free, [7], 1)


def test_assembly_chain():
    """Three branches of four points in a row, the first near the ground: one tree."""
    nbs, node = np.repeat([1, 2, 3], 4), np.repeat(np.arange(1, 7), 2)
    tree, branch = growth.assemble(np.arange(11), np.arange(1, 12), nbs, node, np.arange(12) * 0.2, 0.4)
    assert set(tree) == {1} and sorted(set(branch)) == [1, 2, 3]
    tree, _ = growth.assemble(np.arange(11), np.arange(1, 12), nbs, node, np.arange(12) * 0.2 + 5, 0.4)
    assert set(tree) == {0}


def test_two_stems(spark):
    rows = [(x + 0.08 * math.cos(k * math.pi / 8), 0.08 * math.sin(k * math.pi / 8), i * 0.05) for x, n in ((0, 40), (1.5, 30)) for i in range(n) for k in range(16)]
    pdf = pd.DataFrame(rows, columns=list("xyz")).assign(pid=range(len(rows)))
    pdf["AGH"] = pdf["z"]
    cfg = load_config(text="")
    out, merges, moves = trees.tree_segmentation(spark.createDataFrame(pdf), cfg)
    sizes = {r.tree_id: r["count"] for r in out.groupBy("tree_id").count().collect()}
    assert set(sizes) == {1, 2} and sizes[1] > sizes[2] and not merges.count() and not moves.count()
    nodes, modelled, _ = trees.model_trees(out, cfg)
    assert nodes.count() > 5 and {r.node_id for r in modelled.select("node_id").collect()} > {1, 2}
    with pytest.raises(ValueError):
        trees.tree_segmentation(spark.createDataFrame(pdf.drop(columns="AGH")), cfg)


def test_occlusion(spark):
    cols = "pid long, x double, y double, z double, tree_id long, tree_nbs_id long"
    rows = [(1, 0.0, 0.0, 0.0, 1, 1), (2, 0.1, 0.0, 0.0, 0, 2), (3, 0.2, 0.0, 0.0, 0, 3), (4, 9.0, 0.0, 0.0, 0, 4)]
    cfg = load_config(text="")
    got = {r.pid: r.tree_id for r in trees.occluded_branches(spark.createDataFrame(rows, cols), cfg).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}
    off = load_config(text="[tree.assembly]\nocclusion_tolerance = 0.0\n")
    assert {r.pid: r.tree_id for r in trees.occluded_branches(spark.createDataFrame(rows, cols), off).collect()}[2] == 0
