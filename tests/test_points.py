import math

import numpy as np
import pytest

from stemfield.operators import filters, geometry, graph, labels, neighbours, points


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows, 1)], "pid long, x double, y double, z double")


def pids(df):
    return sorted(r.pid for r in df.select("pid").collect())


def test_grid_zmin(spark):
    assert pids(filters.grid_zmin(cloud(spark, [(0.1, 0.1, 2), (0.2, 0.3, 1), (1.2, 0.2, 5), (1.4, 0.6, 4), (2.1, 2.1, 7)]), 1)) == [2, 4, 5]
    assert pids(filters.grid_zmin(cloud(spark, [(0.1, 0.1, 1), (0.2, 0.2, 1), (1.2, 1.2, 0.5)]), 1)) == [1, 3]


@pytest.mark.parametrize(("rows", "dz", "want"), [
    ([(0, 0, 0), (0.2, 0, 1), (2, 0, 1), (0, 0, 2), (2, 0, 2), (5, 5, -1)], 5.0, [1, 3, 6]),
    ([(0, 0, 1), (0, 0, 1)], 5.0, [1, 2]),
    ([(0, 0, 0), (10, 0, 20)], 5.0, [1, 2]),
    ([(0, 0, 0), (10, 0, 20)], 20.0, [1]),
    ([(0, 0, 0), (4.9, 0, 5), (0, 4.9, 5)], 5.0, [1]),
])
def test_cone(spark, rows, dz, want):
    assert pids(filters.upward_conic_filter(cloud(spark, rows), 45, dz)) == want


def test_subsample_matches_a_sequential_pass(spark):
    assert pids(filters.distance_subsample(cloud(spark, [(0, 0, 0), (0.01, 0, 0), (0.5, 0, 0), (0.51, 0, 0)]), 0.1)) == [1, 3]
    xyz = np.random.default_rng(3).uniform(0, 1, (300, 3))
    kept = []
    for i, p in enumerate(xyz, 1):
        if all(((p - xyz[j - 1]) ** 2).sum() >= 0.2**2 for j in kept):
            kept.append(i)
    assert pids(filters.distance_subsample(cloud(spark, xyz.tolist()), 0.2)) == kept


def test_first_kept_rounds_equal_one_pass(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "src long, dst long")
    vertices = spark.range(1, 61).withColumnRenamed("id", "pid")
    want = pids(filters.first_kept(vertices, edges))
    monkeypatch.setattr(filters, "LOCAL_EDGES", 5)
    monkeypatch.setattr(filters, "ROUNDS", 2)
    assert pids(filters.first_kept(vertices, edges)) == want == list(range(1, 61, 2))


def test_components(spark):
    rows = [(0, 0, 0), (0.1, 0, 0), (5, 5, 5), (5.2, 5, 5), (10, 0, 0)]
    for least, want in ((1, [1, 1, 2, 2, 3]), (2, [1, 1, 2, 2, 0]), (3, [0] * 5)):
        got = filters.connected_component_labels(cloud(spark, rows), 0.25, least)
        assert [r.label for r in got.orderBy("pid").collect()] == want
    ranked = filters.connected_component_labels(cloud(spark, [(x, 0, 0) for x in (0, 5, 5.1, 5.2, 10, 10.1)]), 0.15)
    assert [r.label for r in ranked.orderBy("pid").collect()] == [3, 1, 1, 1, 2, 2]


def test_distributed_components_equal_local_ones(spark):
    r = np.random.default_rng(5)
    edges = spark.createDataFrame(r.integers(0, 200, (150, 2)).tolist(), "src long, dst long")
    assert sorted(map(tuple, labels.components(edges).collect())) == sorted(map(tuple, labels.components(edges, local_edges=0).collect()))
    assert labels.components(edges.limit(0), local_edges=0).count() == 0


def test_relabel_and_group(spark):
    rows = spark.createDataFrame(list(enumerate([7, 4, 9, 7, 4, 7])), "pid long, v long")
    assert [r.label for r in labels.relabel_by_occurrence(rows, "v").orderBy("pid").collect()] == [1, 2, 3, 1, 2, 1]
    few = spark.createDataFrame(list(enumerate([1, 1, 2, 3, 3, 3])), "pid long, v long")
    assert [r.label for r in labels.relabel_by_occurrence(few, "v", min_size=2).orderBy("pid").collect()] == [2, 2, 0, 1, 1, 1]
    groups = labels.group_by_label(spark.createDataFrame([(10, 1), (20, 1), (30, 2), (40, 0)], "pid long, l long"), "l")
    assert sorted(r.members for r in groups.collect()) == [[10, 20], [30]]


def test_paths(spark):
    p = cloud(spark, [(x, 0, 0) for x in range(4)])
    edges = neighbours.radius_edges(p, 1.01)
    for most in (10**6, 0):
        got = graph.shortest_paths(p, edges, 1, local_edges=most)
        assert [r.distance for r in got.orderBy("pid").collect()] == [0, 1, 2, 3]
        assert [r.parent for r in got.orderBy("pid").collect()] == [None, 1, 2, 3]
    assert [r.slice for r in graph.slice_labels(got, 1.5).orderBy("pid").collect()] == [1, 1, 2, 3]
    far = cloud(spark, [(x, 0, 0) for x in (0, 1, 10)])
    got = graph.slice_labels(graph.shortest_paths(far, neighbours.radius_edges(far, 1.01), 1), 1.0)
    assert [r.slice for r in got.orderBy("pid").collect()] == [1, 2, 0]


def test_quotient(spark):
    p = cloud(spark, [(0, 0, 0), (2, 0, 0), (0, 1, 0), (10, 0, 0), (12, 0, 0)])
    lab = spark.createDataFrame(list(enumerate([10, 10, 20, 30, 30], 1)), "pid long, label long")
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, 4)], "src long, dst long")
    got = {(r.la, r.lb): (r.vx, r.vy, r.vz) for r in graph.quotient_graph(p, edges, lab)[1].collect()}
    assert got == {(10, 20): (-1.0, 1.0, 0.0), (20, 30): (10.0, -1.0, 0.0)}


def test_polygons(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert pids(filters.polygon_filter(cloud(spark, [(0.5, 0.5, 0), (2, 2, 0), (0.5, 0.5, 10), (-1, 0.5, 0)]), square)) == [1, 3]
    assert geometry.polygon_area(square) == 1 and geometry.polygon_area([(0, 0), (4, 0), (0, 3)]) == 6
    assert len(geometry.convex_hull(cloud(spark, [(*p, 0) for p in [*square, (0.5, 0.5)]]))) == 4


def test_idw(spark):
    known = cloud(spark, [(0, 0, 0), (2, 0, 10)])
    query = spark.createDataFrame([(1, 1.0, 0.0)], "pid long, x double, y double")
    assert geometry.interpolate_idw(known, query, 2).first().z == pytest.approx(5)
    far = spark.createDataFrame([(1, 10.0, 10.0)], "pid long, x double, y double")
    assert math.isnan(geometry.interpolate_idw(cloud(spark, [(0, 0, 42)]), far, max_distance=1).first().z)


def test_mesh(spark):
    r = np.random.default_rng(2).uniform(0, 1, (40, 2))
    corners = np.array([[0, 0], [1, 0], [0, 1], [1, 1]])
    xy = np.concatenate([corners, r])
    tri = geometry.triangulation(cloud(spark, np.column_stack([xy, xy.sum(1)]).tolist()))
    got = [x.dz for x in geometry.mesh_distance_z(cloud(spark, [(0.5, 0.25, 2.0), (0.25, 0.5, 0.0), (3, 3, 0)]), tri).orderBy("pid").collect()]
    assert got[:2] == pytest.approx([1.25, -0.75]) and math.isnan(got[2])


def test_statistical_filter_and_small_clouds(spark):
    xyz = np.random.default_rng(1).normal(0, 0.1, (80, 3)).tolist() + [(5, 5, 5)]
    assert 81 not in pids(filters.statistical_filter(cloud(spark, xyz), 6, 1.0))
    assert filters.statistical_filter(cloud(spark, xyz[:4]), 6).count() == 4


def test_arguments(spark):
    p = cloud(spark, [(0, 0, 0)])
    for call in (lambda: filters.grid_zmin(p, 0), lambda: points.scale(p, -1), lambda: neighbours.radius_edges(p, 0), lambda: geometry.buffer_polygon([(0, 0), (1, 0), (0, 1)], -1), lambda: points.merge([]), lambda: filters.in_polygon([(0, 0)])):
        with pytest.raises(ValueError):
            call()


def test_affine_composes(spark):
    a, b = points.Affine(points.rotation("x", 0.3), (1, 2, 3)), points.Affine(np.diag([2.0, 1, 1]))
    xyz = np.random.default_rng(0).normal(0, 1, (5, 3))
    assert np.allclose((a @ b).apply(xyz), a.apply(b.apply(xyz)))
    got = [(r.x, r.y, r.z) for r in (a @ b)(cloud(spark, xyz.tolist())).orderBy("pid").collect()]
    assert np.allclose(got, (a @ b).apply(xyz))
