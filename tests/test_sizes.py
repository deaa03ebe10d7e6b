"""Results of the ways that hold no edge list, against the plain ways over edges."""

import math

import numpy as np
import pandas as pd
import pytest

from stemfield.operators import filters, geometry, graph, growth, labels, neighbours


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "pid long, x double, y double, z double")


def test_each_set_of_cylinders_is_measured_once(spark):
    """Two keys share a set; contained and endless cylinders change nothing; a key without a solid one has no volume."""
    a, b = (0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0.1, 0.0, 0.0, 1.0, 0.0, 0.0)
    rows = [(k, *a, r, h) for k in (1, 2) for r, h in ((0.2, 0.1), (0.1, 0.3), (0.1, 0.1), (math.inf, 1.0), (0.2, 0.1))] + [(k, *b, 0.05, 0.4) for k in (1, 2)] + [(3, *a, 0.0, 1.0)]
    got = {r.nbs_id: r.volume for r in geometry.voxel_volume(spark.createDataFrame(rows, "nbs_id long, cx double, cy double, cz double, dx double, dy double, dz double, radius double, half double"), 0.02).collect()}
    solid = np.array([(*a, 0.2, 0.1), (*a, 0.1, 0.3), (*b, 0.05, 0.4)])
    want = geometry.lattice_inside(solid, *geometry.cylinder_box(solid), 0.02).sum() * 0.02**3
    assert got == pytest.approx({1: want, 2: want, 3: 0.0}) and geometry.lattice_volume(solid, 0.02, most=50) == pytest.approx(want)


def clumps(n=400, seed=3):
    """Dense and thin parts, points on cell borders, two alike and a far one."""
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(0, 0.12, (n, 3)), r.normal(0.8, 0.3, (n // 2, 3)), np.array([[i * 0.08, 2, 2] for i in range(30)]), [[5, 5, 5], [5, 5, 5], [-40, 3, 9]]])


def plain_components(xyz, radius):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)) <= radius
    node, root = labels.union_find(*np.nonzero(d))
    return dict(zip(node.tolist(), root.tolist(), strict=True))


def test_components_by_tiles(spark, monkeypatch):
    """Small tiles, without a list of edges; a point that is nowhere stays alone."""
    from stemfield.operators import tiles

    xyz = clumps()
    want = plain_components(xyz, 0.08)
    monkeypatch.setattr(tiles, "tile_width", lambda *_: 6)
    monkeypatch.setattr(neighbours, "radius_edges", lambda *a, **b: pytest.fail("edges were listed"))
    got = {r.pid: r.component for r in tiles.radius_components(cloud(spark, np.concatenate([xyz, [[math.nan, 0, 0]]])), 0.08).collect()}
    assert got == want | {len(xyz): len(xyz)}


def test_paths_by_tiles(spark, monkeypatch):
    from stemfield.operators import tiles

    xyz = clumps()
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    src, dst = np.nonzero((d <= 0.08) & (np.arange(len(xyz))[:, None] < np.arange(len(xyz))[None]))
    want, _ = graph.dijkstra(len(xyz), src, dst, d[src, dst], 0)
    monkeypatch.setattr(tiles, "tile_width", lambda *_: 6)
    got = tiles.radius_paths(cloud(spark, xyz), 0.08, 0).collect()
    assert np.array([r.distance for r in sorted(got)]) == pytest.approx(want, abs=1e-9)
    for r in got:
        assert (r.parent is None) == (r.pid == 0 or math.isinf(r.distance))
        assert r.parent is None or want[r.parent] + d[r.parent, r.pid] == pytest.approx(r.distance, abs=1e-9)


def test_cones_over_a_small_area_list_no_pairs(spark, monkeypatch):
    """Against the walk in ascending pid, and against the way by pairs."""
    xyz = np.concatenate([np.round(clumps(150)[:-1], 2), [[0.1, 0.2, -3.0]]])
    p = cloud(spark, xyz)
    dz = xyz[None, :, 2] - xyz[:, None, 2]
    cone = (dz > 0) & (np.sqrt(((xyz[:, None, :2] - xyz[None, :, :2]) ** 2).sum(2)) <= dz * math.tan(math.radians(10)))
    gone, anchors = np.zeros(len(xyz), bool), []
    for i in range(len(xyz)):
        if not gone[i]:
            anchors.append(i)
            gone |= cone[i]
    monkeypatch.setattr(filters, "cone_pairs", lambda *_: pytest.fail("pairs were listed"))
    got = {r.pid for r in filters.upward_conic_filter(p, 10.0, 50.0).collect()}
    assert got == {i for i in anchors if not gone[i]} and len(got) > 3


def test_subsampling_in_turns(spark, monkeypatch):
    """Few points a turn, with and without the rest by pairs, against the walk in ascending pid."""
    xyz = clumps(300)
    want: list[int] = []
    for i in range(len(xyz)):
        if not want or (((xyz[want] - xyz[i]) ** 2).sum(1) >= 0.1 * 0.1).all():
            want.append(i)
    p = cloud(spark, np.concatenate([xyz, [[math.nan, 0, 0]]]))
    for first in (60, 10_000):
        monkeypatch.setattr(filters, "FIRST", first)
        assert sorted(r.pid for r in filters.distance_subsample(p, 0.1).collect()) == [*want, len(xyz)]
    monkeypatch.setattr(filters, "FIRST", 10_000)
    monkeypatch.setattr(filters, "radius_edges", lambda *a, **b: pytest.fail("edges were listed"))
    assert filters.distance_subsample(p, 0.1).count() == len(want) + 1


def test_medians_and_paths_without_edges(spark):
    """Equal to the ways over edges and to numpy; the path is that of ``linear_path``."""
    xyz = clumps()
    p = cloud(spark, xyz)
    named = p.select("pid", (p.pid % 4).alias("label"))
    edges = neighbours.radius_edges(p, 0.15)
    rows = [(int(e.src), int(e.dst)) for e in edges.select("src", "dst").collect()]
    want: dict = {}
    for a, b in rows:
        a, b = (a, b) if a % 4 < b % 4 else (b, a)
        if a % 4 and a % 4 != b % 4:
            want.setdefault((a % 4, b % 4), []).append(xyz[b] - xyz[a])
    for got in (graph.radius_quotient(p, 0.15, named)[1], graph.quotient_graph(p, edges, named)[1]):
        found = {(r.la, r.lb): (r.vx, r.vy, r.vz) for r in got.collect()}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(np.median(want[k], axis=0), abs=1e-12) for k in want)
    got = [r.pid for r in sorted(graph.radius_linear_path(p, 0.15, 0).collect())]
    assert got == graph.linear_path(np.arange(len(xyz)), xyz, np.array(rows), 0) and len(got) > 2
    assert [r.pid for r in graph.radius_linear_path(p, 0.01, 4).collect()] == [4] and graph.radius_linear_path(p, 0.1, -1).count() == 0


def test_segments_and_trees_without_edges():
    """A grid gives the segments that lists of neighbours give; pairs in pieces give the trees of all pairs at once; empty sets have no pairs."""
    xyz = clumps()
    src, dst = np.nonzero((np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)) <= 0.1) & (np.arange(len(xyz))[:, None] < np.arange(len(xyz))[None]))
    adj, grid = growth.adjacency(len(xyz), src, dst), growth.Grid(xyz, 0.1)
    agh = xyz[:, 2] + 0.5
    want, got = (growth.label_segments(a, xyz, agh, 0.3) for a in (adj, grid))
    assert want[0].max() > 1 and all((a == b).all() for a, b in zip(want, got, strict=True))
    whole, pieces = growth.assemble(src, dst, *want, agh, 0.3), growth.assemble_pairs(grid.pairs(), *want, agh, 0.3)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    assert len(growth.radius_pairs(np.zeros((0, 3)), 1.0)[0]) == 0 and len(growth.radius_pairs(xyz, 0.1)[0]) == len(src)


def test_triangulation_by_walks(monkeypatch):
    """The triangles of the scan, also where circles hold more than three points; many points without a scan."""
    r = np.random.default_rng(5)
    turns = np.linspace(0, 6.2, 40)
    grid = np.array([(i, j) for i in range(9) for j in range(7)], float)
    sets = [r.normal(0, 1, (400, 2)), grid, np.round(r.normal(0, 1, (300, 2)), 1), np.column_stack([np.cos(turns), np.sin(turns)]), r.normal(0, 1, (3, 2)), np.array([[i, 2 * i] for i in range(9)], float)]
    want = [geometry.delaunay_scan(p).tolist() for p in sets]
    monkeypatch.setattr(geometry, "delaunay_scan", lambda _: pytest.fail("all triangles were tried"))
    assert [sorted(geometry.delaunay(p).tolist()) for p in sets] == [sorted(w) for w in want]
    assert len(geometry.delaunay(r.normal(0, 1, (6000, 2)))) > 11_900
