"""Coordinates that are no numbers, and seeds of segments."""

import math

import numpy as np
import pytest

from stemfield.operators import filters, geometry, growth, neighbours, points


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "pid long, x double, y double, z double")


def test_knn_ends_with_coordinates_that_are_no_numbers(spark):
    rows = [(0, 0, 0), (1, 0, 0), (math.nan, 0, 0), (3, 0, 0), (math.inf, 1, 1), (0, -math.inf, 0), (1e9, 0, 0)]
    got = {(r.qid, r.rank): r.pid for r in neighbours.knn_join(cloud(spark, rows), cloud(spark, rows), 2, exclude_same=True).collect()}
    assert got == {(0, 1): 1, (0, 2): 3, (1, 1): 0, (1, 2): 3, (3, 1): 1, (3, 2): 0, (6, 1): 3, (6, 2): 1}
    kept = {r.pid for r in filters.statistical_filter(cloud(spark, rows), k=2).collect()}
    assert kept <= {0, 1, 3, 6} and kept >= {0, 1, 3}
    assert neighbours.knn_join(cloud(spark, [(math.nan, 0, 0)]), cloud(spark, rows), 2).count() == 0


def test_knn_equals_brute_force(spark):
    r = np.random.default_rng(1)
    xyz = np.round(np.concatenate([r.normal(0, 1, (150, 3)), r.normal(50, 0.01, (20, 3)), [[1e4, 0, 0]]]), 2)
    got = {(x.qid, x.rank): x.pid for x in neighbours.knn_join(cloud(spark, xyz), cloud(spark, xyz), 5).collect()}
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    assert got == {(i, n): j for i in range(len(xyz)) for n, j in enumerate(sorted(range(len(xyz)), key=lambda j: (d[i, j], j))[:5], 1)}


def test_ground_must_be_finite(spark):
    p = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (math.inf, 1, 0)])
    with pytest.raises(ValueError, match="finite"):
        geometry.aboveground_height(p, p, 0.5)


def test_an_attribute_needs_a_value_for_each_point(spark):
    p = cloud(spark, [(0, 0, 0), (1, 0, 0)])
    for values in ([(0, 5)], [(0, 5), (1, 6), (1, 7)]):
        with pytest.raises(ValueError, match="one value"):
            points.set_attribute(p, "m", spark.createDataFrame(values, "pid long, m int"))
    assert {(r.pid, r.m) for r in points.set_attribute(p, "m", spark.createDataFrame([(0, 5), (1, 6)], "pid long, m int")).collect()} == {(0, 5), (1, 6)}


class Scripted:
    """A search that takes and rejects given vertices."""

    script: dict = {}

    def __init__(self, adj, free, seeds, *rest):
        own, self.rim = self.script[tuple(seeds)]
        self.wave, self.number = {v: 1 for v in own if free[v]}, 1

    def rejected(self):
        return self.rim


def test_the_rim_of_a_small_segment_seeds_the_next(monkeypatch):
    """Vertex 0 is near the ground; the search from vertex 5 takes too few vertices and leaves 7 and 8 at its rim."""
    monkeypatch.setattr(growth, "Segment", Scripted)
    adj = [np.array([v for v in (i - 1, i + 1) if 0 <= v < 10]) for i in range(10)]
    xyz = np.array([[0, 0, z] for z in (0, 1, 2, 3, 4, 5, 6, 9, 8, 7)], float)
    agh = np.array([0] + [5] * 9, float)
    Scripted.script = {(0,): ([0, 1, 2, 3], [5]), (5,): ([5], [7, 8]), (8,): ([8, 9, 6], []), (7,): ([7], []), (4,): ([4], [])}
    segment, _ = growth.label_segments(adj, xyz, agh, 1.0, least=3)
    assert segment.tolist() == [1, 1, 1, 1, 0, 0, 2, 0, 2, 2]
