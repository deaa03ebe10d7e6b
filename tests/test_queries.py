"""Registered queries against their SQL on the smallest tables, where those are at hand."""

import glob
import os

import duckdb
import pytest

from stemfield.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["grid_zmin", "rotate_z", "polygon_filter", "radius_graph", "statistical_filter", "connected_component_labels", "shortest_paths", "aboveground_height", "tree_table", "snap_plurality", "subset_components", "induced_graph", "interpolate_idw", "distance_subsample", "proto_nodes", "segment_ground", "pca_linearity", "las_limits"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = q.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({q.SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, v) for v in r)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, sorted(want, key=key), strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def connection():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_boxes_of_the_whole_table(spark):
    """Against brute force and the SQL."""
    con = connection()
    got = {(r.a, r.b) for r in q.QUERIES["aabbs_overlap"](spark, SF).collect()}
    rows = con.execute(f"WITH {q.EMB_SQL} SELECT pid, x, y, z FROM emb").fetchall()
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and all(abs(u - v) <= 0.1 for u, v in zip(a[1:], b[1:], strict=True))}
    assert got == set(con.execute(f"SELECT a, b FROM ({q.SQL['aabbs_overlap']})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_volumes_of_all_groups(spark):
    """Against brute force and the SQL: upright cylinders about one axis, so the widest counts."""
    con = connection()
    got = {r.nbs_id: r.volume for r in q.QUERIES["cylinder_volume"](spark, SF).collect()}
    at = [(k + 0.5) * 0.01 for k in range(-40, 40)]
    count = lambda radius: sum(abs(z) <= 0.075 for z in at) * sum(x * x + y * y <= radius * radius for x in at for y in at)
    widest = con.execute(f"WITH {q.NODE_SQL} SELECT nbs_id, max(radius)::DOUBLE FROM node GROUP BY nbs_id").fetchall()
    volume = {radius: count(radius) * 1e-6 for radius in {r for _, r in widest}}
    assert len(got) == len(widest) > 3
    assert got == pytest.approx({k: volume[r] for k, r in widest}, abs=2e-6)
    assert got == pytest.approx(dict(con.execute(f"SELECT nbs_id, volume FROM ({q.SQL['cylinder_volume']})").fetchall()), abs=2e-6)
