"""Registered queries of the point-cloud operators and their SQL, over views of the driver's tables.

P_emb: embeddings as points (first three components). P_evt: events as points. N_node: rows like fitted nodes, from lineitem. Ground of P_emb:
its lowest points by cell. Doubles are rounded on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load_config
from ..operators import biometrics as bio
from ..operators import filters as flt
from ..operators import geometry as geo
from ..operators import graph as gr
from ..operators import labels as lab
from ..operators import neighbours as nb
from ..operators import points as pts
from ..operators import tiles, trees, unroll
from ..session import new_path
from ..sources import files

R = 0.08
QUERIES: dict = {}
SQL: dict[str, str] = {}

EMB_SQL = "emb AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"
EVT_SQL = "evt AS (SELECT event_id AS pid, user_id / 10.0::DOUBLE AS x, (date_diff('second', TIMESTAMP '1970-01-01', ts) % 3600) / 360.0::DOUBLE AS y, value / 50.0::DOUBLE AS z FROM events)"
NODE_SQL = "node AS (SELECT l_partkey + 1 AS nbs_id, (l_partkey + 1) * 100 + l_quantity::INT AS node_id, l_partkey % 100 + 1 AS tree_id, l_quantity AS agh, 0.05 + max(l_discount) AS radius, count(*) AS n_points, 0.15::DOUBLE AS h FROM lineitem GROUP BY l_partkey, l_quantity)"
EDGE_SQL = f"edge AS (SELECT a.pid AS src, b.pid AS dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS w FROM emb a JOIN emb b ON a.pid < b.pid WHERE w <= {R})"
#: lowest points of P_emb by cell, as ``ground``
LOW_SQL = "low AS (SELECT *, row_number() OVER (PARTITION BY floor(x * 16.0), floor(y * 16.0) ORDER BY z, pid) AS nth FROM emb), ground AS (SELECT pid, x, y, z FROM low WHERE nth = 1)"
#: components by smallest label, over ``edge``
CC_SQL = "both_ways AS (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge), reach(pid, root) AS (SELECT pid, pid FROM emb UNION SELECT b.dst, r.root FROM reach r JOIN both_ways b ON b.src = r.pid WHERE r.root < b.dst), comp AS (SELECT pid, min(root) AS component FROM reach GROUP BY pid)"


def emb(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return v.select(F.col("vec_id").alias("pid"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), "label")


def evt(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/events.parquet")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return v.select(F.col("event_id").alias("pid"), (F.col("user_id") / F.lit(10.0)).alias("x"), (seconds % 3600 / F.lit(360.0)).alias("y"), (F.col("value") / F.lit(50.0)).alias("z"))


def node(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_partkey", "l_quantity").agg(F.max("l_discount").alias("m"), F.count(F.lit(1)).alias("n_points"))
    nbs = F.col("l_partkey") + 1
    return v.select(nbs.alias("nbs_id"), (nbs * 100 + F.col("l_quantity").cast("int")).alias("node_id"), (F.col("l_partkey") % 100 + 1).alias("tree_id"), F.col("l_quantity").alias("agh"), (F.col("m") + F.lit(0.05)).alias("radius"), "n_points", F.lit(0.15).alias("h"))


def ground(points: DataFrame) -> DataFrame:
    return flt.grid_zmin(points, 0.0625)


def walk_sql(rows: str, pairs: str) -> str:
    """``kept(pid)``: in ascending pid, the rows that no kept row of ``pairs`` (src, dst; src < dst) precedes."""
    return f"""prior AS MATERIALIZED (SELECT {rows}.pid, row_number() OVER (ORDER BY {rows}.pid) AS i, coalesce(srcs, []) AS srcs FROM {rows} LEFT JOIN (SELECT dst, list(src) AS srcs FROM {pairs} GROUP BY dst) ON pid = dst),
walk(i, chosen) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT p.i, CASE WHEN list_has_any(chosen, p.srcs) THEN chosen ELSE list_append(chosen, p.pid) END FROM walk JOIN prior p ON p.i = walk.i + 1),
kept AS (SELECT unnest(chosen) AS pid FROM (SELECT chosen FROM walk ORDER BY i DESC LIMIT 1))"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null."""
    return df.select(*[F.round(F.nanvl(c, F.lit(None).cast("double")), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def ro(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, {places}) AS {c.split(' AS ')[-1]}" for c in cols)


@query("grid_zmin", f"WITH {EVT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY floor(x * 2.0), floor(y * 2.0) ORDER BY z, pid) AS n FROM evt) SELECT pid, {ro('x', 'y', 'z')} FROM r WHERE n = 1")
def _(s, d):
    return rounded(flt.grid_zmin(evt(s, d), 0.5))


@query("bounds", f"WITH {EVT_SQL} SELECT {ro('min(x) AS xmin', 'max(x) AS xmax', 'min(y) AS ymin', 'max(y) AS ymax', 'min(z) AS zmin', 'max(z) AS zmax')} FROM evt")
def _(s, d):
    return rounded(pts.bounds(evt(s, d)))


@query("center", f"WITH {EVT_SQL} SELECT {ro('avg(x) AS x', 'avg(y) AS y', 'avg(z) AS z')} FROM evt")
def _(s, d):
    return rounded(pts.center(evt(s, d)))


@query("translate", f"WITH {EVT_SQL} SELECT pid, {ro('x + 1.5 AS x', 'y - 2 AS y', 'z + 0.25 AS z')} FROM evt")
def _(s, d):
    return rounded(pts.translate(evt(s, d), 1.5, -2, 0.25))


@query("scale", f"WITH {EVT_SQL} SELECT pid, {ro('x * 2 AS x', 'y * 0.5 AS y', 'z * 3 AS z')} FROM evt")
def _(s, d):
    return rounded(pts.scale(evt(s, d), 2, 0.5, 3))


@query("rotate_z", f"WITH {EVT_SQL} SELECT pid, {ro('x * cos(0.5) - y * sin(0.5) AS x', 'x * sin(0.5) + y * cos(0.5) AS y', 'z')} FROM evt")
def _(s, d):
    return rounded(pts.rotate(evt(s, d), "z", 0.5))


@query("rotate_axis_angle", f"WITH {EVT_SQL} SELECT pid, {ro('z AS x', 'x AS y', 'y AS z')} FROM evt")
def _(s, d):
    return rounded(pts.rotate(evt(s, d), (1, 1, 1), 2 * math.pi / 3))


@query("affine", f"WITH {EVT_SQL} SELECT pid, {ro('2 * (y + 1) AS x', '2 * (z - 1) AS y', '2 * x AS z')} FROM evt")
def _(s, d):
    return rounded(pts.transform(evt(s, d), pts.Affine([[2, 0, 0], [0, 2, 0], [0, 0, 2]]) @ pts.Affine([[0, 1, 0], [0, 0, 1], [1, 0, 0]], (1, -1, 0))))


@query("transform_callable", f"WITH {EVT_SQL} SELECT pid, {ro('x * x AS x', 'y', 'z + x AS z')} FROM evt")
def _(s, d):
    import numpy as np

    return rounded(pts.transform(evt(s, d), lambda a: np.column_stack([a[:, 0] ** 2, a[:, 1], a[:, 2] + a[:, 0]])))


@query("center_at_origin", f"WITH {EVT_SQL} SELECT pid, {ro('x - (SELECT avg(x) FROM evt) AS x', 'y - (SELECT avg(y) FROM evt) AS y', 'z - (SELECT avg(z) FROM evt) AS z')} FROM evt")
def _(s, d):
    return rounded(pts.center_at_origin(evt(s, d)))


@query("bbox_crop", f"WITH {EVT_SQL} SELECT pid, {ro('x', 'y', 'z')} FROM evt WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 8 AND z BETWEEN 0 AND 1")
def _(s, d):
    return rounded(pts.bounding_box_crop(evt(s, d), (1, 2, 0), (5, 8, 1)))


@query("npoints", f"WITH {EVT_SQL} SELECT count(*) AS n FROM evt")
def _(s, d):
    return evt(s, d).agg(F.count(F.lit(1)).alias("n"))


@query("attribute_add_drop", f"WITH {EMB_SQL} SELECT pid, {ro('x', 'y', 'z')}, label * 2 AS twice FROM emb")
def _(s, d):
    return rounded(pts.delete_attribute(pts.set_attribute(emb(s, d), "twice", F.col("label") * 2), "label"))


@query("attribute_join", f"WITH {EMB_SQL} SELECT pid, {ro('x', 'y', 'z')}, label, pid % 7 AS m FROM emb")
def _(s, d):
    p = emb(s, d)
    return rounded(pts.set_attribute(p, "m", p.select("pid", (F.col("pid") % 7).alias("m"))))


@query("merge_common_attributes", f"WITH {EMB_SQL} SELECT pid, {ro('x', 'y', 'z')} FROM emb UNION ALL SELECT pid + 1099511627776, {ro('x', 'y', 'z')} FROM emb WHERE label = 1")
def _(s, d):
    p = emb(s, d)
    return rounded(pts.merge([p, p.where("label = 1").drop("label")]))


@query("gather", f"WITH {EMB_SQL} SELECT i.o AS pid, {ro('x', 'y', 'z')}, label FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 40)) i(o, p) JOIN emb ON emb.pid = i.p")
def _(s, d):
    return rounded(pts.gather(emb(s, d), s.createDataFrame([(0, 5), (1, 3), (2, 5), (3, 40)], "ord long, pid long")).withColumn("pid", F.col("pid").cast("int")))


POLY = [(1.0, 1.0), (8.0, 2.0), (6.0, 9.0), (4.0, 4.0), (2.0, 8.0)]
_crossing = " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < {bx - ax} * (y - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(POLY, [*POLY[1:], POLY[0]], strict=True))


@query("polygon_filter", f"WITH {EVT_SQL} SELECT pid, {ro('x', 'y', 'z')} FROM evt WHERE ({_crossing}) % 2 = 1")
def _(s, d):
    return rounded(flt.polygon_filter(evt(s, d), POLY))


@query("polygon_area", "SELECT round(abs(" + " + ".join(f"({ax} * {by} - {bx} * {ay})" for (ax, ay), (bx, by) in zip(POLY, [*POLY[1:], POLY[0]], strict=True)) + ")::DOUBLE / 2, 6) AS area")
def _(s, d):
    return rounded(s.createDataFrame([(geo.polygon_area(POLY),)], "area double"))


@query("convex_hull", f"WITH {EMB_SQL}, p AS (SELECT DISTINCT x, y FROM emb), side AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON (a.x, a.y) <> (b.x, b.y)), rim AS (SELECT ax, ay FROM side s WHERE NOT EXISTS (SELECT 1 FROM p WHERE (bx - ax) * (p.y - ay) - (b_y - ay) * (p.x - ax) < 0)) SELECT DISTINCT {ro('ax AS x', 'ay AS y')} FROM rim")
def _(s, d):
    return rounded(s.createDataFrame(geo.convex_hull(emb(s, d)), "x double, y double"))


@query("buffer_polygon", "SELECT * FROM (VALUES (-0.5::DOUBLE, -0.5::DOUBLE), (1.5, -0.5), (1.5, 1.5), (-0.5, 1.5)) t(x, y)")
def _(s, d):
    return rounded(s.createDataFrame(geo.buffer_polygon([(0, 0), (1, 0), (1, 1), (0, 1)], 0.5), "x double, y double"))


@query("radius_graph", f"WITH {EMB_SQL}, {EDGE_SQL} SELECT src, dst, {ro('w')} FROM edge")
def _(s, d):
    return rounded(nb.radius_edges(emb(s, d), R))


@query("neighbour_counts", f"WITH {EMB_SQL}, {EDGE_SQL} SELECT pid, count(e.src) AS n_neighbours FROM emb LEFT JOIN edge e ON pid = e.src OR pid = e.dst GROUP BY pid")
def _(s, d):
    return nb.neighbour_counts(emb(s, d), R)


_KNN = "knn AS (SELECT a.pid AS qid, b.pid, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY d2, b.pid) AS r FROM emb a JOIN emb b ON a.pid <> b.pid)"


@query("knn_join", f"WITH {EMB_SQL}, {_KNN} SELECT qid, pid, r::INT AS rank, {ro('d2')} FROM knn WHERE r <= 6")
def _(s, d):
    p = emb(s, d)
    return rounded(nb.knn_join(p, p, 6, exclude_same=True))


@query("knn_mean_distance", f"WITH {EMB_SQL}, {_KNN} SELECT qid AS pid, {ro('avg(sqrt(d2)) AS mean_d')} FROM knn WHERE r <= 6 GROUP BY qid")
def _(s, d):
    return rounded(flt.mean_neighbour_distance(emb(s, d), 6))


@query("statistical_filter", f"WITH {EMB_SQL}, {_KNN}, m AS (SELECT qid, avg(sqrt(d2)) AS d FROM knn WHERE r <= 6 GROUP BY qid) SELECT qid AS pid FROM m WHERE d <= (SELECT avg(d) + stddev_samp(d) FROM m)")
def _(s, d):
    return flt.statistical_filter(emb(s, d)).select("pid")


@query("upward_conic", f"WITH {EMB_SQL} SELECT pid FROM emb h WHERE NOT EXISTS (SELECT 1 FROM emb l WHERE h.z > l.z AND sqrt((h.x-l.x)*(h.x-l.x)+(h.y-l.y)*(h.y-l.y)) <= (h.z - l.z) * tan(radians(60)))")
def _(s, d):
    return flt.upward_conic_filter(emb(s, d), 60.0).select("pid")


@query("distance_subsample", f"WITH RECURSIVE {EMB_SQL}, {EDGE_SQL}, near AS (SELECT src, dst FROM edge WHERE w < {R}), {walk_sql('emb', 'near')} SELECT pid FROM kept")
def _(s, d):
    return flt.distance_subsample(emb(s, d), R).select("pid")


def _ranked(name: str, least: int = 1) -> str:
    return f"size AS (SELECT component, count(*) AS n FROM {name} GROUP BY component), rank AS (SELECT component, n, row_number() OVER (ORDER BY n DESC, component) AS r FROM size) SELECT pid, CASE WHEN n >= {least} THEN r ELSE 0 END::INT AS label FROM {name} JOIN rank USING (component)"


@query("connected_component_labels", f"WITH RECURSIVE {EMB_SQL}, {EDGE_SQL}, {CC_SQL}, {_ranked('comp', 2)}")
def _(s, d):
    return flt.connected_component_labels(emb(s, d), R, 2)


@query("subset_components", f"WITH RECURSIVE {EMB_SQL.replace('emb AS', 'every AS')}, emb AS (SELECT * FROM every WHERE label < 5), {EDGE_SQL}, {CC_SQL}, {_ranked('comp')}")
def _(s, d):
    p = emb(s, d)
    return flt.connected_component_labels(p.where("label < 5"), R)


@query("graph_components", f"WITH RECURSIVE {EMB_SQL}, {EDGE_SQL}, {CC_SQL}, {_ranked('comp')}")
def _(s, d):
    p = emb(s, d)
    return lab.label_found(tiles.radius_components(p, R))


@query("induced_graph", f"WITH {EMB_SQL}, {EDGE_SQL} SELECT src, dst, {ro('w')} FROM edge JOIN emb a ON a.pid = src JOIN emb b ON b.pid = dst WHERE a.label < 5 AND b.label < 5")
def _(s, d):
    p = emb(s, d)
    return rounded(gr.induced(nb.radius_edges(p, R), p.where("label < 5")))


_VOX = "vox AS (SELECT floor(x * 10.0) AS cx, floor(y * 10.0) AS cy, floor(z * 10.0) AS cz, count(*) AS n, min(pid) AS pid FROM p GROUP BY ALL), edge AS (SELECT a.pid AS src, b.pid AS dst FROM vox a JOIN vox b ON a.pid <> b.pid AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1), reach(pid, root) AS (SELECT pid, pid FROM vox UNION SELECT e.dst, r.root FROM reach r JOIN edge e ON e.src = r.pid WHERE r.root < e.dst), comp AS (SELECT pid, min(root) AS component FROM reach GROUP BY pid), big AS (SELECT component FROM comp JOIN vox USING (pid) GROUP BY component HAVING sum(n) >= 50)"


@query("voxel_component_filter", f"WITH RECURSIVE {EMB_SQL.replace('emb AS', 'p AS')}, {_VOX} SELECT p.pid FROM p JOIN vox v ON floor(p.x * 10.0) = cx AND floor(p.y * 10.0) = cy AND floor(p.z * 10.0) = cz JOIN comp c ON c.pid = v.pid WHERE component IN (SELECT component FROM big)")
def _(s, d):
    return flt.voxel_component_filter(emb(s, d), 0.1, 50).select("pid")


_PATH = f"WITH RECURSIVE {EMB_SQL}, {EDGE_SQL}, arc AS (SELECT src, dst, w FROM edge UNION ALL SELECT dst, src, w FROM edge), path(pid, dist) USING KEY (pid) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT a.dst, min(p.dist + a.w) FROM path p JOIN arc a ON a.src = p.pid LEFT JOIN recurring.path r ON r.pid = a.dst WHERE r.dist IS NULL OR p.dist + a.w < r.dist - 1e-12 GROUP BY a.dst)"


@query("shortest_paths", f"{_PATH} SELECT pid, {ro('dist AS distance')} FROM path")
def _(s, d):
    p = emb(s, d)
    return rounded(tiles.radius_paths(p, R, 0).where("distance < double('infinity')").select("pid", "distance"))


@query("slice_labels", f"{_PATH} SELECT emb.pid, coalesce(floor(dist / 0.1) + 1, 0)::INT AS slice FROM emb LEFT JOIN path ON emb.pid = path.pid")
def _(s, d):
    p = emb(s, d)
    return gr.slice_labels(tiles.radius_paths(p, R, 0), 0.1)


_PROTO = f"""{_PATH}, sliced AS (SELECT emb.pid, floor(dist / 0.1) + 1 AS slice FROM emb JOIN path ON emb.pid = path.pid),
same AS (SELECT src, dst FROM edge JOIN sliced a ON a.pid = src JOIN sliced b ON b.pid = dst WHERE a.slice % 2 = b.slice % 2), ways AS (SELECT src, dst FROM same UNION ALL SELECT dst, src FROM same),
reach(pid, root) AS (SELECT pid, pid FROM sliced UNION SELECT w.dst, r.root FROM reach r JOIN ways w ON w.src = r.pid WHERE r.root < w.dst), comp AS (SELECT pid, min(root) AS component FROM reach GROUP BY pid),
nth AS (SELECT component, slice, pid, row_number() OVER (PARTITION BY component ORDER BY slice, pid) AS k FROM comp JOIN sliced USING (pid)), num AS (SELECT component, row_number() OVER (ORDER BY slice, pid) AS proto FROM nth WHERE k = 1)
SELECT emb.pid, coalesce(proto, 0)::INT AS proto FROM emb LEFT JOIN comp ON comp.pid = emb.pid LEFT JOIN num USING (component)"""


@query("proto_nodes", _PROTO)
def _(s, d):
    p = emb(s, d)
    return gr.proto_nodes(p, gr.slice_labels(tiles.radius_paths(p, R, 0), 0.1), R)


@query("longest_linear_path")
def _(s, d):
    p = emb(s, d)
    return rounded(gr.radius_linear_path(p, R, 0))


@query("quotient_graph", f"WITH {EMB_SQL}, {EDGE_SQL}, v AS (SELECT least(a.label, b.label) AS la, greatest(a.label, b.label) AS lb, CASE WHEN a.label < b.label THEN 1 ELSE -1 END AS sg, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM edge JOIN emb a ON a.pid = src JOIN emb b ON b.pid = dst WHERE a.label <> b.label AND a.label > 0 AND b.label > 0) SELECT la, lb, {ro('median(sg * x) AS vx', 'median(sg * y) AS vy', 'median(sg * z) AS vz')} FROM v GROUP BY la, lb")
def _(s, d):
    p = emb(s, d)
    return rounded(gr.radius_quotient(p, R, p)[1])


@query("quotient_nodes", f"WITH {EMB_SQL} SELECT label, {ro('avg(x) AS x', 'avg(y) AS y', 'avg(z) AS z')}, count(*) AS n FROM emb WHERE label > 0 GROUP BY label")
def _(s, d):
    p = emb(s, d)
    return rounded(gr.radius_quotient(p, R, p)[0])


@query("relabel_by_occurrence", "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_partkey, CASE WHEN n >= 20 THEN row_number() OVER (ORDER BY n DESC, l_partkey) ELSE 0 END AS label FROM c) SELECT l_orderkey, l_linenumber, l_partkey, label::INT AS label FROM lineitem JOIN r USING (l_partkey)")
def _(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    return lab.relabel_by_occurrence(rows, "l_partkey", min_size=20)


@query("group_by_label", f"WITH {EMB_SQL} SELECT label, count(*) AS n, min(pid) AS first, max(pid) AS last FROM emb WHERE label > 0 GROUP BY label")
def _(s, d):
    g = lab.group_by_label(emb(s, d), "label")
    return g.select("label", F.size("members").cast("long").alias("n"), F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last"))


@query("relabel_within_trees", f"WITH {NODE_SQL}, c AS (SELECT tree_id, nbs_id, count(*) AS n FROM node GROUP BY 1, 2), r AS (SELECT tree_id, nbs_id, row_number() OVER (ORDER BY tree_id, n DESC, nbs_id) AS k FROM c) SELECT node_id, k::INT AS tree_nbs_id FROM node JOIN r USING (tree_id, nbs_id)")
def _(s, d):
    return lab.relabel_within_trees(node(s, d)).select("node_id", "tree_nbs_id")


_IDW = "near AS (SELECT q.pid AS qid, k.z, sqrt((q.x-k.x)*(q.x-k.x)+(q.y-k.y)*(q.y-k.y)) AS dist, row_number() OVER (PARTITION BY q.pid ORDER BY (q.x-k.x)*(q.x-k.x)+(q.y-k.y)*(q.y-k.y), k.pid) AS r FROM emb q, ground k)"


@query("interpolate_idw", f"WITH {EMB_SQL}, {LOW_SQL}, {_IDW} SELECT qid AS pid, round(CASE WHEN min(dist) > 0.05 THEN NULL WHEN min(dist) <= 2.220446049250313e-16 THEN arg_min(z, dist) ELSE sum(z / dist**2) / sum(1 / dist**2) END, 6) AS z FROM near WHERE r <= 8 GROUP BY qid")
def _(s, d):
    p = emb(s, d)
    return rounded(geo.interpolate_idw(ground(p), p, max_distance=0.05))


@query("aboveground_height", f"""WITH {EMB_SQL}, {LOW_SQL}, g AS (SELECT * FROM ground), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM g),
s AS (SELECT pid, x, y, z, least(greatest(floor((x - x0) / 0.05 + 0.5), 0), floor((x1 - x0) / 0.05)) * 0.05 + x0 AS gx, least(greatest(floor((y - y0) / 0.05 + 0.5), 0), floor((y1 - y0) / 0.05)) * 0.05 + y0 AS gy FROM emb, b),
n AS (SELECT s.pid, s.z, (s.x-gx)*(s.x-gx)+(s.y-gy)*(s.y-gy) AS off, g.z AS gz, sqrt((gx-g.x)*(gx-g.x)+(gy-g.y)*(gy-g.y)) AS dist, row_number() OVER (PARTITION BY s.pid ORDER BY (gx-g.x)*(gx-g.x)+(gy-g.y)*(gy-g.y), g.pid) AS r FROM s, g)
SELECT pid, round(CASE WHEN sqrt(min(off)) > sqrt(2) * 0.05 THEN NULL WHEN min(dist) <= 2.220446049250313e-16 THEN min(z) - arg_min(gz, dist) ELSE min(z) - sum(gz / dist**2) / sum(1 / dist**2) END, 6) AS "AGH" FROM n WHERE r <= 8 GROUP BY pid""")
def _(s, d):
    p = emb(s, d)
    return rounded(geo.aboveground_height(p, ground(p), 0.05).select("pid", "AGH"))


_GROUND = f"""WITH RECURSIVE {EVT_SQL.replace('evt AS', 'p AS')}, {_VOX.replace(' * 10.0', '')}, large AS (SELECT p.* FROM p JOIN vox v ON floor(p.x) = cx AND floor(p.y) = cy AND floor(p.z) = cz JOIN comp c ON c.pid = v.pid WHERE component IN (SELECT component FROM big)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY floor(x * 2.0), floor(y * 2.0) ORDER BY z, pid) AS nth FROM large), lowest AS MATERIALIZED (SELECT * FROM ranked WHERE nth = 1),
cone AS MATERIALIZED (SELECT a.pid AS src, b.pid AS dst FROM lowest a JOIN lowest b ON b.z > a.z AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= least(b.z - a.z, 5) * tan(radians(60))), early AS (SELECT * FROM cone WHERE src < dst),
{walk_sql('lowest', 'early')} SELECT pid FROM kept WHERE pid NOT IN (SELECT dst FROM cone WHERE src IN (SELECT pid FROM kept))"""


@query("segment_ground", _GROUND)
def _(s, d):
    return geo.segment_ground(evt(s, d), voxel=1.0).select("pid")


@query("crop_by_ground_polygon")
def _(s, d):
    p = emb(s, d)
    return geo.crop_by_ground_polygon(p, ground(p))[0].select("pid")


@query("mesh_distance_z")
def _(s, d):
    p = emb(s, d)
    return rounded(geo.mesh_distance_z(p, geo.triangulation(ground(p))))


@query("triangulation")
def _(s, d):
    return geo.triangulation(emb(s, d)).select("v1", "v2", "v3")


@query("pca_moments", f"WITH {EMB_SQL} SELECT label, count(*) AS n, {ro('avg(x) AS x', 'avg(y) AS y', 'avg(z) AS z')} FROM emb GROUP BY label HAVING count(*) >= 3")
def _(s, d):
    return rounded(geo.pca_linearity(emb(s, d), "label").select("label", "n", "x", "y", "z"))


_LINE = f"""WITH {EMB_SQL}, s AS (SELECT label, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, (xx + yy + zz) / 3 AS q FROM emb GROUP BY label HAVING count(*) >= 3),
t AS (SELECT *, sqrt(((xx - q)**2 + (yy - q)**2 + (zz - q)**2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS w, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * w**3) AS r FROM s),
v AS (SELECT *, q + 2 * w * cos(acos(greatest(least(r, 1), -1)) / 3) AS l3, q + 2 * w * cos((acos(greatest(least(r, 1), -1)) + 2 * pi()) / 3) AS l1 FROM t) SELECT label, n, {ro('(l3 - (3 * q - l3 - l1)) / l3 AS linearity')} FROM v"""


@query("pca_linearity", _LINE)
def _(s, d):
    return rounded(geo.pca_linearity(emb(s, d), "label").select("label", "n", "linearity"))


@query("point_in_cylinder", f"WITH {EMB_SQL} SELECT pid FROM emb WHERE abs(z) <= 0.2 AND x * x + y * y <= 0.01")
def _(s, d):
    c = [F.lit(0.0)] * 3
    return emb(s, d).where(geo.point_in_cylinder([F.col(a) for a in "xyz"], c, [F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.lit(0.1), F.lit(0.2))).select("pid")


@query("cylinder_aabb", f"WITH {NODE_SQL} SELECT node_id, {ro('-radius * sqrt(1 - 0.36) AS xlo', '0.15 * 0.8 + radius * sqrt(1 - 0.64) AS zhi').replace('-radius', '-0.15 * 0.6 - radius')} FROM node")
def _(s, d):
    n = node(s, d)
    box = geo.cylinder_aabb([F.lit(0.0)] * 3, [F.lit(0.6), F.lit(0.0), F.lit(0.8)], F.col("radius"), F.col("h"))
    return rounded(n.select("node_id", box[0][0].alias("xlo"), box[2][1].alias("zhi")))


@query("aabbs_overlap", f"WITH {EMB_SQL} SELECT a.pid AS a, b.pid AS b FROM emb a JOIN emb b ON a.pid < b.pid AND abs(a.x - b.x) <= 0.1 AND abs(a.y - b.y) <= 0.1 AND abs(a.z - b.z) <= 0.1")
def _(s, d):
    """All overlapping boxes."""
    p = emb(s, d).select("pid", "x", "y", "z")
    box = lambda q: [(F.col(f"{q}.{c}") - 0.05, F.col(f"{q}.{c}") + 0.05) for c in "xyz"]
    return nb.near_pairs(p, p, 0.1).where((F.col("a.pid") < F.col("b.pid")) & geo.aabbs_overlap(box("a"), box("b"))).select(F.col("a.pid").alias("a"), F.col("b.pid").alias("b"))


@query("cylinder_volume", f"WITH {NODE_SQL}, l AS (SELECT (unnest(range(-40, 40)) + 0.5) * 0.01 AS v), m AS (SELECT nbs_id, max(radius) AS r FROM node GROUP BY nbs_id), c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r FROM m) JOIN (SELECT a.v AS x, b.v AS y FROM l a, l b) ON x * x + y * y <= r * r GROUP BY r) SELECT nbs_id, {ro('n * (SELECT count(*) FROM l WHERE abs(v) <= 0.075) * 1e-6 AS volume')} FROM m JOIN c USING (r)")
def _(s, d):
    """Of every nbs_id. The cylinders of one are upright and about one axis, so the SQL takes the widest."""
    n = node(s, d).select("nbs_id", *[F.lit(v).alias(c) for c, v in (("cx", 0.0), ("cy", 0.0), ("cz", 0.0), ("dx", 0.0), ("dy", 0.0), ("dz", 1.0))], "radius", (F.col("h") / 2).alias("half"))
    return rounded(geo.voxel_volume(n, 0.01))


@query("frustum_metrics", f"WITH {NODE_SQL} SELECT node_id, {ro('pi() / 3 * h * (radius * radius + 0.01 + radius * 0.1) AS volume', 'pi() * (radius + 0.1) * sqrt(h * h + (radius - 0.1) * (radius - 0.1)) AS surface')} FROM node")
def _(s, d):
    v, a = geo.frustum(F.col("radius"), F.lit(0.1), F.col("h"))
    return rounded(node(s, d).select("node_id", v.alias("volume"), a.alias("surface")))


_NODES = f"""{NODE_SQL}, w AS (SELECT *, lag(radius) OVER q AS p, lead(radius) OVER q AS s FROM node WINDOW q AS (PARTITION BY nbs_id ORDER BY agh, node_id)),
r AS (SELECT *, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN (p + radius) / 2 ELSE coalesce(p, radius) END AS r1, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN (radius + s) / 2 ELSE coalesce(s, radius) END AS r2 FROM w),
t AS (SELECT *, pi() / 3 * h * (r1 * r1 + r2 * r2 + r1 * r2) AS volume, pi() * (r1 + r2) * sqrt(h * h + (r1 - r2) * (r1 - r2)) AS surface_area FROM r)"""


def _modelled(s, d) -> DataFrame:
    n = node(s, d).select("nbs_id", "node_id", "tree_id", "agh", F.col("radius").alias("radius_area"), (F.col("radius") * 1.5).alias("radius_circ"), "n_points", F.col("h").alias("height"), F.col("agh").alias("center_x"), (-F.col("agh")).alias("center_y"))
    return bio.node_table(n)


@query("node_table", f"WITH {_NODES} SELECT node_id, {ro('volume', 'surface_area')} FROM t")
def _(s, d):
    return rounded(_modelled(s, d).select("node_id", "volume", "surface_area"))


@query("tree_table", f"WITH {_NODES}, f AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY abs(agh - 1.3), node_id) AS k FROM t) SELECT tree_id, {ro('sum(volume) AS volume', 'sum(surface_area) AS surface_area', 'max(agh) AS height', 'max(2 * radius) FILTER (k = 1) AS dbh_area', 'max(3 * radius) FILTER (k = 1) AS dbh_circ', 'max(agh) FILTER (k = 1) AS x', 'max(-agh) FILTER (k = 1) AS y')}, sum(n_points)::BIGINT AS n_points, count(*) AS n_nodes FROM f GROUP BY tree_id")
def _(s, d):
    return rounded(bio.tree_table(_modelled(s, d)))


def _derived(s, d) -> DataFrame:
    return emb(s, d).withColumns({"nbs_id": F.col("label"), "node_id": (F.floor((F.col("x") + 1) * 10) + 1).cast("long"), "AGH": F.col("z") + 0.5})


_DER = f"{EMB_SQL}, {EDGE_SQL}, der AS (SELECT *, label AS nbs_id, floor((x + 1) * 10)::BIGINT + 1 AS node_id, z + 0.5 AS agh FROM emb)"


@query("skeleton", f"WITH {_DER} SELECT DISTINCT least(a.node_id, b.node_id) AS na, greatest(a.node_id, b.node_id) AS nb FROM edge JOIN der a ON a.pid = src JOIN der b ON b.pid = dst WHERE a.node_id <> b.node_id")
def _(s, d):
    p = _derived(s, d)
    return bio.skeleton(p, nb.radius_edges(p, R))[1]


@query("skeleton_nodes", f"WITH {_DER} SELECT node_id, {ro('avg(x) AS x', 'avg(y) AS y', 'avg(z) AS z')}, count(*) AS n_points FROM der GROUP BY node_id")
def _(s, d):
    p = _derived(s, d)
    return rounded(bio.skeleton(p, nb.radius_edges(p, R))[0])


@query("nbs_adjacency", f"WITH {_DER} SELECT least(a.nbs_id, b.nbs_id) AS nbs_a, greatest(a.nbs_id, b.nbs_id) AS nbs_b, count(*) AS n FROM edge JOIN der a ON a.pid = src JOIN der b ON b.pid = dst WHERE a.nbs_id <> b.nbs_id AND a.nbs_id > 0 AND b.nbs_id > 0 GROUP BY 1, 2")
def _(s, d):
    p = _derived(s, d)
    return bio.nbs_adjacency(p, nb.radius_edges(p, R))


@query("seed_trees", f"WITH {_DER}, m AS (SELECT nbs_id, min(agh) AS low FROM der WHERE nbs_id > 0 GROUP BY 1 HAVING min(agh) <= 0.22) SELECT nbs_id, row_number() OVER (ORDER BY nbs_id)::INT AS tree_id FROM m")
def _(s, d):
    return bio.seed_trees(_derived(s, d), 0.22)


@query("snap_plurality", f"WITH {_DER}, v AS (SELECT node_id, nbs_id, count(*) AS n FROM der GROUP BY 1, 2), w AS (SELECT node_id, nbs_id, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, nbs_id) AS k FROM v) SELECT pid, w.nbs_id FROM der JOIN w USING (node_id) WHERE k = 1")
def _(s, d):
    return bio.snap_to_nodes(_derived(s, d))


@query("near_ground", f"WITH {_DER} SELECT pid FROM der WHERE agh > 0.5")
def _(s, d):
    return flt.above_threshold(_derived(s, d), 0.5).select("pid")


_RECEIVER = f"""WITH {EMB_SQL}, {EDGE_SQL}, owner AS (SELECT pid AS node_id, label AS nbs_id FROM emb), arc AS (SELECT src AS na, dst AS nb FROM edge UNION ALL SELECT dst, src FROM edge),
c AS (SELECT a.nbs_id AS donor, b.nbs_id AS receiver, count(DISTINCT na) AS touch FROM arc JOIN owner a ON a.node_id = na JOIN owner b ON b.node_id = nb WHERE a.nbs_id <> b.nbs_id GROUP BY 1, 2),
t AS (SELECT nbs_id, count(*) AS total FROM owner GROUP BY 1), f AS (SELECT donor, receiver, touch, d.total AS dv, r.total AS rv, touch / d.total AS frac FROM c JOIN t d ON d.nbs_id = donor JOIN t r ON r.nbs_id = receiver WHERE (r.total > d.total OR (r.total = d.total AND receiver < donor)) AND touch / d.total >= 0.2),
k AS (SELECT *, row_number() OVER (PARTITION BY donor ORDER BY touch DESC, rv DESC, receiver) AS n FROM f) SELECT donor, receiver, {ro('frac')} FROM k WHERE n = 1"""


@query("rule_b_receiver", _RECEIVER)
def _(s, d):
    p = emb(s, d).select(F.col("pid").alias("node_id"), F.col("label").alias("nbs_id"))
    e = nb.radius_edges(emb(s, d), R, weights=False).select(F.col("src").alias("na"), F.col("dst").alias("nb"))
    v = p.groupBy("nbs_id").agg(F.count(F.lit(1)).alias("volume"))
    return rounded(bio.merge_receivers(p, e, v, 0.2))


_UNROLL = f"{EVT_SQL}, un AS (SELECT pid, floor(z * 2)::BIGINT AS slice, sqrt((x - 5) * (x - 5) + (y - 5) * (y - 5)) AS rho, atan2(y - 5, x - 5) AS phi FROM evt)"


def _unrolled(s, d) -> DataFrame:
    return unroll.unrolled(evt(s, d).withColumns({"slice": F.floor(F.col("z") * 2), "u": F.col("x") - 5, "v": F.col("y") - 5}))


@query("unroll_points", f"WITH {_UNROLL} SELECT pid, {ro('rho', 'phi')} FROM un")
def _(s, d):
    return rounded(_unrolled(s, d).select("pid", "rho", "phi"))


@query("rho_surface", f"WITH {_UNROLL} SELECT slice, least(greatest(floor((phi + pi()) / (2 * pi() / 36)) + 1, 1), 36)::INT AS bin, {ro('avg(rho) AS rho')} FROM un GROUP BY 1, 2")
def _(s, d):
    return rounded(unroll.rho_surface(_unrolled(s, d), 36))


@query("rho_filter", f"WITH {_UNROLL}, q AS (SELECT slice, quantile_cont(rho, 0.9) AS cap FROM un GROUP BY slice) SELECT pid FROM un JOIN q USING (slice) WHERE rho <= cap")
def _(s, d):
    return unroll.rho_filter(_unrolled(s, d), 0.9).select("pid")


@query("moving_centreline", f"WITH {EMB_SQL} SELECT pid, {ro('avg(x) OVER w AS x', 'avg(y) OVER w AS y', 'avg(z) OVER w AS z')} FROM emb WINDOW w AS (PARTITION BY label ORDER BY pid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(s, d):
    return rounded(unroll.moving_centres(emb(s, d), "label", "pid").select("pid", "x", "y", "z"))


@query("las_round_trip", f"WITH {EVT_SQL} SELECT pid, {ro('x', 'y', places=4)}, (pid % 100)::INT AS intensity, pid * 3 AS tag FROM evt")
def _(s, d):
    path = f"{new_path(s, 'las')}.las"
    files.write_pc(evt(s, d).withColumns({"intensity": (F.col("pid") % 100).cast("int"), "tag": F.col("pid") * 3, "row": F.col("pid")}), path)
    return rounded(files.read_pc(s, path).select(F.col("row").alias("pid"), "x", "y", "intensity", "tag"), 4)


@query("las_limits", f"WITH {EVT_SQL} SELECT pid FROM evt WHERE x > 5 AND y < 2")
def _(s, d):
    path = f"{new_path(s, 'las')}.las"
    files.write_pc(evt(s, d).withColumn("row", F.col("pid")), path)
    return files.read_pc(s, path).where("x > 5.00001 and y < 1.99999").select(F.col("row").alias("pid"))


@query("las_metadata", f"WITH {EVT_SQL} SELECT count(*) AS point_count, {ro('min(x) AS xmin', 'max(y) AS ymax', places=4)} FROM evt")
def _(s, d):
    path = f"{new_path(s, 'las')}.las"
    files.write_pc(evt(s, d), path)
    return rounded(files.read_pc_metadata(s, path).select("point_count", F.element_at("bounds_min", 1).alias("xmin"), F.element_at("bounds_max", 2).alias("ymax")), 4)


@query("merge_reason", f"WITH {NODE_SQL} SELECT node_id, CASE WHEN NOT radius * 2 > 0.2 THEN 'below_overlap_threshold' WHEN NOT agh / 50 >= 0.25 THEN 'node_completeness_gate' WHEN NOT 0.5 >= 0.25 THEN 'focal_completeness_gate' WHEN NOT n_points * 15 >= 20 THEN 'min_points_gate' ELSE 'ok' END AS reason FROM node")
def _(s, d):
    return node(s, d).select("node_id", bio.merge_reason(F.col("radius") * 2, F.col("agh") / 50, F.lit(0.5), F.col("n_points") * 15).alias("reason"))


FOREST = load_config(text="[pipeline]\nsubsample_res = 0.04\n[tree]\nnearground_agh_threshold = 0.2\n[tree.model]\nnbs_linearity_threshold = 0.1\ncompleteness_threshold = 0.05\n")


def _forest(s, d) -> DataFrame:
    """P_emb with heights, as a cloud of stems."""
    return emb(s, d).withColumn("AGH", F.col("z") + 0.5)


@query("label_segments")
def _(s, d):
    return trees.label_segments(trees.with_components(_forest(s, d), R), FOREST).select("pid", "nbs_id", "node_id")


@query("model_segments")
def _(s, d):
    return rounded(trees.model_segments(_forest(s, d), FOREST, "label")[0])


@query("surface_cloud")
def _(s, d):
    return rounded(trees.model_segments(_forest(s, d), FOREST, "label", True)[2])


@query("tree_segmentation")
def _(s, d):
    return trees.tree_segmentation(_forest(s, d), FOREST)[0].select("pid", "tree_id", "tree_nbs_id")


@query("occluded_branches")
def _(s, d):
    p = _forest(s, d).withColumns({"tree_id": F.when(F.col("label") < 3, F.col("label") + 1).otherwise(0).cast("long"), "tree_nbs_id": (F.col("label") + 1).cast("long")})
    return trees.occluded_branches(p, FOREST).select("pid", "tree_id")
