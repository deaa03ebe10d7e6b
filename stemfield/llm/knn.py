"""Exact top-k by inner product: a Voronoi kNN join.

Vectors and queries are grouped by their nearest pivot. Summaries of the groups (their sizes, radii and the smallest
distances to the pivot) give each query group a score that its k best partners are sure to reach; a vector travels to
a query group only if its largest possible score there reaches that bound, and each group is solved locally.

With c the pivot of a query group, R its radius (largest ``|q - c|``) and N its largest norm, every query q of it has
``q.x <= c.x + R |x|`` for any x, and ``q.x >= c.p - R |p| - N d`` for an x at distance d from its own pivot p.

Pivots are a bounded sample (``pivots`` rows, those of smallest hash); they decide speed, never results. Query groups
are split into blocks of at most about ``block`` queries and the vectors of a group into shards, so no
task holds an unbounded group; the k best of every shard meet in a last merge. The bounds of a query group are tried on a bounded sample first:
groups that at least half of the vectors reach anyway (as in data without clusters) share their blocks, and a vector that any of them needs travels there once.

Vectors that are null or hold null, NaN or infinite components take no part, nor do rows with a null id. Vectors of
different lengths have no product: those of each length are searched apart. Products are exact at any size of the components; a
component or a reported score that is no 64-bit integer raises an error. Repeated ids are rows of their own, but a query never
meets a row of its own id. Ties go to the smaller id. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PACKED = "key string, kind int, ids binary, vectors binary"
#: Numbers of packed components: the first in which they all fit.
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
#: Rows on which bounds are tried.
TRIED = 1000
_LEAST = -(2**63)


def quantised(rows: DataFrame, id_col: str, vector: str, factor: int) -> DataFrame:
    """``id, v``: floor(factor * component), for rows that take part."""
    real = lambda x: x.cast("double")
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(real(x)) | (F.abs(real(x)) == float("inf")))
    whole = lambda x: F.when(F.abs(real(x) * factor) < 2.0**63, F.floor(real(x) * factor).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for a 64-bit integer")).cast("long"))
    return rows.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, whole).alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    vectors = batch.column("v")
    return ids, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)


def arithmetic(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest kind of number in which all inner products of rows of a and b are exact."""
    if not len(a) or not len(b):
        return np.float64
    most = lambda x: max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    largest = most(a) * most(b) * a.shape[1]
    return np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object


def best_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, rows: int = 64) -> pd.DataFrame:
    """``query_id, vec_id, score`` of the k best of each query; the ids of x ascend, so ties go to the smaller. A score below all 64-bit integers counts as the least."""
    kind = arithmetic(q, x)
    q, x = q.astype(kind), x.astype(kind)
    found = [(qid[:0], xid[:0], qid[:0])]
    for a in range(0, len(qid), rows):
        for i, s in enumerate(q[a : a + rows] @ x.T):
            own = xid != qid[a + i]
            s, ids = s[own], xid[own]
            if len(s) > k and kind is not object:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above, level = np.flatnonzero(s > least), np.flatnonzero(s == least)
                at = np.concatenate([above, level[: k - len(above)]])
            else:
                at = np.array(sorted(range(len(s)), key=lambda j: -s[j])[:k], np.int64)  # noqa: B023
            s = s[at]
            if kind is object:
                if any(v >= 2**63 for v in s):
                    raise ValueError("a score is too large for a 64-bit integer")
                s = np.array([max(v, _LEAST) for v in s], np.int64)
            found.append((np.full(len(at), qid[a + i]), ids[at], s.astype(np.int64)))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to each row's nearest pivot."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    d2 = (x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)
    at = d2.argmin(1)
    return at, np.sqrt(np.maximum(((x - p[at]) ** 2).sum(1), 0))


def summaries(vectors: DataFrame, pivots: np.ndarray, k: int, every: int) -> DataFrame:
    """Per pivot and side (data, queries): size, radius, largest norm and, of the data, the k + 1 smallest distances."""
    dim = pivots.shape[1]

    def part(it):
        for batch in it:
            ids, x = _matrix(batch, dim)
            at, dist = nearest(x, pivots)
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            for side, keep in ((0, np.ones(len(ids), bool)), (1, ids % every == 0)):
                frame = pd.DataFrame({"pivot": at[keep], "d": dist[keep], "norm": norm[keep]})
                groups = frame.groupby("pivot")
                out = groups.agg(n=("d", "size"), radius=("d", "max"), norm=("norm", "max")).reset_index()
                out["near"] = [np.sort(g.to_numpy())[: k + 1].tolist() for _, g in groups["d"]]
                if len(out):
                    yield pa.RecordBatch.from_pandas(out.assign(side=side)[["side", "pivot", "n", "radius", "norm", "near"]], pa.schema([("side", pa.int32()), ("pivot", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("norm", pa.float64()), ("near", pa.list_(pa.float64()))]), preserve_index=False)

    parts = vectors.mapInArrow(part, "side int, pivot int, n long, radius double, norm double, near array<double>")
    head = parts.groupBy("side", "pivot").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm"))
    near = parts.where("side = 0").select("side", "pivot", F.explode("near").alias("d")).groupBy("side", "pivot", "d").agg(F.count(F.lit(1)).alias("times"))
    # the k + 1 smallest of each pivot: every task has sent its own smallest at most, so these are few
    near = near.groupBy("side", "pivot").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.array_repeat("d", F.least(F.col("times"), F.lit(k + 1)).cast("int"))))), 1, k + 1).alias("near"))
    return head.join(near, ["side", "pivot"], "left")


def top_k(rows: DataFrame, id_col: str, vector: str, k: int = 20, every: int = 20, factor: int = 64, pivots: int = 64, block: int = 16_384, shard: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best partners of each row whose id is divisible by ``every``. Shards are smaller, down to an
    eighth, where the cluster has more tasks than shards."""
    vectors = quantised(rows, id_col, vector, factor)
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sizes = {r["s"]: r["n"] for r in vectors.groupBy(F.size("v").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    for dim, total in sorted(sizes.items()):
        shards = max(1, -(-total // min(shard, max(shard // 8, -(-total // tasks)))))
        found = found.union(of_length(vectors.where(F.size("v") == dim), dim, k, every, pivots, block, shards))
    return found


def of_length(vectors: DataFrame, dim: int, k: int, every: int, pivots: int, block: int, shards: int) -> DataFrame:
    """``top_k`` of vectors (id, v) of one length."""
    seen = [r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(max(pivots, TRIED)).collect()]
    p = np.array(sorted(set(map(tuple, seen[:pivots]))), np.int64)
    p = p.reshape(len(p), dim)
    stats = summaries(vectors, p, k, every).collect()
    data, queries = {r["pivot"]: r for r in stats if r["side"] == 0}, {r["pivot"]: r for r in stats if r["side"] == 1}
    if not queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    group = np.array(sorted(queries))
    radius, norm = (np.array([queries[g][c] for g in group]) for c in ("radius", "norm"))
    centre = p[group].astype(np.float64)
    reach = np.linalg.norm(centre, axis=1) + radius
    bound = np.full(len(group), -np.inf)
    for i in range(len(group)):
        sure = np.concatenate([centre[i] @ p[j] - radius[i] * np.linalg.norm(p[j]) - norm[i] * np.array(r["near"]) for j, r in data.items()])
        if len(sure) > k:  # one of them may be the query itself
            bound[i] = np.sort(sure)[-(k + 1)]
            bound[i] -= 1e-6 * (1 + abs(bound[i]))

    def needed(x: np.ndarray) -> np.ndarray:
        """Which rows each query group needs, ``(groups, rows)``; rounding errors are allowed for."""
        length = np.linalg.norm(x, axis=1)
        return centre @ x.T + radius[:, None] * length + 1e-9 * (1 + reach[:, None] * length) >= bound[:, None]

    share = needed(np.array(seen, np.float64).reshape(len(seen), dim)).mean(1)
    # groups with clear bounds keep to themselves, the others share number -1
    home = np.where(share < 0.5, np.arange(len(group)), -1)
    asked = {int(h): sum(queries[g]["n"] for g in group[home == h]) for h in np.unique(home)}
    blocks = {h: -(-n // block) for h, n in asked.items()}
    place = dict(zip(group.tolist(), home.tolist(), strict=True))

    def deal(it):
        def row(h, b, s, side, ids, x):
            low, high = int(x.min(initial=0)), int(x.max(initial=0))
            width = next(i for i, t in enumerate(WIDTHS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            return {"key": f"{h}/{b}/{s}", "kind": 2 * width + side, "ids": ids.tobytes(), "vectors": x.astype(WIDTHS[width]).tobytes()}

        schema = pa.schema([("key", pa.string()), ("kind", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
        for batch in it:
            ids, x = _matrix(batch, dim)
            asks = np.flatnonzero(ids % every == 0)
            at, _ = nearest(x[asks], p)
            own = np.array([place.get(g, -2) for g in at.tolist()], np.int64)
            sent = needed(x.astype(np.float64))
            where = (ids * 40503 + (ids >> 16)) % shards
            out = []
            for h, count in blocks.items():
                part = (ids[asks] // every * 2654435761 % 4294967296) % count
                wanted = sent[home == h].any(0)
                for b in range(count):
                    mine = asks[(own == h) & (part == b)]
                    if len(mine):
                        out += [row(h, b, s, 0, ids[mine], x[mine]) for s in range(shards)]
                    out += [row(h, b, s, 1, ids[to], x[to]) for s in range(shards) if (to := wanted & (where == s)).any()]
                    if len(out) > 64:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        def load(side):
            part = frame[frame["kind"] % 2 == side]
            ids = [np.frombuffer(b, np.int64) for b in part["ids"]]
            x = [np.frombuffer(b, WIDTHS[w // 2]).reshape(len(i), dim).astype(np.int64) for b, w, i in zip(part["vectors"], part["kind"], ids, strict=True)]
            return (np.concatenate(ids), np.concatenate(x)) if ids else (np.zeros(0, np.int64), np.zeros((0, dim), np.int64))

        (qid, q), (xid, x) = load(0), load(1)
        order = np.argsort(xid, kind="stable")
        return best_of(q, qid, x[order], xid[order], k)

    local = vectors.mapInArrow(deal, PACKED).groupBy("key").applyInPandas(solve, "query_id long, vec_id long, score long")
    best = local.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), F.col("vec_id").alias("v")))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("at", "b"))
    score = F.when(F.col("b.s") < 2**63 - 1, F.bitwise_not("b.s")).otherwise(F.raise_error(F.lit("a score is too small for a 64-bit integer")).cast("long"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), score.alias("score"))


def op3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
