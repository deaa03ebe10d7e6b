"""Range and nearest-neighbour joins by grid cells: equi-joins on cell numbers with a residual distance test."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_table


def cell(column: str | Column, size: float) -> Column:
    """The cell number, as ``floor(v * (1 / size))``."""
    return F.floor((F.col(column) if isinstance(column, str) else column) * F.lit(1.0 / size)).cast("long")


def distance2(axes: tuple[str, ...], a: str = "a", b: str = "b") -> Column:
    return reduce(lambda p, q: p + q, [(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in axes])


def near_pairs(left: DataFrame, right: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Pairs of structs ``a`` (of left), ``b`` (of right) whose cells touch, with their squared distance ``d2``; the caller tests it.

    The right side is copied to the ``3 ** axes`` cells around it. Cells are a trifle wider than the radius, so rounding loses no pair.
    """
    if not radius > 0:
        raise ValueError("the radius must be positive")
    size = radius * (1 + 1e-9)
    names = [f"_c{i}" for i in range(len(axes))]
    a = left.select(F.struct(*left.columns).alias("a"), *[cell(c, size).alias(n) for c, n in zip(axes, names, strict=True)])
    around = F.array(*[F.struct(*[(cell(c, size) + o).alias(n) for c, n, o in zip(axes, names, off, strict=True)]) for off in product((-1, 0, 1), repeat=len(axes))])
    b = right.select(F.struct(*right.columns).alias("b"), F.explode(around).alias("_c")).select("b", "_c.*")
    return a.join(b, names).drop(*names).withColumn("d2", distance2(axes))


def radius_edges(points: DataFrame, radius: float, weights: bool = True, strict: bool = False) -> DataFrame:
    """``src < dst`` (and ``w``, the distance) of all pairs of points at most ``radius`` apart (less than it, if ``strict``)."""
    core = points.select("pid", "x", "y", "z")
    close = near_pairs(core, core, radius).where((F.col("a.pid") < F.col("b.pid")) & (F.col("d2") < F.lit(radius) * radius if strict else F.sqrt("d2") <= radius))
    return close.select(F.col("a.pid").alias("src"), F.col("b.pid").alias("dst"), *([F.sqrt("d2").alias("w")] if weights else []))


def neighbour_counts(points: DataFrame, radius: float) -> DataFrame:
    """``pid, n_neighbours``: other points within the radius."""
    edges = radius_edges(points, radius, weights=False)
    both = edges.select(F.col("src").alias("pid")).unionAll(edges.select(F.col("dst").alias("pid"))).groupBy("pid").agg(F.count(F.lit(1)).alias("n_neighbours"))
    return points.select("pid").join(both, "pid", "left").select("pid", F.coalesce("n_neighbours", F.lit(0).cast("long")).alias("n_neighbours"))


def finite(axes: tuple[str, ...]) -> Column:
    """Whether a row has all its coordinates, none NaN or infinite."""
    return reduce(lambda p, q: p & q, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in axes])


def knn_join(queries: DataFrame, known: DataFrame, k: int, axes: tuple[str, ...] = ("x", "y", "z"), exclude_same: bool = False) -> DataFrame:
    """``qid, pid, d2, rank``: the k nearest known points of every query, ties to the smaller pid; exact. Points and queries with a
    null, NaN or infinite coordinate take no part.

    A search radius is guessed from the density; a query is done when k points lie within it, the others try again with the
    doubled radius, until it spans everything. Only the queries that are left are copied to the cells around them, and a task keeps no more than k
    points of a query.
    """
    known, queries = known.select("pid", *axes).where(finite(axes)), queries.where(finite(axes))
    stats = known.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo{c}") for c in axes], *[F.max(c).alias(f"hi{c}") for c in axes]).first()
    reach = queries.agg(*[F.min(c).alias(f"lo{c}") for c in axes], *[F.max(c).alias(f"hi{c}") for c in axes]).first()
    empty = queries.sparkSession.createDataFrame([], "qid long, pid long, d2 double, rank int")
    if not stats["n"] or reach[f"lo{axes[0]}"] is None:
        return empty
    spans = [stats[f"hi{c}"] - stats[f"lo{c}"] for c in axes]
    whole = sum((max(stats[f"hi{c}"], reach[f"hi{c}"]) - min(stats[f"lo{c}"], reach[f"lo{c}"])) ** 2 for c in axes) ** 0.5
    used = [s for s in spans if s > 1e-12]
    radius = max((reduce(lambda a, b: a * b, used, 1.0) * (k + 1) / stats["n"]) ** (1 / max(1, len(used))), whole * 1e-6, 1e-12)
    rest, done = queries.select(F.col("pid").alias("qid"), *axes), []
    nearest = Window.partitionBy("qid").orderBy("d2", "pid")
    while True:
        last = not radius < whole
        found = near_pairs(known, rest, radius, axes).where(F.sqrt("d2") <= radius).select(F.col("b.qid").alias("qid"), F.col("a.pid").alias("pid"), "d2")
        if exclude_same:
            found = found.where("qid <> pid")
        best = persist_table(found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k), "knn")
        if last:
            done.append(best)
            break
        full = best.where(F.col("rank") == k).select("qid")
        done.append(best.join(full, "qid", "left_semi"))
        rest = persist_table(rest.join(full, "qid", "left_anti"), "knn-rest")
        if rest.isEmpty():
            break
        radius *= 2
    return reduce(lambda a, b: a.unionAll(b), done).select("qid", "pid", "d2", "rank")
