"""Point tables: the relational primitives and affine transforms.

A point table has ``pid`` (stable row id, long), ``x, y, z`` (double) and any further columns as attributes. Every function takes and gives DataFrames
and stays lazy unless it returns plain numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE = ("pid", "x", "y", "z")
XYZ = ("x", "y", "z")


def attributes(points: DataFrame) -> list[str]:
    return [c for c in points.columns if c not in CORE]


def has_attribute(points: DataFrame, name: str) -> bool:
    return name in attributes(points)


def coordinates(points: DataFrame) -> DataFrame:
    return points.select(*XYZ)


def get_attribute(points: DataFrame, name: str) -> DataFrame:
    if name not in points.columns:
        raise KeyError(name)
    return points.select("pid", name)


def set_attribute(points: DataFrame, name: str, values: Column | DataFrame) -> DataFrame:
    """Add or replace a column, from an expression or from a table ``(pid, name)``; every point must have one value."""
    if name in CORE:
        raise ValueError(f"{name} is a coordinate or the id")
    if isinstance(values, Column):
        return points.withColumn(name, values)
    if not points.join(values, "pid", "left_anti").isEmpty() or not values.groupBy("pid").count().where("count > 1").isEmpty():
        raise ValueError(f"{name} needs one value for each point")
    return points.drop(name).join(values.select("pid", name), "pid")


def delete_attribute(points: DataFrame, name: str) -> DataFrame:
    return points.drop(name) if has_attribute(points, name) else points


def gather(points: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``index (ord, pid)`` in that order; repeats are kept. The new ids are the positions."""
    return index.select("ord", F.col("pid").alias("_pid")).join(points, F.col("_pid") == F.col("pid")).drop("pid", "_pid").withColumnRenamed("ord", "pid").select(*points.columns)


def merge(clouds: Sequence[DataFrame]) -> DataFrame:
    """Union on the attributes that all clouds have; ids become ``cloud number * 2**40 + pid``, which keeps the order of clouds."""
    if not clouds:
        raise ValueError("no point cloud to merge")
    common = [c for c in clouds[0].columns if all(c in d.columns for d in clouds)]
    parts = [d.select(*common).withColumn("pid", F.col("pid") + F.lit(i << 40)) for i, d in enumerate(clouds)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def bounds(points: DataFrame) -> DataFrame:
    """One row ``xmin, xmax, ymin, ymax, zmin, zmax``; nulls for an empty table."""
    return points.agg(*[f(c).alias(f"{c}{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])


def center(points: DataFrame) -> DataFrame:
    return points.agg(*[F.avg(c).alias(c) for c in XYZ])


class Affine:
    """``p -> A p + b``. Composes with ``@`` (right side first), applies to a point table or to arrays."""

    def __init__(self, matrix: Sequence[Sequence[float]] | None = None, shift: Sequence[float] = (0.0, 0.0, 0.0)):
        self.matrix = np.eye(3) if matrix is None else np.asarray(matrix, float)
        self.shift = np.asarray(shift, float)
        if self.matrix.shape != (3, 3) or self.shift.shape != (3,):
            raise ValueError("an affine map of points needs a 3x3 matrix and 3 offsets")

    def __matmul__(self, first: Affine) -> Affine:
        return Affine(self.matrix @ first.matrix, self.matrix @ first.shift + self.shift)

    def __call__(self, points: DataFrame) -> DataFrame:
        def row(i: int) -> Column:
            terms = [F.col(c) if a == 1 else F.col(c) * F.lit(float(a)) for c, a in zip(XYZ, self.matrix[i], strict=True) if a != 0]
            total = reduce(lambda p, q: p + q, terms) if terms else F.lit(0.0)
            return total + F.lit(float(self.shift[i])) if self.shift[i] else total

        return points.withColumns({c: row(i) for i, c in enumerate(XYZ)})

    def apply(self, coords: np.ndarray) -> np.ndarray:
        return np.asarray(coords) @ self.matrix.T + self.shift


def translate(points: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    return Affine(shift=(dx, dy, dz))(points)


def scale(points: DataFrame, sx: float, sy: float | None = None, sz: float | None = None) -> DataFrame:
    """About the origin, by one factor or one an axis; factors must be positive."""
    factors = (sx, sx if sy is None else sy, sx if sz is None else sz)
    if min(factors) <= 0:
        raise ValueError("scale factors must be positive")
    return Affine(np.diag(factors))(points)


def rotation(axis: str | Sequence[float], angle: float) -> np.ndarray:
    """Right-hand rotation by ``angle`` radians about x, y, z or a vector (which is normalised)."""
    if isinstance(axis, str):
        if axis not in XYZ:
            raise ValueError(f"no axis {axis!r}")
        axis = [float(axis == c) for c in XYZ]
    v = np.asarray(axis, float)
    if v.shape != (3,) or not np.linalg.norm(v):
        raise ValueError("a rotation axis is a vector of length 3 that isn't zero")
    a, b, c = v / np.linalg.norm(v)
    k = np.array([[0, -c, b], [c, 0, -a], [-b, a, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)


def rotate(points: DataFrame, axis: str | Sequence, angle: float | None = None) -> DataFrame:
    """By an axis and angle, or by a 3x3 matrix alone."""
    return Affine(axis if angle is None else rotation(axis, angle))(points)


def center_at_origin(points: DataFrame) -> DataFrame:
    mid = center(points).select(*[F.col(c).alias(f"_{c}") for c in XYZ])
    return points.join(F.broadcast(mid)).withColumns({c: F.col(c) - F.col(f"_{c}") for c in XYZ}).drop(*[f"_{c}" for c in XYZ])  # one row is broadcast


def transform(points: DataFrame, function: Affine | Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """By an ``Affine``, as expressions; by any other function of an ``(n, 3)`` array, in Arrow batches."""
    if isinstance(function, Affine):
        return function(points)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = [batch.schema.names.index(c) for c in XYZ]
            moved = np.asarray(function(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at])), float)
            columns = list(batch.columns)
            for j, i in enumerate(at):
                columns[i] = pa.array(moved[:, j], pa.float64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return points.mapInArrow(run, points.schema)


def bounding_box_crop(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Points in the closed box; the predicate reaches a Parquet scan."""
    if len(low) != 3 or len(high) != 3:
        raise ValueError("a box has three lower and three upper limits")
    return points.where(reduce(lambda a, b: a & b, [F.col(c).between(float(a), float(b)) for c, a, b in zip(XYZ, low, high, strict=True)]))
