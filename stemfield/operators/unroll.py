"""Unrolled surfaces as tables: radius and angle about a centre, their grid, outliers by slice, smoothed centre lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unrolled(points: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``points`` with ``rho`` and ``phi`` of their offsets from the centre."""
    return points.withColumns({"rho": F.hypot(u, v), "phi": F.atan2(v, u)})


def rho_surface(points: DataFrame, bins: int) -> DataFrame:
    """``slice, bin, rho``: the mean radius of each filled cell; bins from 1."""
    if bins < 1:
        raise ValueError("there must be at least one bin")
    step = 2 * math.pi / bins
    at = F.least(F.greatest(F.floor((F.col("phi") + math.pi) / F.lit(step)) + 1, F.lit(1)), F.lit(bins)).cast("int")
    return points.groupBy("slice", at.alias("bin")).agg(F.avg("rho").alias("rho"))


def rho_filter(points: DataFrame, percentile: float) -> DataFrame:
    """Points whose radius is at most the quantile of their slice; all for a percentile of 1 or more."""
    if percentile >= 1:
        return points
    limits = points.groupBy(F.col("slice").alias("_s")).agg(F.percentile("rho", percentile).alias("_limit"))
    return points.join(limits, F.col("slice") == F.col("_s")).where("rho <= _limit").drop("_s", "_limit")


def moving_centres(centres: DataFrame, key: str, order: str, window: int = 2) -> DataFrame:
    """``centres`` (key, order, x, y, z) with each coordinate averaged over ``window`` rows on either side."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-window, window)
    return centres.withColumns({c: F.avg(c).over(w) for c in "xyz"})
