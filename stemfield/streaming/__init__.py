"""Point tables as streams: the stateless filters run on each micro-batch of new scan files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_scans(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet scans of a folder, as a stream of points."""
    return spark.readStream.schema(schema).parquet(folder)


def write_filtered(points: DataFrame, steps: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Apply ``steps`` (any function of a point table) to each micro-batch and append the result; a batch that is repeated after a failure overwrites its own folder."""

    def batch(frame: DataFrame, number: int) -> None:
        steps(frame).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
