"""Session construction and the shared storage used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stemfield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set on a single machine (master ``local``); on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.sparkContext._jvm.System.getProperty("stemfield.shared.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="stemfield-")
        spark.sparkContext._jvm.System.setProperty("stemfield.shared.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The table survives lost executors and cuts the lineage, so nothing above it is computed twice.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in a batch of rows that goes to a Python worker. Spark's own default is 64 MB, of which the JVM and the worker hold several copies each.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Make a session ready for the registered queries: send this package to the executors' Python workers, once for each context, so that
    they can import it from anywhere, and bound Arrow batches by ``BATCH_BYTES`` where the session has no setting of its own."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    import shutil
    from pathlib import Path

    key = f"stemfield.shipped.{spark.sparkContext.applicationId}"
    system = spark.sparkContext._jvm.System
    if not system.getProperty(key):
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='stemfield-')}/stemfield", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        system.setProperty(key, "true")
