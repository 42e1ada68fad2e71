"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


# Capturing the call site of every Column operation costs seconds on large expressions.
CALL_SITES = "spark.python.sql.dataFrameDebugging.enabled"


def build_session(app: str = "gatehouse", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution (skew splitting, partition coalescing)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config(CALL_SITES, "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Hour buckets and epoch conversions are defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ship_package(spark)


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder the cluster names; ``fallback`` only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if fallback:
        os.makedirs(fallback, exist_ok=True)
        spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a single machine (tests)."""
    folder = checkpoint_dir(spark)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return checkpoint_dir(spark, tempfile.mkdtemp(prefix="gatehouse-"))


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once per application, so that they need no installation of it.

    Spark's own file server delivers the archive; executors that join later get it as well.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="gatehouse-"), "gatehouse.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(home):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(home)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
