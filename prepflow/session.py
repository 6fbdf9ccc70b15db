"""Spark session helpers.

The library never hard-codes cluster settings: a session handed in by the
caller is used as is.  ``get_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "prepflow") -> SparkSession:
    master = master or os.environ.get("PREPFLOW_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PREPFLOW_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _private_folder() -> str:
    path = tempfile.mkdtemp(prefix="prepflow-ckpt-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local master without the setting gets a private folder (tests), which
    goes with the process.  On a cluster executors could not see it, so there the
    setting must be made, on shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = configured or _private_folder()
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
