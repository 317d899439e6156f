"""Session helpers.

The library never creates a session inside an operator: every public function
takes DataFrames (or a session) from the caller.  ``local_session`` exists for
tests, the bench and ad-hoc use on one machine.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "riskframe", extra: dict | None = None) -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UTC, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RISKFRAME_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # plans here are built from hundreds of column expressions; capturing
        # the Python call site of each one costs more than the job itself
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session and used as is.  Only a
    one-machine session (master ``local`` or ``local[...]``: tests, the bench)
    may leave it unset; it then gets one scratch folder for its lifetime.  Any
    other master without the setting is refused, because a driver-local folder
    is not visible to executors.
    """
    context = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF, None)
    if path:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(path)
        return path
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"{CHECKPOINT_CONF} is not set: name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskframe-ckpt-"))
    return context.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); used between loop rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
