"""Session settings, the shared folder, and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on: AQE with skew-join splitting, Arrow transfer."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key also where that costs a further exchange after the join
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # cut top-k lists in the map tasks up to this k (the default stops at 1000)
        "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # what a Python worker is given at a time, however long the texts are
        "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (`spark.checkpoint.dir`).

    Only a session within one process and without the setting gets a folder of its own; a cluster must name one.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="densekit-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before, below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def pin(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back.

    Later uses see the very same rows, an executor lost in between costs nothing, and the table's
    size is known when a join is planned.
    """
    path = new_path(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
