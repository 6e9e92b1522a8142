"""Session helpers shared by every job of the package."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local master gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    context.setCheckpointDir(_shared_root(spark))


def _shared_root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        # One process has no other machine to share with.
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="dqimpact-checkpoint-")
    return folder.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for a table that one job writes and the next one reads."""
    return f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise `df` in reliable storage, so that lost executors cannot change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
