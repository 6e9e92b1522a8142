"""Tables that a job writes once and reads back, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, made: Iterable[str]) -> dict[str, str]:
    """Names for the columns of `df` on the way: plain name -> the caller's, without those named like a result.

    The plain names (own0, own1, ...) clash with none that an operator makes; names that differ in case only
    are one to Spark.
    """
    taken = {name.lower() for name in made}
    return {f"own{i}": c for i, c in enumerate(df.columns) if c.lower() not in taken}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that `spark.checkpoint.dir` names.

    Only a local master, as in tests, may leave that setting out.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` and read it back: cuts lineage, and survives the loss of any executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
