"""Reliable checkpoints for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names (a temporary one only where that is unset and all runs in one process)."""
    context = spark.sparkContext._jsc.sc()
    at = spark.conf.get("spark.checkpoint.dir", None) or (context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None)
    if not at:
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint(eager=True)
