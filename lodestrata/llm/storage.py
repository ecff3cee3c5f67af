"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a partition of a shuffle should have at most, about.
PARTITION_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> None:
    """Sees to it that checkpoints have a folder: the session's spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of the driver (tests) gets a folder of its own; a cluster
    must name one that all its machines share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder; a lost executor loses nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(df: DataFrame, size: int | None = None) -> int:
    """How many partitions a shuffle of df should have: the session's number, and more if its bytes (where known) need them."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PARTITION_BYTES + 1)
