"""Cut a lineage at a reliable copy of an intermediate table."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints, which all executors share.

    A local session that names none (tests, a single machine) gets a folder of its own; a cluster
    must name one, as executors cannot read each other's disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (context.master or "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """`df`, worked out once and held by the executors for the jobs of the block."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held.count()
        yield held
    finally:
        held.unpersist()
