"""Cutting long lineages through storage that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Of what is written in here, shuffle files go as soon as it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is configured, local mode gets one on this machine; a cluster, whose
    executors would each write to their own disk, gets an error."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a reliable checkpoint (survives executor loss) and continue from it."""
    ensure_checkpoint_dir(df.sparkSession)
    with released(df.sparkSession):
        return df.checkpoint(eager=True)
