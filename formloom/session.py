"""What all parts ask of a Spark session: the shared folder and the size of Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Used only by a local master whose session names no shared folder (single-machine runs and tests).
LOCAL_DEFAULT = "/tmp/checkpoints/formloom"
#: Rows and bytes of an Arrow batch at most, so that batches of whole texts or files stay small.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.

    Without that setting a local master gets ``LOCAL_DEFAULT``; any other is refused, as its
    executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, however long the texts or files in them are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
