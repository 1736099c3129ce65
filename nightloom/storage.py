"""Rows that several parts of a plan read, stored once in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and one machine runs all."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="nightloom-stored-"))
    return named or context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder; they survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
