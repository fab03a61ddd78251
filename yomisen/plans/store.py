"""Steps that are computed once and kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, as it is.

    One of our own is made only where none is named and everything runs on this
    machine; on a cluster that would be a folder that executors can't see, an error.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="yomisen-checkpoint-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once with a reliable checkpoint, which also cuts the lineage; later steps read them there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
