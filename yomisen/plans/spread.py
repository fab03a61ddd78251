"""Enough partitions for the cores there are."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame) -> DataFrame:
    """A table as scanned, dealt out anew only if its files give fewer partitions than there are cores.

    A small file with one row group is one task, however many cores wait; large
    inputs have partitions enough and are left as they lie.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.queryExecution().toRdd().getNumPartitions() >= cores else table.repartition(cores)
