"""What a plan does, for tests and tuning: joins, exchanges, pushed filters and columns read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summary(df: DataFrame) -> dict[str, int]:
    """How often each kind of join, exchange, scan and Python step occurs."""
    plan = physical(df)
    names = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|Exchange|BroadcastExchange|FileScan|MapInArrow|Window|Generate)\b", plan)
    return {n: names.count(n) for n in sorted(set(names))}


def columns_read(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", physical(df))
