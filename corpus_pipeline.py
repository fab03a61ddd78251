"""A training-data pipeline of five of the text operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from yomisen.llm import decontaminate, exact_dedup, packing, quality, simhash
from yomisen.llm.common import ensure_checkpoint_dir


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    index = exact_dedup.new_index(spark, exact_dedup.buckets_for(docs))
    out = exact_dedup.drop_exact_duplicates(docs, index)
    index.drop()  # of this run alone
    return out


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles one document stays."""
    return simhash.drop_similar(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in training sequences; with the token ids."""
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("quality", _quality),
    ("exact_dedup", _exact),
    ("near_dedup", _near),
    ("decontaminate", _decontaminate),
    ("packing", _pack),
]

#: Stages 1, 3 and 4 can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again.

    A run that was given a ``name`` and failed goes on, under the same name, after
    the last stage that it finished.  What a stage has read is deleted once its
    own result is written.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{name or uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [k for k, (stage, _) in enumerate(STAGES[:-1]) if files.exists(path(f"{folder}/{stage}/_SUCCESS"))]
    first = max(done, default=-1) + 1
    docs = spark.read.parquet(f"{folder}/{STAGES[first - 1][0]}" if first else f"{sf_dir}/documents.parquet")
    for k, (stage, apply) in enumerate(STAGES[first:-1], first):
        apply(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{stage}")
        docs = spark.read.parquet(f"{folder}/{stage}")
        if k:
            files.delete(path(f"{folder}/{STAGES[k - 1][0]}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
