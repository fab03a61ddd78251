"""Text corpora, a sentence a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that hold no sentence: blank, or a comment.
NO_SENTENCE = r"\A\s*(?:#|\z)"


def is_sentence(line: Column) -> Column:
    return ~line.rlike(NO_SENTENCE)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)`` of a file's sentences, trimmed; ids keep their order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("text"))
    return lines.where(is_sentence(F.col("text")))


def sentences_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, line, text)``: the sentences of texts, with the number of their line from 0."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(is_sentence(F.col("text")))
