"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import ensure_checkpoint_dir
from ..plans.store import stored as materialise

__all__ = ["ensure_checkpoint_dir", "materialise", "stored", "forget", "forget_checkpoint", "ascii_lower", "texts_of", "chunks", "joined_buffer", "with_text", "range_of", "unused"]

#: Bytes of text that a Python worker looks at together.
CHUNK_BYTES = 4 << 20


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder, columns compressed, and reads it again; returns its path too, for :func:`forget`."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget_checkpoint(df: DataFrame) -> None:
    """Deletes the files of a :func:`materialise` result that nothing reads any more."""
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        forget(df.sparkSession, path.get())


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` is much faster and agrees on pure ASCII."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def joined_buffer(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts in one buffer, and where each begins (with the end last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=starts[1:])
    return b"".join(texts), starts


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns and the text, null as empty."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def range_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` for each pair."""
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1], dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
