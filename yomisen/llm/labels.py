"""Labelled documents for training: all of them, or a bounded sample for the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Power of two of the bits of the largest bitmap of ids (16 MB); with more ids than it suits, more texts are shuffled in vain.
MOST_BITS = 27
#: Bits of it that are made together.
SLICE_BITS = 1 << 20


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def labelled(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """``(doc_id, y)`` of every labelled id that meets ``train``; an id with both labels counts as 1, null labels are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & train)
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def spot_of(doc_id: Column) -> Column:
    """A hash of the id that decides where a labelled row goes."""
    return F.xxhash64(doc_id.cast("long"), F.lit("spot"))


def labelled_blocks(docs: DataFrame, known: DataFrame, n: int, train: Column, blocks: int) -> DataFrame:
    """``(block, spot, doc_id, y, text)`` of every row of :func:`labelled`, ``n`` of them, with each text of its id; each partition is one block.

    In a block, each id's row with its label (null text) comes before its texts (null
    label), the least first, so that :func:`first_texts` can join them; ids without a
    label may be among them.  Only texts that a bitmap of the labelled ids lets
    through are shuffled, once; the bitmap lets every labelled one through.
    """
    spark = docs.sparkSession
    size = 1 << min(max((16 * n).bit_length(), 13), MOST_BITS)
    low, high = F.col("spot").bitwiseAND(F.lit(size - 1)), F.shiftright("spot", 32).bitwiseAND(F.lit(size - 1))

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(min(size, SLICE_BITS), bool)
        bits[table.column("bit").to_numpy() % SLICE_BITS] = True
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    keyed = known.where(F.col("doc_id").isNotNull()).select(spot_of(F.col("doc_id")).alias("spot"), F.col("doc_id").cast("long"), "y")
    bits = keyed.select(F.explode(F.array(low, high)).alias("bit")).withColumn("slice", F.floor(F.col("bit") / SLICE_BITS))
    bitmap = np.zeros(size // 8, np.uint8)
    for r in bits.groupBy("slice").applyInArrow(pack, "slice long, bits binary").collect():
        part = np.frombuffer(r["bits"], np.uint8)
        bitmap[r["slice"] * SLICE_BITS // 8 :][: len(part)] = part
    shared = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def perhaps(spot: pa.Array) -> pa.Array:
        x = spot.to_numpy(zero_copy_only=False)
        found = [shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in (x & (size - 1), (x >> 32) & (size - 1))]
        return pa.array((found[0] & found[1]).astype(bool))

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & train)
    texts = texts.select(spot_of(F.col("doc_id")).alias("spot"), F.col("doc_id").cast("long"), F.lit(None).cast("int").alias("y"), "text")
    both = keyed.withColumn("text", F.lit(None).cast("string")).unionByName(texts.where(perhaps("spot")))
    block = F.pmod("spot", F.lit(blocks)).cast("int").alias("block")
    return both.select(block, "*").repartitionById(blocks, "block").sortWithinPartitions("spot", "doc_id", F.col("y").isNull(), "text")


def first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labelled texts of a block of :func:`labelled_blocks`: of each labelled id the text that follows its label."""
    last_id, last_y = 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id").to_numpy()
        y = pc.fill_null(batch.column("y"), -1).to_numpy(zero_copy_only=False)
        before, label = np.append(last_id, ids[:-1]), np.append(last_y, y[:-1])
        last_id, last_y = ids[-1], y[-1]
        batch = batch.set_column(batch.schema.get_field_index("y"), "y", pa.array(label.astype(np.int32)))
        yield batch.filter(pa.array((y < 0) & (label >= 0) & (before == ids)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Up to ``per_class`` texts of either label, and how many rows each label has in all.

    ``train`` is a condition on ``doc_id`` that training rows meet.  The rows are
    those with the least hash of the id, so they don't depend on order or size;
    null labels and rows without a document are left out; of rows with one doc_id the least text counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & train).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    ids: dict[int, int] = {}
    for y in (0, 1):
        top = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class).select("doc_id").collect()
        ids |= {r[0]: y for r in top}  # an id with both labels counts as the last
    if not ids:
        return [], counts
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["doc_id"], r["text"]) for r in rows)
    return [(text, ids[i]) for i, text in rows], counts
