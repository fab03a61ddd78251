"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text.
A batch is first reduced to one row per digest, the digests are then held
against the index with a sort-merge anti-join, for which the index is read in
its buckets without a shuffle (each append adds a sorted file to a bucket, so
from the second append on Spark sorts a bucket as it reads it), and the new
ones are appended under the batch's name.  A batch that failed after that and
is run again under its name isn't held against its own digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, unused

#: Digests of one bucket that a task sorts, some 100 MB.
BUCKET_ROWS = 1_000_000


def digest_of(text: Column) -> Column:
    """SHA-256, in lowercase hex, of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def buckets_for(docs: DataFrame, expected: int = 0) -> int:
    """Buckets for an index of ``expected`` texts, or of those of ``docs`` if they are more; as many as shuffles have at least."""
    rows = max(docs.count(), expected)
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def digested(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, digest)`` of every row of ``docs(doc_id, text)``, row telling rows apart."""
    return materialise(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest_of(docs["text"]).alias("digest")))


class DigestIndex:
    """Digests seen so far, with the doc_id that stays for each and the batch that brought it.

    ``buckets`` is fixed when the table is made; choose it by :func:`buckets_for`
    and the texts that are to come.  ``path`` is where a table outlives the
    session; a new session opens it again by the same name and path.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int, path: str | None = None):
        self.spark, self.table = spark, table
        if not spark.catalog.tableExists(table):
            where = f"LOCATION '{path}'" if path else ""
            spark.sql(
                f"CREATE TABLE {table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {where}"
            )
        self.buckets = buckets

    def drop(self) -> None:
        """Gives up the table; results of earlier calls don't need it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def digests(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame, batch: str) -> DataFrame:
        """The rows of ``groups(digest, ...)`` whose digest no other batch brought."""
        others = self.digests().where(F.col("batch") != batch)
        return groups.join(others.select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds ``groups(digest, keep_id)``, which other batches must not have brought; what this one brought before isn't added again."""
        own = self.digests().where(F.col("batch") == batch).select("digest")
        rows = groups.select("digest", F.col("keep_id").cast("bigint").alias("keep_id"), F.lit(batch).alias("batch"))
        rows = rows.join(own.hint("merge"), "digest", "left_anti").repartition(self.buckets, "digest")
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Deduplicates a batch ``rows(doc_id, row, digest)`` and appends what is new.

        Returns one line ``(digest, keep_id, keep_row, keep_rows, group_size,
        is_new)`` for each digest in it, keep_rows counting the rows with keep_id.
        Of equal texts in one batch the largest doc_id stays (a null only if there
        is no other; of rows with equal doc_id, one); where another batch brought the
        digest, is_new is false, keep_id is that batch's and nothing stays.  Run again
        under the same name with the same rows, a batch gets the same lines.
        """
        each = rows.groupBy("digest", "doc_id").agg(F.max("row").alias("row"), F.count("*").alias("n"))
        last = F.max(F.struct("doc_id", "row", "n")).alias("last")
        groups = each.groupBy("digest").agg(last, F.sum("n").alias("group_size"))
        last = [F.col(f"last.{x}").alias(y) for x, y in (("doc_id", "keep_id"), ("row", "keep_row"), ("n", "keep_rows"))]
        groups = materialise(groups.select("digest", *last, "group_size"))
        new = materialise(self.unseen(groups, batch))
        self.append(new, batch)
        known = self.digests().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"))
        seen = groups.join(known.hint("merge"), "digest").select("digest", F.col("known_id").alias("keep_id"), "keep_row", "keep_rows", "group_size")
        return materialise(new.withColumn("is_new", F.lit(True)).unionByName(seen.withColumn("is_new", F.lit(False))))


def new_index(spark: SparkSession, buckets: int) -> DigestIndex:
    """An empty index of its own, in the warehouse."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)


def by_falling_id(rows: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in batches of equal ranges of doc_id, the largest first; nulls are in the last."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if batches < 2 or low is None:
        return [rows]
    cuts = [None, *(high - (high - low) * i // batches for i in range(1, batches)), None]
    out = []
    for above, below in zip(cuts[1:], cuts, strict=False):
        some = F.lit(True) if above is None else F.col("doc_id") > above
        some = some if below is None else some & (F.col("doc_id") <= below)
        out.append(rows.where(some | F.col("doc_id").isNull() if above is None else some))
    return out


def exact_duplicates(docs: DataFrame, index: DigestIndex, batch: str = "", batches: int = 1) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs(doc_id, text)``.

    Null and empty texts are equal.  Each group of equal texts that the index
    lacks keeps one row, that with the largest doc_id; of rows with the same
    doc_id, one is kept.  ``batches`` adds the rows in so many batches one after
    another, large ids first, which gives the same.  No rows give none; other
    columns are ignored.
    """
    rows = digested(docs)
    groups = [index.add(some, f"{batch}/{i}") for i, some in enumerate(by_falling_id(rows, batches))]
    groups = groups[0] if len(groups) == 1 else _together(groups)
    # the key is computed on either side, so that both are dealt out anew and a hot digest can be split
    left = rows.select("doc_id", "row", F.lower("digest").alias("text_sha256"))
    right = groups.select(F.lower("digest").alias("text_sha256"), "keep_id", "keep_row", "group_size", "is_new")
    kept = (F.col("row") == F.col("keep_row")) & F.col("is_new")
    return left.join(right, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _together(groups: list[DataFrame]) -> DataFrame:
    """One line for each digest of several batches: of the batch that brought it, if one did."""
    every = groups[0]
    for more in groups[1:]:
        every = every.unionByName(more)
    brought = F.max(F.struct("is_new", "keep_row", "keep_id")).alias("x")
    every = every.groupBy("digest").agg(brought, F.sum("group_size").alias("group_size"))
    return materialise(every.select("digest", "x.keep_id", "x.keep_row", "group_size", "x.is_new"))


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex, batch: str = "") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one row for each text that no other batch brought to the index.

    Null and empty texts are equal, of equal texts the largest doc_id stays, of
    rows equal in both one; no rows give none.
    """
    groups = index.add(digested(docs), batch)
    key, keep, rows, digest = (unused(docs, x) for x in ("key", "keep", "rows", "digest"))
    keys = groups.where("is_new").select(F.col("digest").alias(key), F.col("keep_id").alias(keep), F.col("keep_rows").alias(rows))
    marked = docs.withColumn(digest, digest_of(docs["text"]))
    left = marked.join(keys, (F.lower(digest) == F.lower(key)) & F.col("doc_id").eqNullSafe(F.col(keep)))
    # of rows equal in doc_id and text one stays; only those are brought together
    single = left.where(F.col(rows) == 1).select(*marked.columns)
    repeated = left.where(F.col(rows) > 1).select(*marked.columns).dropDuplicates([digest])
    return single.unionByName(repeated).drop(digest)
