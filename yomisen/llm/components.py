"""Connected components with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("key"), F.least("a", "m").alias("m"))
    # the key is computed on both sides of a join, so that both are dealt out anew and a hub can be split
    out = both.join(least, F.bitwise_not("a") == F.col("key")).where(F.col("b") > F.col("a"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    keyed = least.select(F.bitwise_not("a").alias("key"), "m")
    moved = edges.join(keyed, F.bitwise_not("a") == F.col("key")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``, root being the least node that each reaches.

    Alternating large-star and small-star rounds: every round is two joins on
    keys that Spark can split when skewed, the number of rounds grows with the
    logarithm of the longest path, and neither links nor nodes reach the driver
    (only a row count and a checksum do).  Self links and repeated links are
    allowed; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges)
    seen = None
    while True:
        edges = materialise(_small_star(_large_star(edges)).distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
