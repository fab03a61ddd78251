"""Dictionary generations: numbered folders of Parquet tables, published by one rename.

All file access goes through Hadoop's file system, so any store will do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.parse import Dictionary, build
from ..plans.grammar import Grammar, closure
from .grammar_json import fingerprint

FORMAT_VERSION = 3
NAME = re.compile(r"gen-(0|[1-9][0-9]*)\Z")
TABLES = ("lexicon", "entries", "meta")
ATTEMPTS = 8
KEEP = 2


class Unusable(ValueError):
    """A generation of another format version or grammar, or an incomplete one."""


def number_of(name: Column) -> Column:
    """The number of a generation's name, strictly written; else null."""
    digits = F.substring(name, F.lit(5), F.length(name))
    return F.when(name.rlike(r"\Agen-(0|[1-9][0-9]*)\z"), digits.try_cast("bigint"))


def latest(names: DataFrame) -> DataFrame:
    """``names(name)`` to the newest one."""
    n = number_of(F.col("name"))
    return names.where(n.isNotNull()).agg(F.max_by("name", n).alias("name"), F.max(n).alias("number"))


def listing(names: DataFrame) -> DataFrame:
    """Newest first, names that aren't generations last."""
    return names.select("name", number_of(F.col("name")).alias("number")).orderBy(F.desc_nulls_last("number"), "name")


def doomed(names: DataFrame, keep: int = KEEP) -> DataFrame:
    """What a sweep removes: builds left over, and all but the newest generations (at least one stays)."""
    n = number_of(F.col("name"))
    numbered = names.select("name", n.alias("number"))
    old = numbered.where("number IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("number"))))
    return old.where(F.col("k") > max(keep, 1)).select("name").union(numbered.where(F.startswith(F.col("name"), F.lit(".build-"))).select("name"))


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def folder_names(spark: SparkSession, root: str) -> list[str]:
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory())


def numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(m[1]) for n in folder_names(spark, root) if (m := NAME.match(n)))


def write(spark: SparkSession, root: str, dictionary: Dictionary, grammar_text: str) -> str:
    """Writes a build to a folder of its own and publishes it as the next generation; a number taken meanwhile is passed over."""
    fs, path = _fs(spark, root)
    part = f"{root}/.build-{uuid.uuid4().hex}"
    lex = dictionary.lexicon.repartitionByRange("key").sortWithinPartitions("key", "ord")
    lex.write.parquet(f"{part}/lexicon")
    dictionary.entries.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{part}/entries")
    counts = spark.read.parquet(f"{part}/lexicon").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("records"))
    entries = spark.read.parquet(f"{part}/entries").agg(F.count("*").alias("entries"))
    meta = counts.crossJoin(entries).withColumns({"version": F.lit(FORMAT_VERSION), "fingerprint": F.lit(f"{fingerprint(grammar_text):016x}")})
    meta.coalesce(1).write.parquet(f"{part}/meta")  # last: without it a build is incomplete
    for _ in range(ATTEMPTS):
        target = f"{root}/gen-{max(numbers(spark, root), default=-1) + 1}"
        if not fs.exists(path(target)) and fs.rename(path(part), path(target)):
            return target
    raise OSError(f"no free generation number in {root} after {ATTEMPTS} attempts")


def open_generation(spark: SparkSession, folder: str, grammar: Grammar, grammar_text: str) -> Dictionary:
    """A published generation; another format version, then another grammar, make it unusable."""
    fs, path = _fs(spark, folder)
    if not all(fs.exists(path(f"{folder}/{t}")) for t in TABLES):
        raise Unusable(f"{folder} is incomplete")
    meta = spark.read.parquet(f"{folder}/meta").first()
    if meta["version"] != FORMAT_VERSION:
        raise Unusable(f"{folder} has format version {meta['version']}, not {FORMAT_VERSION}")
    if meta["fingerprint"] != f"{fingerprint(grammar_text):016x}":
        raise Unusable(f"{folder} was built with another grammar")
    return Dictionary(spark.read.parquet(f"{folder}/lexicon"), spark.read.parquet(f"{folder}/entries"), grammar, closure(grammar))


def sweep(spark: SparkSession, root: str, keep: int = KEEP) -> list[str]:
    """Removes what :func:`doomed` names, and tells what it removed."""
    fs, path = _fs(spark, root)
    gone = []
    kept = set(numbers(spark, root)[-max(keep, 1) :])
    for name in folder_names(spark, root):
        m = NAME.match(name)
        if (m and int(m[1]) not in kept) or name.startswith(".build-"):
            fs.delete(path(f"{root}/{name}"), True)
            gone.append(name)
    return gone


def remove(spark: SparkSession, root: str, number: int) -> bool:
    """Removes one generation; an absent one is fine."""
    fs, path = _fs(spark, root)
    return bool(fs.delete(path(f"{root}/gen-{number}"), True))


def ensure(spark: SparkSession, root: str, grammar: Grammar, grammar_text: str, source: Callable[[], DataFrame], keep: int = KEEP) -> Dictionary:
    """Opens the newest generation; builds one from ``source()`` only if there is none that can be used.

    ``source`` is called only then, and gives raw entries.
    """
    found = numbers(spark, root)
    if found:
        try:
            return open_generation(spark, f"{root}/gen-{found[-1]}", grammar, grammar_text)
        except Unusable:
            pass
    folder = write(spark, root, build(source(), grammar), grammar_text)
    sweep(spark, root, keep)
    try:
        return open_generation(spark, folder, grammar, grammar_text)
    except Unusable:  # swept by another that published meanwhile: its generation serves as well
        return open_generation(spark, f"{root}/gen-{numbers(spark, root)[-1]}", grammar, grammar_text)
