"""Dictionary matches at every position of every text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions.kana import strict_eq, unify


#: Positions of a piece of text.
PIECE = 128
#: Bytes of a lexicon that every worker may hold.
MOST_BYTES = 8 << 20


def key_lengths(lexicon: DataFrame) -> list[int]:
    """The lengths that keys have: a few dozen numbers, whatever the lexicon's size."""
    return sorted(r[0] for r in lexicon.select("key_chars").distinct().collect())


def key_prefixes(lexicon: DataFrame, lengths: list[int]) -> DataFrame:
    """``(prefix, lens)``: which lengths keys with the same first one or two characters have; empty keys are left out."""
    n = min([x for x in lengths if x][:1] + [2])
    some = lexicon.where("key_chars > 0").groupBy(F.substring("key", 1, n).alias("prefix"))
    return some.agg(F.collect_set("key_chars").alias("lens"))


def probes(texts: DataFrame, lengths: list[int], ahead: int = 0, prefixes: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start, len, source, key)``: every substring of ``texts(doc_id, text)`` with one of the lengths, start from 0.

    With ``ahead`` also ``behind``, up to that many characters that follow; with
    ``prefixes`` only lengths that keys with the same beginning have.  Reaching
    into a long text costs its length, so texts are first cut into overlapping
    pieces and only those into substrings.
    """
    most = max(lengths, default=0) + ahead
    n = F.length("text")
    bases = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    part = lambda c, b: F.substring(F.col(c), b + 1, F.lit(PIECE + most))
    cut = F.transform(bases, lambda b: F.struct(b.alias("base"), part("text", b).alias("piece"), part("u", b).alias("folded")))
    both = texts.select("doc_id", "text", unify(F.col("text")).alias("u"))
    piece = both.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")
    offsets = F.sequence(F.lit(0), F.least(F.length("piece"), F.lit(PIECE)) - 1)
    at = piece.select("doc_id", "base", "piece", "folded", F.explode(offsets).alias("offset"))
    lens = F.array(*map(F.lit, lengths))
    if prefixes is not None:
        size = min([x for x in lengths if x][:1] + [2])
        at = at.withColumn("prefix", F.substring(F.col("folded"), F.col("offset") + 1, F.lit(size)))
        at = at.join(prefixes, "prefix", "left" if 0 in lengths else "inner")
        lens = F.concat(F.coalesce("lens", F.array().cast("array<int>")), F.array(F.lit(0))) if 0 in lengths else F.col("lens")
    each = at.select("*", F.explode(lens).alias("len")).where(F.col("offset") + F.col("len") <= F.length("piece"))
    source, key = (F.substring(F.col(c), F.col("offset") + 1, F.col("len")) for c in ("piece", "folded"))
    more = [F.substring(F.col("piece"), F.col("offset") + F.col("len") + 1, F.lit(ahead)).alias("behind")] if ahead else []
    return each.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "len", source.alias("source"), key.alias("key"), *more)


def _measured(lexicon: DataFrame) -> dict[int, int]:
    """The lengths that keys have, and about how many bytes the records of each take."""
    size = F.octet_length("key") + F.octet_length("surface") + 128
    return {r[0]: r[1] for r in lexicon.groupBy("key_chars").agg(F.coalesce(F.sum(size), F.lit(0))).collect()}


def _held(records: DataFrame, size: int) -> DataFrame:
    """The lexicon's side of a join: measured and broadcast if small, else merged.

    Texts grow with their positions, which Spark's estimates don't see: left to itself it may broadcast them.
    """
    return F.broadcast(records) if size <= MOST_BYTES else records.hint("merge")


def prefix_hits(texts: DataFrame, lexicon: DataFrame, ahead: int = 0) -> DataFrame:
    """Records whose key begins at each position: ``(doc_id, start, key_chars, surface, flags, verb_type, entry_id, ord, inexact)``.

    An equi-join on the key; a lexicon of up to ``MOST_BYTES`` is broadcast, texts never are.
    Empty keys fit everywhere: their records go to every worker, as each makes a row of every position.
    """
    sizes = _measured(lexicon)
    lengths = sorted(n for n in sizes if n)
    records = lexicon.withColumnRenamed("key_chars", "len")
    joined = []
    if lengths or not sizes:
        size = sum(sizes[n] for n in lengths)
        found = probes(texts, lengths or [0], ahead, _held(key_prefixes(lexicon, lengths), size) if lengths else None)
        joined.append(found.join(_held(records.where("len > 0"), size), ["len", "key"]))
    if 0 in sizes:
        joined.append(probes(texts, [0], ahead).join(F.broadcast(records.where("len = 0")), ["len", "key"]))
    found = reduce(DataFrame.unionByName, joined)
    inexact = ~strict_eq(F.col("source"), F.col("surface"))
    more = ["behind"] if ahead else []
    return found.select("doc_id", "start", F.col("len").alias("key_chars"), "surface", "flags", "verb_type", "entry_id", "ord", inexact.alias("inexact"), *more)


def lookup(texts: DataFrame, lexicon: DataFrame, types: DataFrame, entries: DataFrame) -> DataFrame:
    """Records whose key begins each text, shortest first, with type, labels and the first sense's glosses."""
    head = prefix_hits(texts.select("doc_id", "text"), lexicon).where("start = 0")
    named = head.join(F.broadcast(types.select(F.col("type_id").alias("verb_type"), F.col("name").alias("type_name"))), "verb_type", "left")
    glosses = F.coalesce(F.array_join(F.get("senses", F.lit(0))["glosses"], "; "), F.lit(""))
    out = named.join(entries.select(F.col("id").alias("entry_id"), glosses.alias("glosses")), "entry_id", "left")
    return out.select("doc_id", "key_chars", "surface", F.coalesce("type_name", F.lit("-")).alias("type"), fl.lookup_labels(F.col("flags")).alias("labels"), F.coalesce("glosses", F.lit("")).alias("glosses"), "ord")


EMPTY_CHAIN = "array<struct<verb_type:int,tense:int,form:int,conj:int>>"


def matches(texts: DataFrame, lexicon: DataFrame, paths: DataFrame) -> DataFrame:
    """All candidate words: ``(doc_id, start, len, src_len, surface, flags, entry_id, inexact, chain, ord)``.

    Plain headwords as they are; stems with every conjugation path that
    continues in the text, one equi-join on type and the text behind.
    """
    lengths = sorted(r[0] for r in paths.select("n_chars").distinct().collect())  # a few dozen
    hits = prefix_hits(texts, lexicon, max(lengths, default=0) or 1)
    plain = hits.where("verb_type IS NULL").select(
        "doc_id", "start", F.col("key_chars").alias("len"), F.col("key_chars").alias("src_len"), "surface", "flags", "entry_id", "inexact",
        F.array().cast(EMPTY_CHAIN).alias("chain"), F.struct("key_chars", "ord", F.array().cast("array<int>").alias("path")).alias("ord"),
    )
    stem = hits.where("verb_type IS NOT NULL")
    reach = stem.select("*", F.explode(F.array(*map(F.lit, lengths or [0]))).alias("n")).where(F.col("n") <= F.length("behind"))
    reach = reach.withColumn("slice", F.substring(F.col("behind"), F.lit(1), F.col("n")))
    p = paths.select(F.col("type_id").alias("verb_type"), F.col("suffix_key").alias("slice_key"), "suffix_raw", "chain", F.col("ord").alias("path"))
    verbs = reach.withColumn("slice_key", unify(F.col("slice"))).join(p, ["verb_type", "slice_key"])
    inexact = F.col("inexact") | ~strict_eq(F.col("slice"), F.col("suffix_raw"))
    verbs = verbs.select(
        "doc_id", "start", (F.col("key_chars") + F.col("n")).alias("len"), F.col("key_chars").alias("src_len"), "surface", "flags", "entry_id",
        inexact.alias("inexact"), F.col("chain").cast(EMPTY_CHAIN).alias("chain"), F.struct("key_chars", "ord", "path").alias("ord"),
    )
    return dedupe(plain.unionByName(verbs))


def dedupe(candidates: DataFrame) -> DataFrame:
    """Candidates without those of no length and inexact names; of candidates that differ in exactness only, one, exact if any is."""
    kept = candidates.where((F.col("len") > 0) & ~(F.col("inexact") & fl.has_flag(F.col("flags"), fl.IS_NAME)))
    same = ["doc_id", "start", "len", "src_len", "surface", "flags", "entry_id", "chain"]
    return kept.groupBy(*same).agg(F.min("inexact").alias("inexact"), F.min("ord").alias("ord")).select(*same[:-1], "inexact", "chain", "ord")
