"""Minimum-cost segmentation of texts into dictionary words and unmatched runs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions.kana import DIGIT, IDEOGRAPH, KATAKANA

#: The costs of a path's steps.
SKIP_CHAR, SKIP_IDEOGRAPH = 100, 500
MATCH, BAD_START, BAD_END = 10, 10, 10
PARTICLE, SINGLE_CHAR, MID_NUMBER = -2, 1, 100
COMMON, COUNTER_AFTER_NUMBER, INEXACT = -3, -2, 10
NAME_BAD_CHAR, NAME_OK = 500, 5


#: Characters in one row of surroundings.
PIECE = 256
MID_NUMBER_BIT, AFTER_NUMBER_BIT, KATAKANA_BIT, KATAKANA_BEFORE_BIT, KATAKANA_AFTER_BIT, BITS = 1, 2, 4, 8, 16, 5


@lru_cache
def _members(pattern: str) -> np.ndarray:
    """Which code points of the basic plane a character class has."""
    own = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), pattern))
    return np.array([bool(own.match(chr(c))) for c in range(0x10000)])


def codes_of(text: str) -> np.ndarray:
    """Of each character what the costs ask of its surroundings, in bits, and above them how many up to here are not katakana.

    ``MID_NUMBER_BIT``: it and the one before are digits; ``AFTER_NUMBER_BIT``: the
    last character before it that is no space is a digit.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    known = np.minimum(points, 0xFFFF)  # U+FFFF is in no class
    digit, kata = _members(DIGIT)[known], _members(KATAKANA)[known]
    before = lambda x: np.append(False, x[:-1])
    space = (points == 0x20) | (points == 0x3000)
    last = np.maximum.accumulate(np.where(space, -1, np.arange(n)))
    after = before((last >= 0) & digit[np.maximum(last, 0)])
    out = np.cumsum(~kata).astype(np.int64) << BITS
    for bit, x in (
        (MID_NUMBER_BIT, digit & before(digit)), (AFTER_NUMBER_BIT, after), (KATAKANA_BIT, kata), (KATAKANA_BEFORE_BIT, before(kata)), (KATAKANA_AFTER_BIT, np.append(kata[1:], False)),
    ):
        out |= x.astype(np.int64) * bit
    return out


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            codes = codes_of(text or "")
            cuts = np.append(np.arange(0, len(codes), PIECE), len(codes)).astype(np.int32)
            parts = len(cuts) - 1
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(codes))
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * parts, pa.int64()), pa.array(range(parts), pa.int32()), lists], names=["doc_id", "part", "codes"])


def surroundings(texts: DataFrame) -> DataFrame:
    """``(doc_id, part, codes)``: :func:`codes_of` every ``PIECE`` characters; a text costs its length, and no window spans it."""
    return texts.select("doc_id", "text").mapInArrow(_surroundings, "doc_id long, part int, codes array<long>")


def match_cost(length: Column, flags: Column, inexact: Column, mid_number: Column, after_number: Column, isolated: Column, bad_start: Column, bad_end: Column) -> Column:
    """What a match adds to a path."""

    def when(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    has = lambda bit: fl.has_flag(flags, bit)
    shape = F.when(has(fl.PARTICLE), PARTICLE).when(length == 1, SINGLE_CHAR).when(mid_number, MID_NUMBER).otherwise(0)
    name = F.when(has(fl.IS_NAME), F.when(inexact | ~isolated, NAME_BAD_CHAR * length).otherwise(NAME_OK)).otherwise(0)
    return (
        F.lit(MATCH) + when(bad_start, BAD_START) + when(bad_end, BAD_END) + shape + when(has(fl.COMMON) | has(fl.COMMON_LINE), COMMON)
        + when(has(fl.COUNTER) & after_number, COUNTER_AFTER_NUMBER) + when(inexact, INEXACT) + name
    ).cast("long")


def scored(candidates: DataFrame, texts: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Adds ``cost`` and ``after_number`` to matches; ``hints(doc_id, pos, bad_start, bad_end)`` are optional."""
    at = surroundings(texts)
    part = lambda c: (F.floor(F.col(c) / PIECE)).cast("int")
    code = lambda c: F.get("codes", (F.col(c) % PIECE).cast("int"))
    joined = candidates.withColumn("last", F.col("start") + F.col("len") - 1)
    joined = joined.withColumn("part", part("start")).join(at, ["doc_id", "part"]).withColumn("begins", code("start")).drop("codes", "part")
    joined = joined.withColumn("part", part("last")).join(at, ["doc_id", "part"]).withColumn("ends", code("last")).drop("codes", "part")
    bit = lambda c, b: F.col(c).bitwiseAND(F.lit(b).cast("long")) != 0
    others = lambda c: F.shiftright(F.col(c), BITS)
    same = others("ends") == others("begins") - (~bit("begins", KATAKANA_BIT)).cast("long")  # nothing in between but katakana
    isolated = same & ~bit("begins", KATAKANA_BEFORE_BIT) & ~bit("ends", KATAKANA_AFTER_BIT)
    joined = joined.withColumns({"mid_number": bit("begins", MID_NUMBER_BIT), "after_number": bit("begins", AFTER_NUMBER_BIT)})
    if hints is None:
        joined = joined.withColumns({"bad_start": F.lit(False), "bad_end": F.lit(False)})
    else:
        s = hints.select("doc_id", F.col("pos").alias("start"), F.col("bad_start").alias("hs"))
        e = hints.select("doc_id", F.col("pos").alias("last"), F.col("bad_end").alias("he"))
        joined = joined.join(s, ["doc_id", "start"], "left").join(e, ["doc_id", "last"], "left")
        joined = joined.withColumns({"bad_start": F.coalesce("hs", F.lit(False)), "bad_end": F.coalesce("he", F.lit(False))}).drop("hs", "he")
    cost = match_cost(F.col("len"), F.col("flags"), F.col("inexact"), F.col("mid_number"), F.col("after_number"), isolated, F.col("bad_start"), F.col("bad_end"))
    return joined.select(*candidates.columns, "after_number", cost.alias("cost"))


def edges_of(matches: DataFrame) -> DataFrame:
    """The cheapest match for each start and length: all that a path can use."""
    return matches.groupBy("doc_id", "start", "len").agg(F.min("cost").alias("cost"))


def shortest(skips: list[int], edges: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, bool]]]:
    """Least cost, and the path as ``(start, length, matched)``, runs of skipped characters being one.

    ``edges`` are (end, length, cost).  At equal cost a match goes before a skip
    and a shorter last word before a longer.
    """
    n = len(skips)
    into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for end, length, cost in edges:
        into[end].append((length, cost))
    total, back = [0] * (n + 1), [(0, 0)] * (n + 1)
    for i in range(1, n + 1):
        best = (total[i - 1] + skips[i - 1], 1, 1)
        for length, cost in into[i]:
            best = min(best, (total[i - length] + cost, 0, length))
        total[i], back[i] = best[0], best[1:]
    path: list[tuple[int, int, bool]] = []
    i = n
    while i:
        skipped, length = back[i]
        i -= length
        if skipped and path and not path[-1][2]:
            path[-1] = (i, path[-1][1] + 1, False)
        else:
            path.append((i, length, not skipped))
    return total[n], path[::-1]


PATHS = "doc_id long, total_cost long, spans array<struct<start:int,len:int,matched:boolean,surface:string>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("edges")
        ends, lengths, added = (lists.values.field(c).to_pylist() for c in ("end", "len", "cost"))
        offsets = lists.offsets.to_pylist()
        costs, sizes, starts, lens, matched, surfaces = [], [0], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            text = text or ""
            a, b = offsets[i], offsets[i + 1]
            skips = [SKIP_IDEOGRAPH if "\u4e00" <= c <= "\u9fbf" else SKIP_CHAR for c in text]
            cost, path = shortest(skips, list(zip(ends[a:b], lengths[a:b], added[a:b], strict=True)))
            costs.append(cost)
            sizes.append(sizes[-1] + len(path))
            for start, n, is_match in path:
                starts.append(start)
                lens.append(n)
                matched.append(is_match)
                surfaces.append(text[start : start + n])
        span = pa.StructArray.from_arrays(
            [pa.array(starts, pa.int32()), pa.array(lens, pa.int32()), pa.array(matched, pa.bool_()), pa.array(surfaces, pa.string())], ["start", "len", "matched", "surface"]
        )
        found = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), span)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(costs, pa.int64()), found], names=["doc_id", "total_cost", "spans"])


def _skips(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.when(c.rlike(IDEOGRAPH), SKIP_IDEOGRAPH).otherwise(SKIP_CHAR))


def paths(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, total_cost, spans)`` of every text.

    One text's edges meet in one row: bounded by its length times the longest
    word.  The dynamic program runs in Arrow batches.
    """
    some = edges.groupBy("doc_id").agg(F.collect_list(F.struct((F.col("start") + F.col("len")).cast("int").alias("end"), F.col("len").cast("int").alias("len"), "cost")).alias("edges"))
    none = F.array().cast(some.schema["edges"].dataType)
    joined = texts.select("doc_id", "text").join(some, "doc_id", "left")
    return joined.withColumn("edges", F.coalesce("edges", none)).mapInArrow(_solve, PATHS)


def fold_costs(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, total_cost)`` by a fold in SQL expressions; for short texts, as appending is quadratic."""
    some = edges.groupBy("doc_id").agg(F.collect_list(F.struct((F.col("start") + F.col("len")).cast("int").alias("end"), F.col("len").cast("int").alias("len"), "cost")).alias("edges"))
    rows = texts.select("doc_id", _skips(F.col("text")).alias("skips")).join(some, "doc_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<end:int,len:int,cost:bigint>>")))
    fold = """aggregate(sequence(1, greatest(size(skips), 1)), array(0L), (acc, i) -> CASE WHEN i > size(skips) THEN acc ELSE concat(acc, array(array_min(concat(
        array(acc[i - 1] + skips[i - 1]), transform(filter(edges, e -> e.end = i), e -> acc[i - e.len] + e.cost))))) END)"""
    return rows.select("doc_id", F.element_at(F.expr(fold), -1).alias("total_cost"))


def spans(solved: DataFrame) -> DataFrame:
    """One row per span: ``(doc_id, start, len, matched, surface)``."""
    return solved.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def interior_hints(tokens: DataFrame, field: int = 7) -> DataFrame:
    """``(doc_id, pos, bad_start, bad_end)`` from ``tokens(doc_id, tok_start, tok_end, feature)``: no word should begin or end within a token.

    Only tokens with a reading (that field of the feature, not empty or ``*``) count.
    """
    reading = F.get(F.split("feature", ","), F.lit(field))
    some = tokens.where(reading.isNotNull() & ~reading.isin("", "*")).where("tok_end - tok_start >= 2")
    inner = some.select("doc_id", F.explode(F.sequence(F.col("tok_start"), F.col("tok_end") - 2)).alias("p"))
    both = inner.select("doc_id", F.col("p").alias("pos"), F.lit(False).alias("s"), F.lit(True).alias("e")).union(
        inner.select("doc_id", (F.col("p") + 1).alias("pos"), F.lit(True).alias("s"), F.lit(False).alias("e"))
    )
    return both.groupBy("doc_id", "pos").agg(F.bool_or("s").alias("bad_start"), F.bool_or("e").alias("bad_end"))
