"""Segmentation into plain words in one pass over the texts, for word lists that fit every worker.

An automaton of all keys finds every word of a text in order of where it ends,
which is the order in which the dynamic program wants them; nothing is shuffled.
A long text is cut where no word straddles, as every path passes there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions.kana import DIGIT, FOLD_FROM, FOLD_TO, KATAKANA, UNIFY_FROM, UNIFY_TO, strict_eq
from . import matching, segment

#: Bytes of words, as :func:`bytes_of` counts them, up to which they are sent to every worker.
MOST_BYTES = 32 << 20
#: Characters of a text that are solved together, if nothing straddles their end.
BLOCK = 1 << 16

_UNIFY, _FOLD = str.maketrans(UNIFY_FROM, UNIFY_TO), str.maketrans(FOLD_FROM, FOLD_TO)
_DIGIT, _KATAKANA = (re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), x)) for x in (DIGIT, KATAKANA))


@lru_cache(1 << 12)
def word_cost(length: int, flags: int, inexact: bool, mid_number: bool, after_number: bool, isolated: bool) -> int:
    """What :func:`segment.match_cost` gives without hints."""
    cost = segment.MATCH + (segment.INEXACT if inexact else 0)
    if flags & fl.PARTICLE:
        cost += segment.PARTICLE
    elif length == 1:
        cost += segment.SINGLE_CHAR
    elif mid_number:
        cost += segment.MID_NUMBER
    if flags & (fl.COMMON | fl.COMMON_LINE):
        cost += segment.COMMON
    if flags & fl.COUNTER and after_number:
        cost += segment.COUNTER_AFTER_NUMBER
    if flags & fl.IS_NAME:
        cost += segment.NAME_OK if isolated and not inexact else segment.NAME_BAD_CHAR * length
    return cost


class Words:
    """An automaton of keys, each with the folded surfaces and flags under it."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        import ahocorasick

        under: dict[str, set[tuple[str, int]]] = {}
        for key, surface, flags in rows:
            if key:
                under.setdefault(key, set()).add((surface.translate(_FOLD), flags))
        self.automaton = ahocorasick.Automaton()
        for key, some in under.items():
            self.automaton.add_word(key, (len(key), tuple(some)))
        self.longest = max(map(len, under), default=0)
        if under:
            self.automaton.make_automaton()

    def edges(self, text: str, unified: str, folded: str, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, cost) of the words that lie in ``[begin, end)``, in order of their end."""
        if not self.longest:
            return
        for last, (n, words) in self.automaton.iter(unified, begin, end):
            start = last + 1 - n
            source = folded[start : last + 1]
            mid = start > 0 and bool(_DIGIT.match(text[start])) and bool(_DIGIT.match(text[start - 1]))
            best = None
            for surface, flags in words:
                inexact = source != surface
                after = isolated = False
                if flags & fl.COUNTER:
                    after = self._after_number(text, start)
                if flags & fl.IS_NAME:
                    if inexact:
                        continue
                    isolated = self._isolated(text, start, last + 1)
                cost = word_cost(n, flags, inexact, mid, after, isolated)
                best = cost if best is None or cost < best else best
            if best is not None:
                yield last + 1, n, best

    @staticmethod
    def _after_number(text: str, start: int) -> bool:
        while start > 0 and text[start - 1] in " 　":
            start -= 1
        return start > 0 and bool(_DIGIT.match(text[start - 1]))

    @staticmethod
    def _isolated(text: str, start: int, end: int) -> bool:
        around = text[max(start - 1, 0) : start] + text[end : end + 1]
        return all(_KATAKANA.match(c) for c in text[start:end]) and not any(_KATAKANA.match(c) for c in around)


def _solve(skips: list[int], edges: list[tuple[int, int, int]], begin: int) -> tuple[int, list[tuple[int, int, bool]]]:
    """As :func:`segment.shortest`, for edges in order of their end; the path from ``begin``."""
    n = len(skips)
    total, back = [0] * (n + 1), [-1] * (n + 1)  # back: a word's length, or -1
    at = 0
    for end, length, cost in edges:
        i = end - begin
        while at < i:
            at += 1
            total[at] = total[at - 1] + skips[at - 1]
        cost += total[i - length]
        # at equal cost a word goes before a skip and a shorter one before a longer
        if cost < total[i] or (cost == total[i] and (back[i] < 0 or length < back[i])):
            total[i], back[i] = cost, length
    while at < n:
        at += 1
        total[at] = total[at - 1] + skips[at - 1]
    path: list[tuple[int, int, bool]] = []
    i = n
    while i:
        length = back[i]
        if length > 0:
            i -= length
            path.append((begin + i, length, True))
        else:
            j = i
            while j and back[j] < 0:
                j -= 1
            path.append((begin + j, i - j, False))
            i = j
    return total[n], path[::-1]


def solve_text(text: str, words: Words, block: int = BLOCK) -> tuple[int, list[tuple[int, int, bool]]]:
    """Least cost of a text, and the path as ``(start, length, matched)``."""
    unified, folded = text.translate(_UNIFY), text.translate(_FOLD)
    n, begin, size = len(text), 0, block
    cost, path = 0, []
    while begin < n:
        end = min(begin + size, n)
        edges = list(words.edges(text, unified, folded, begin, min(end + words.longest, n)))
        if end < n:
            straddled = np.zeros(end - begin + words.longest + 2, np.int32)
            ends = np.array([e for e, _, _ in edges], np.int64) - begin
            starts = ends - np.array([k for _, k, _ in edges], np.int64)
            np.add.at(straddled, starts + 1, 1)
            np.add.at(straddled, ends, -1)
            free = np.flatnonzero(np.cumsum(straddled)[1 : end - begin + 1] == 0)
            if not len(free):
                size *= 2
                continue
            end = begin + int(free[-1]) + 1
            edges = [x for x in edges if x[0] <= end]
        skips = [segment.SKIP_IDEOGRAPH if "一" <= c <= "龿" else segment.SKIP_CHAR for c in text[begin:end]]
        some, steps = _solve(skips, edges, begin)
        if path and steps and not path[-1][2] and not steps[0][2]:
            start, length, _ = path.pop()
            steps[0] = (start, length + steps[0][1], False)
        cost, begin, size = cost + some, end, block
        path += steps
    return cost, path


def bytes_of(words: DataFrame) -> int:
    """What ``words(key, surface)`` take in a worker, roughly."""
    each = F.octet_length("key") + F.octet_length("surface") + F.lit(200)
    return words.agg(F.sum(each.cast("long"))).first()[0] or 0


def paths_of_words(texts: DataFrame, words: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(doc_id, total_cost, spans)`` of every text, cut into ``words(key, key_chars, surface, flags, entry_id)``.

    Words of up to ``most_bytes`` go to every worker; more are joined.  Both give the same.
    """
    if bytes_of(words) > most_bytes:
        return _paths_by_join(texts, words)
    rows = [tuple(r) for r in words.select("key", "surface", "flags").distinct().collect()]
    shared = texts.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Words(shared.value)
        for batch in batches:
            costs, sizes, starts, lengths, matched, surfaces = [], [0], [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                cost, path = solve_text(text, automaton)
                costs.append(cost)
                sizes.append(sizes[-1] + len(path))
                if path:
                    a, b, c = zip(*path, strict=True)
                    starts += a
                    lengths += b
                    matched += c
                    surfaces += [text[x : x + y] for x, y in zip(a, b, strict=True)]
            span = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(matched, pa.bool_()), pa.array(surfaces, pa.string())], ["start", "len", "matched", "surface"]
            )
            found = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(costs, pa.int64()), found], names=["doc_id", "total_cost", "spans"])

    return texts.select("doc_id", "text").mapInArrow(run, segment.PATHS)


def _paths_by_join(texts: DataFrame, words: DataFrame) -> DataFrame:
    lengths = matching.key_lengths(words)
    probes = matching.probes(texts, lengths, prefixes=matching.key_prefixes(words, lengths))
    found = probes.where("len > 0").join(words.select("key", "surface", "flags", "entry_id"), "key")
    found = found.withColumn("inexact", ~strict_eq(F.col("source"), F.col("surface"))).where(~(F.col("inexact") & fl.has_flag(F.col("flags"), fl.IS_NAME)))
    some = found.select("doc_id", "start", "len", "flags", "inexact").distinct()
    return segment.paths(texts, segment.edges_of(segment.scored(some, texts)))
