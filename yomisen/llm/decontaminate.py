"""Benchmark decontamination by spaced-seed hashing.

A seed looks at fixed places of a window of tokens and ignores the others, so a
substituted token spoils only the seeds that look at it.  Training windows whose
hash under some mask is a benchmark window's are hits; around each hit the two
token sequences are laid side by side, and any stretch that is long and equal
enough (substituted tokens allowed) decides: the one that scores best if it is,
else the widest that is.

The benchmark is read in slices of a bounded size, each of which goes to the
executors once; documents are read where they lie, without a shuffle, whatever
passage is common.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, joined_buffer, range_of, texts_of

#: Fixed places looked at, the shortest first.  Together they hit every stretch that counts as an overlap: 12 equal tokens, 0.8 of
#: the stretch.  (A longer one splits into parts of 15 to 29 tokens, one of which counts too; those are enumerated in a test.)
MASKS = ("1111011", "1111101", "1100011011", "11010001011")
#: A stretch must have so many equal tokens (or ``LEAST_SHARE`` of a shorter item; all of one of under ``LEAST_ITEM`` tokens) ...
LEAST_TOKENS, LEAST_ITEM = 12, 8
#: Tokens from which an item is found by the masks; shorter ones by parts of theirs.
SEEDED_ITEM = 15
#: ... and so large a part of them equal.
LEAST_SHARE = 0.8
#: Elements of a table that holds an item against many places at once.
TABLE = 1 << 20
#: Bytes of benchmark text sent to the executors at a time.
SLICE_BYTES = 8 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: Scripts written without spaces: each character is a token.
_SINGLE = ((0x0E01, 0x0E5A), (0x0E81, 0x0EE0), (0x1000, 0x10A0), (0x1780, 0x17DE), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x323B0))
#: Of each code point: 0 between words, 1 in a word, 2 a word of its own.
_KIND = np.zeros(0x110000, np.uint8)
_KIND[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LMN"]] = 1
for _a, _b in _SINGLE:
    _KIND[_a:_b] = np.where(_KIND[_a:_b] > 0, 2, 0)
_RADIX = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def folded(data: bytes) -> np.ndarray:
    """The bytes with A-Z and the capitals of U+00C0 to U+00DE lower-cased."""
    raw = _FOLD[np.frombuffer(data, np.uint8)]
    capital = np.zeros(len(raw), np.uint8)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    return raw + capital * np.uint8(0x20)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 lie in words, and which begin a word that the byte before doesn't end."""
    word = _WORD[raw]
    single = np.zeros(len(raw), bool)
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return word, single
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    first = padded[lead]
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for i in range(1, 4):
        code = np.where(size > i, code << 6 | padded[lead + i] & 0x3F, code)
    kind = _KIND[np.minimum(code, 0x10FFFF)]
    gap = kind == 0
    for i in range(4):
        some = lead[gap & (size > i)] + i
        word[some[some < len(raw)]] = False
    alone = kind == 2
    single[lead[alone]] = True
    after = lead[alone] + size[alone]
    single[after[after < len(raw)]] = True
    return word, single


def token_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each token: a run of letters, marks and digits, capitals folded; an ideograph, kana or the like alone."""
    raw = folded(data)
    word, single = _words(raw)
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    first = np.flatnonzero(word & (~before | single))
    end = np.flatnonzero(word & (~after | np.concatenate([single[1:], [False]]))) + 1
    if not len(first):
        return np.zeros(0, np.uint64), first, end
    # each byte is weighed by a power of the radix, by its place in the token
    edges = np.concatenate([[0], first, [len(raw)]])
    place = np.arange(len(raw)) - np.repeat(edges[:-1], np.diff(edges))
    power = np.ones(max(2, int((end - first).max()) + 1), np.uint64)
    power[1:] = _RADIX
    power = np.multiply.accumulate(power)
    value = np.where(word, (raw.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)], np.uint64(0))
    h = np.add.reduceat(value, first)
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29)), first, end


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of tokens under a mask."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ tokens[i : i + n]) * _MIX
            h ^= h >> np.uint64(32)
    return h


def best_stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, start, end and equal tokens of the stretch with the largest score: 1 for an equal token, -2 for another."""
    rows, places = np.arange(len(equal)), np.arange(equal.shape[1] + 1)
    total = np.zeros((len(equal), equal.shape[1] + 1), np.int32)
    np.cumsum(np.where(equal, 1, -2), axis=1, out=total[:, 1:])
    least = np.minimum.accumulate(total, axis=1)
    end = np.argmax(total - least, axis=1)
    begins = (total == least[rows, end][:, None]) & (places <= end[:, None])
    start = len(places) - 1 - np.argmax(begins[:, ::-1], axis=1)
    count = np.zeros_like(total)
    np.cumsum(equal, axis=1, out=count[:, 1:])
    return start, end, count[rows, end] - count[rows, start]


def widest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with most equal tokens of those that are equal for ``LEAST_SHARE``, its ends being equal tokens."""
    share = round(LEAST_SHARE * 100)
    total = np.concatenate([[0], np.cumsum(np.where(equal, 100 - share, -share))])  # not less at the end than at the start: enough are equal
    start = np.searchsorted(-np.minimum.accumulate(total), -total, side="left")  # the first place with no larger total
    count = np.concatenate([[0], np.cumsum(equal)])
    end = int(np.argmax(count - count[start]))
    inside = np.flatnonzero(equal[start[end] : end]) + start[end]
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)


#: A hit is an item and a diagonal in one number.
_ITEM_BITS, _ZERO = 40, 1 << 39


def _pairs(h: np.ndarray, at: np.ndarray, hashes: np.ndarray, items: np.ndarray, places: np.ndarray) -> Iterator[np.ndarray]:
    """Hits of windows ``h`` that begin at ``at``, without repeats within some ``TABLE`` of them."""
    low, high = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
    hit = np.flatnonzero(high > low)
    low, n, at = low[hit], (high - low)[hit], at[hit]
    part = np.cumsum(n) // TABLE  # a repetitive text has many
    for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
        entry = range_of(low[some], n[some])
        yield np.unique((items[entry] << _ITEM_BITS) + np.repeat(at[some], n[some]) - places[entry] + _ZERO)


class Benchmark:
    """Seeds of benchmark items, sorted by hash."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in rows]
        self.tokens = [token_hashes(t)[0] for _, t in rows]
        hashes, items, places = [], [], []
        for k, tokens in enumerate(self.tokens):
            for mask in MASKS if len(tokens) >= SEEDED_ITEM else ():
                h = seeds(tokens, mask)
                hashes.append(h), items.append(np.full(len(h), k)), places.append(np.arange(len(h)))
        empty = [np.zeros(0, np.int64)]
        self.hashes = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        self.items, self.places = np.concatenate(items or empty), np.concatenate(places or empty)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.items, self.places = self.hashes[order], self.items[order], self.places[order]
        # shorter items are cut into one part more than tokens may differ, so that one part is whole: by its length, sorted hashes, items, places
        self.short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for k, tokens in enumerate(self.tokens):
            if 0 < len(tokens) < SEEDED_ITEM:
                n = len(tokens) - least_equal(len(tokens)) + 1
                cuts = [len(tokens) * i // n for i in range(n + 1)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    parts.setdefault(y - x, []).append((int(seeds(tokens[x:y], "1" * (y - x))[0]), k, x))
        for width, found in parts.items():
            found.sort()
            h, item, place = zip(*found, strict=True)
            self.short[width] = np.array(h, np.uint64), np.array(item), np.array(place)
        # a table of one bit for each hash's low 22 bits turns most windows away
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items, and where in the document their first token would lie (diagonals), without repeats."""
        found: list[np.ndarray] = []
        for mask in MASKS:
            h = seeds(tokens, mask)
            maybe = np.flatnonzero(self.filter[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            found += _pairs(h[maybe], maybe, self.hashes, self.items, self.places)
        for width, (hashes, items, places) in self.short.items():
            h = seeds(tokens, "1" * width)
            found += _pairs(h, np.arange(len(h)), hashes, items, places)
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both >> _ITEM_BITS, (both & (1 << _ITEM_BITS) - 1) - _ZERO

    def overlaps(self, tokens: np.ndarray, items: np.ndarray, diagonals: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        """Verified overlaps: number of the hit, item, first and end token, equal tokens, tokens of the item.

        Each hit is held against ``tokens[low:high]``, all hits of an item at once.
        """
        order = np.argsort(items, kind="stable")
        edges = np.flatnonzero(np.diff(items[order], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            k = int(items[order[a]])
            item = self.tokens[k]
            least = least_equal(len(item))
            step = max(1, TABLE // len(item))
            for at in range(a, b, step):
                hits = order[at : min(at + step, b)]
                place = diagonals[hits, None] + np.arange(len(item))
                inside = (place >= low[hits, None]) & (place < high[hits, None])
                equal = inside & (tokens[np.where(inside, place, 0)] == item)
                some = equal.sum(1) >= least
                hits, equal = hits[some], equal[some]
                if not len(hits):
                    continue
                start, end, n = best_stretches(equal)
                for i in np.flatnonzero((n < least) | (n < LEAST_SHARE * (end - start))).tolist():
                    start[i], end[i] = widest_stretch(equal[i])
                    n[i] = equal[i, start[i] : end[i]].sum()
                good = (n >= least) & (n >= LEAST_SHARE * (end - start))
                first = diagonals[hits] + start
                for hit, x, y, m in zip(*(v[good].tolist() for v in (hits, first, first + end - start, n)), strict=True):
                    yield hit, self.ids[k], x, y, m, len(item)


def least_equal(item_tokens: int) -> int:
    """Equal tokens that an overlap with an item of this length needs."""
    return item_tokens if item_tokens < LEAST_ITEM else min(LEAST_TOKENS, math.ceil(LEAST_SHARE * item_tokens - 1e-9))


OVERLAPS = "doc_id long, row long, item_id long, first_byte long, end_byte long, n_equal int, n_tokens int, item_tokens int"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each verified overlap of ``docs(doc_id, text)`` with ``benchmark(item_id, text)``.

    ``first_byte`` and ``end_byte`` bound it in the UTF-8 text; ``row`` is the
    text's hash, which tells texts with one doc_id apart.  Items of under 8 tokens
    must occur whole, of under 15 with 0.8 of their tokens; items without tokens and
    null or empty texts match nothing; of equally good stretches of a diagonal the
    last counts.  Repeated rows repeat their overlaps, repeated items too; texts
    and items of any length are read whole; other columns are ignored.
    """
    some = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    return reduce(DataFrame.union, [_overlaps_with(some, part) for part in _slices(benchmark)] or [_overlaps_with(some, [])])


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in lists of about ``SLICE_BYTES``, read one partition at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((row[0], row[1].encode()))
        size += len(held[-1][1]) + 100
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(bench: Benchmark, texts: list[bytes]) -> Iterator[tuple]:
    """Verified overlaps of some texts: number of the text, item, first byte, end byte, equal tokens, tokens, tokens of the item."""
    data, starts = joined_buffer([x + b" " for x in texts])
    tokens, first, end = token_hashes(data)
    items, diagonals = bench.hits(tokens)
    if not len(items):
        return
    edges = np.searchsorted(first, starts)
    length = np.array([len(x) for x in bench.tokens])
    # a diagonal may lie over the edge of a document: hold it against each that it touches
    low = np.searchsorted(edges, np.maximum(diagonals, 0), side="right") - 1
    high = np.minimum(np.searchsorted(edges, diagonals + length[items], side="left"), len(texts))
    times = np.maximum(high - low, 0)
    doc = range_of(low, times)
    items, diagonals = np.repeat(items, times), np.repeat(diagonals, times)
    found = bench.overlaps(tokens, items, diagonals, edges[doc], edges[doc + 1])
    for hit, item, a, b, n, total in found:
        d = int(doc[hit])
        yield d, item, int(first[a] - starts[d]), int(end[b - 1] - starts[d]), n, b - a, total


#: The last index that this worker has built, by the name of its rows.
_built: dict[str, Benchmark] = {}


def _shared(spark: SparkSession, rows: list[tuple[int, bytes]]) -> Broadcast:
    """The rows and a name of theirs, on every executor."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, rows))


def _index_of(shared: Broadcast) -> Benchmark:
    """The index of shared rows, built once in each worker."""
    name, rows = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(rows)
    return _built[name]


def _overlaps_with(some: DataFrame, rows: list[tuple[int, bytes]]) -> DataFrame:
    shared = _shared(some.sparkSession, rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _index_of(shared)
        names = [x.split()[0] for x in OVERLAPS.split(", ")]
        kinds = [*[pa.int64()] * 5, *[pa.int32()] * 3]
        for batch in batches:
            for part in chunks(batch):
                ids, row = part.column("doc_id").to_pylist(), part.column("row").to_pylist()
                if out := [(ids[d], row[d], *x) for d, *x in _found(bench, texts_of(part))]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return some.mapInArrow(find, OVERLAPS)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap: ``(doc_id, item_id, n_overlaps, n_equal, share)``.

    ``n_equal`` is the largest number of equal tokens of one overlap, ``share``
    its part of the item's tokens.  Rows with equal ids count as one document;
    empty tables, texts and items give no rows.
    """
    found = overlaps(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("first_byte").alias("n_overlaps"), F.max("n_equal").alias("n_equal"),
        F.max(F.col("n_equal") / F.col("item_tokens")).alias("share"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item, with their columns; a filter where they lie, without a shuffle.

    Rows with null or empty texts stay; repeated rows stay or go alike.
    """
    for rows in _slices(benchmark):
        docs = _without(docs, rows)
    return docs


def _without(docs: DataFrame, rows: list[tuple[int, bytes]]) -> DataFrame:
    shared = _shared(docs.sparkSession, rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _index_of(shared)
        for batch in batches:
            for part in chunks(batch):
                clean = np.ones(part.num_rows, bool)
                clean[[x[0] for x in _found(bench, texts_of(part))]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
