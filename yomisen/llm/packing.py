"""Bounded-space online best-fit packing of tokenised documents.

Each packer keeps a fixed number of open bins, filed by free space; a bitset
with one bit per free space finds the tightest bin that still takes a piece with
two operations on an integer.  When one bin too many is open, the fullest is
closed for good.  Pieces are dealt evenly over packers by a hash of document and
piece (so a long document or hot source is spread).  A packer takes its pieces as
they come, in order of doc_id so that a task that is run again packs alike, and
looks a fixed number of pieces ahead: of those, the longest goes first.  That is
little beside what is open, and saves most of what strict order wastes.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, materialise, texts_of, unused

SEQUENCE = 2048
OPEN_BINS = 1024
#: Pieces that a packer sees before it places the longest of them.
LOOK_AHEAD = 2048
#: Tokens dealt to one packer on average, some 6,000 sequences.
PACKER_TOKENS = 12 << 20
END = 0
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _encoder(vocabulary: str, ranks: str):
    """A function from texts to lists of ids, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The ranks file holds the same vocabulary and merges for a faster library;
    texts with the special token's string go through the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_path(ranks), "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    exact = Tokenizer.from_file(tokenizer_path(vocabulary))

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut_points(n: int) -> list[tuple[int, int]]:
    """Start and end of each piece of n tokens: the first takes what whole sequences leave."""
    first = (n - 1) % SEQUENCE + 1
    edges = [0, *range(first, n + 1, SEQUENCE)]
    return list(zip(edges, edges[1:], strict=False))


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document's tokens and the closing id 0.

    Null and empty texts give one piece of one token.  ``with_ids`` adds the ids
    themselves, little-endian unsigned 32-bit, as ``ids``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks)
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                out: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True):
                    ids = np.array([*encode(text.decode()), END], "<u4")
                    for i, (a, b) in enumerate(cut_points(len(ids))):
                        data = ids[a:b].tobytes()
                        out.append((doc_id, i, a, b - a, zlib.crc32(data), *([data] * with_ids)))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    some = docs.select("doc_id", "text")
    return some.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


class Packer:
    """Open bins in a bitset keyed by free space."""

    def __init__(self, size: int = SEQUENCE, most_open: int = OPEN_BINS):
        self.size, self.most_open = size, most_open
        self.bits, self.n_open, self.next = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _file(self, number: int, free: int) -> None:
        if not free:
            return  # full: closed
        self.bins[free].append(number)
        self.bits |= 1 << free
        self.n_open += 1
        if self.n_open > self.most_open:  # the fullest closes
            self._take((self.bits & -self.bits).bit_length() - 1)

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece, and its place there."""
        fitting = self.bits >> length << length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.next, self.size
            self.next += 1
        self._file(number, free - length)
        return number, self.size - free


def place_block(bins: Packer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and places of pieces that a packer sees together, the longest first, of equal ones the first."""
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        numbers[i], offsets[i] = bins.place(int(lengths[i]))
    return numbers, offsets


def _blocks(batches: Iterator[pa.RecordBatch], packer: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows in order of packer, in blocks of ``LOOK_AHEAD`` rows of one packer at most."""
    held: list[pa.RecordBatch] = []
    n, current = 0, None

    def block() -> tuple[int, pa.RecordBatch]:
        return current, pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        which = batch.column(packer).to_numpy()
        at = 0
        while at < len(which):
            if which[at] != current or n == LOOK_AHEAD:
                if n:
                    yield block()
                held, n, current = [], 0, int(which[at])
            end = min(int(np.searchsorted(which, current, side="right")), at + LOOK_AHEAD - n)
            held.append(batch.slice(at, end - at))
            n, at = n + end - at, end
    if n:
        yield block()


def pack(cut: DataFrame, tokens: int | None = None, open_bins: int = OPEN_BINS, packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of :func:`pieces`; other columns stay.

    Sequence ids are unique numbers with gaps.  Offsets are gapless from 0.
    ``tokens`` is the sum of the lengths, counted if not given.  No length is null
    or over a sequence's; equal rows are packed as often as they come; no rows
    give none; columns of these two names mustn't be there.
    """
    if tokens is None:
        tokens = cut.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-tokens // packer_tokens))
    packer = unused(cut, "packer")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins = None, None
        for which, block in _blocks(batches, packer):
            if which != current:
                current, bins = which, Packer(most_open=open_bins)
            numbers, offsets = place_block(bins, block.column("length").to_numpy())
            rest = block.drop_columns([packer])
            names = [*rest.schema.names, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(numbers + (which << 32)), pa.array(offsets)], names=names)

    dealt = cut.withColumn(packer, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(packers)))
    dealt = dealt.repartitionByRange(packers, packer).sortWithinPartitions(packer, "doc_id", "piece", "ids_crc32", "length")
    return dealt.mapInArrow(fill, StructType([*cut.schema.fields]).add("sequence_id", "long").add("offset", "long"))


def packed(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of ``docs(doc_id, text)`` in sequences of at most 2048 tokens.

    One row per piece.  A null text is empty; empty texts take one token; a
    document of at most 2048 tokens is never cut; longer ones are, at any length;
    repeated rows are packed as often as they come; no rows give none; other columns
    are ignored.
    """
    return pack(materialise(pieces(docs, with_ids=with_ids)))
