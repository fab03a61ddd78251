"""Removal of byte strings that occur twice, by a run-length index.

Every 200-byte window of a text is named by the least hash among the 64-byte
strings in it, so equal windows have equal names wherever they start.  Windows
in a row with the same name make a *block* (its bytes are those that the windows
cover); each window lies in exactly one block and no other 200-byte string does.
Blocks whose name occurs once, and whose least 64-byte string does too, hold
nothing that repeats and go no further.

The distinct blocks of one name meet in one task.  There they become one text,
whose Burrows-Wheeler transform is run-length compressed and keeps the suffix
positions at both ends of each run.  The longest common prefix
with the neighbour in suffix order falls by exactly one from a text position to
the next unless a run begins (or ends) there, so these samples give the matching
statistics of the whole text in one pass: every position streams down from the
sampled position before it.  Windows whose statistic reaches 200 occur elsewhere.
A block that occurs whole more than once is kept once, with its count.

A name may have more distinct blocks than one index takes (the edges of a passage
that very many texts share).  They are divided by the least hash among the longer
strings in each window, the next of ``ANCHORS``; what a longer anchor still leaves
too full is divided by the one after it, down to whole windows, of which all of
one name are equal.  Most of a block falls away at each step (only windows that
hold the whole common string stay together), so rows stay in proportion to blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget, joined_buffer, materialise, range_of, stored, texts_of, with_text

LENGTH = 200
#: Lengths of the strings that name a window: the first for all windows, the others for names whose blocks overfill an index.
ANCHORS = (64, 166, 192, LENGTH)
#: Windows in a block at most; a longer run is cut, which loses nothing.
MOST_WINDOWS = 2048
#: Bytes of distinct blocks of one name in one index.
INDEX_BYTES = 1 << 18
#: Bytes of distinct blocks of several names that are indexed together.
TOGETHER_BYTES = 1 << 19
#: No UTF-8 text has this byte.
SEPARATOR = 0xFF

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x ^= b + _B
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _A
    x ^= x >> np.uint64(32)
    return x


def hashes_of_strings(data: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string of ``data`` (k >= 16), doubling the length step by step."""
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h, n = _mix(words[:-8], words[8:]), 16
    while n < k:
        step = min(n, k - n)
        h, n = _mix(h[:-step], h[step:]), n + step
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def blocks_of(texts: list[bytes], anchor: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, and of each block the text's number, place in the joined texts, windows, name, and whether it may repeat within itself."""
    data, starts = joined_buffer(texts)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, none, none, none, none.astype(np.uint64), none.astype(bool)
    hashes = hashes_of_strings(data, anchor)
    names = sliding_least(hashes, LENGTH - anchor + 1)
    n = len(names)
    inside = np.zeros(len(data) + 1, np.int32)  # windows that don't run over a text's end
    lengths = np.diff(starts)
    long_enough = lengths >= LENGTH
    np.add.at(inside, starts[:-1][long_enough], 1)
    np.add.at(inside, (starts[1:] - LENGTH + 1)[long_enough], -1)
    inside = np.cumsum(inside)[:n] > 0
    first = np.ones(n, bool)
    first[1:] = (names[1:] != names[:-1]) | (inside[1:] != inside[:-1])
    first[starts[:-1][starts[:-1] < n]] = True
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, n))
    at, count = at[inside[at]], count[inside[at]]
    pieces = -(-count // MOST_WINDOWS)
    if len(pieces) and pieces.max() > 1:
        shift = range_of(np.zeros(len(at), np.int64), pieces) * MOST_WINDOWS
        count = np.minimum(np.repeat(count, pieces) - shift, MOST_WINDOWS)
        at = np.repeat(at, pieces) + shift
    text = np.searchsorted(starts, at, side="right") - 1
    # where a window begins with its least string and the next has the same name, that string occurs twice
    left = np.append(0, np.cumsum(hashes[:n] == names))
    return data, text, at, count, names[at], left[at + count - 1] > left[at]


def text_key(doc_id: int | None, text: bytes) -> tuple[int, int]:
    """Two longs that name a row: equal rows have equal keys."""
    both = np.frombuffer(xxhash.xxh3_128_digest(f"{doc_id}:".encode() + text), np.int64)
    return int(both[0]), int(both[1])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _block_hashes(data: bytes, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    ends = (at + count + LENGTH - 1).tolist()
    return np.array([digest(data[a:b]) for a, b in zip(at.tolist(), ends, strict=True)], np.uint64)


BLOCKS = "ka long, kb long, at int, windows int, name long, block long, inner boolean"


def _scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    for batch in batches:
        for part in chunks(batch, limit=1 << 20):
            texts, ids = texts_of(part), part.column("doc_id").to_pylist()
            data, text, at, count, name, within = blocks_of(texts, ANCHORS[0])
            keys = np.array([text_key(i, t) for i, t in zip(ids, texts, strict=True)], np.int64).reshape(-1, 2)
            starts = joined_buffer(texts)[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[text, 0]), pa.array(keys[text, 1]), pa.array((at - starts[text]).astype(np.int32)),
                    pa.array(count.astype(np.int32)), _signed(name), _signed(_block_hashes(data, at, count)), pa.array(within),
                ],
                names=names,
            )


PIECES = "name long, block long, full boolean, bytes binary"


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted blocks of each text."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    out: list[tuple] = []
    for batch in batches:
        for text, wanted in zip(texts_of(batch), batch.column("wanted"), strict=True):
            for x in wanted.as_py():
                out.append((x["name"], x["block"], x["full"], text[x["at"] : x["at"] + x["windows"] + LENGTH - 1]))
                if len(out) == 10_000:
                    yield made(out)
                    out = []
    if out:
        yield made(out)


PARTS = "outer_name long, outer_block long, at int, windows int, name long, block long, inner boolean, bytes binary"


def _divide(anchor: int):
    """A function from blocks to the blocks that a longer anchor divides them into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARTS.split(", ")]
        for batch in batches:
            for part in chunks(batch, "bytes", 1 << 20):
                texts = texts_of(part, "bytes")
                data, text, at, count, name, inner = blocks_of(texts, anchor)
                # of the last anchor all windows of a block are equal: one stands for it
                block = _block_hashes(data, at, np.ones_like(count) if anchor == LENGTH else count)
                cut = [data[a:b] for a, b in zip(at.tolist(), (at + count + LENGTH - 1).tolist(), strict=True)]
                outer = [pa.array(part.column(x).to_numpy()[text]) for x in ("name", "block")]
                place = pa.array((at - joined_buffer(texts)[1][text]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*outer, place, pa.array(count.astype(np.int32)), _signed(name), _signed(block), pa.array(inner), pa.array(cut, pa.binary())], names=names
                )

    return run


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of bytes by prefix doubling, and each suffix's rank."""
    n = len(text)
    padded = np.concatenate([text, np.full(8, SEPARATOR, np.uint8)])
    key = np.ndarray(shape=(n,), dtype=">u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    depth = 8
    while True:
        tied = ~(new & np.append(new[1:], True))
        if not tied.any():
            return order, rank
        places = np.flatnonzero(tied)
        at = order[places]
        behind = at + depth
        # what runs over the end comes last, the shorter first
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], n + (n - at))
        key = rank[at].astype(np.uint64) * np.uint64(2 * n + 1) + second.astype(np.uint64)
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[places] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[places] |= fresh
        group = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[at] = group
        depth *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share."""
    n = len(text)
    padded = np.concatenate([text, np.arange(8, dtype=np.uint8)]).tobytes()
    words = np.ndarray(shape=(n,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero((a < n) & (b < n))
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        apart = words[i] ^ words[j]
        low = apart & (~apart + np.uint64(1))
        same = np.where(apart == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, n - np.maximum(i, j))
        out[live] += same
        live = live[same == 8]
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text, with suffix positions sampled at the ends of its runs."""

    def __init__(self, text: np.ndarray):
        self.size = n = len(text)
        order, _ = suffix_array(text)
        before = text[order - 1]  # of the suffix at 0 this is the last byte
        heads = np.ones(n, bool)
        heads[1:] = before[1:] != before[:-1]
        zero = int(np.flatnonzero(order == 0)[0])  # no suffix comes before the whole text: a run of its own
        heads[zero] = True
        if zero + 1 < n:
            heads[zero + 1] = True
        head = np.flatnonzero(heads)
        tail = np.append(head[1:], n) - 1
        self.letters, self.lengths = before[head], tail - head + 1
        up, down = head[head > 0], tail[tail < n - 1]
        self.head_sample, self.tail_sample = order[up], order[down]
        self.head_prefix = common_prefix(text, order[up], order[up - 1])
        self.tail_prefix = common_prefix(text, order[down], order[down + 1])
        self.edges = (int(order[0]), int(order[n - 1]))

    def _stream(self, samples: np.ndarray, prefixes: np.ndarray, bare: int) -> np.ndarray:
        at = np.append(samples, bare)  # the first (last) suffix has no neighbour on that side
        value = np.append(prefixes, 0)
        sort = np.argsort(at)
        at, value = at[sort], value[sort]
        which = np.searchsorted(at, np.arange(self.size), side="right") - 1
        out = np.where(which >= 0, value[which] - (np.arange(self.size) - at[which]), 0)
        return np.maximum(out, 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest string from there that also starts at another."""
        return np.maximum(
            self._stream(self.head_sample, self.head_prefix, self.edges[0]),
            self._stream(self.tail_sample, self.tail_prefix, self.edges[1]),
        )


MARKS = "name long, block long, first int, last int"


def repeated_windows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of distinct pieces that also start elsewhere in them: piece, first and last window."""
    if not pieces:
        return (np.zeros(0, np.int64),) * 3
    data, starts = joined_buffer([x + b"\xff" for x in pieces])
    text = np.frombuffer(data, np.uint8)
    long = RunLengthIndex(text).matching_statistics() >= LENGTH
    windows = np.diff(starts) - LENGTH  # without the separator
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, starts[:-1], 1)
    np.add.at(inside, starts[:-1] + windows, -1)
    hit = (long & (np.cumsum(inside)[:-1] > 0)).astype(np.int8)
    edge = np.diff(hit, prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    piece = np.searchsorted(starts, first, side="right") - 1
    return piece, first - starts[piece], last - starts[piece]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of name to runs of their windows that repeat."""
    names = [x.split()[0] for x in MARKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    held: dict[tuple, bytes] = {}
    size = 0

    def found() -> pa.RecordBatch:
        keys = list(held)
        piece, first, last = repeated_windows(list(held.values()))
        out = [(*keys[p], a, b) for p, a, b in zip(piece.tolist(), first.tolist(), last.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

    before = None
    for batch in batches:
        for name, block, data in zip(*(batch.column(x).to_pylist() for x in ("name", "block", "bytes")), strict=True):
            if name != before and size > TOGETHER_BYTES:
                yield found()
                held, size = {}, 0
            before = name
            if (name, block) not in held:  # equal rows of the input give a block twice
                held[name, block] = data
                size += len(data)
    yield found()


def _row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            ids, texts = part.column("doc_id").to_pylist(), texts_of(part)
            keys = np.array([text_key(i, t) for i, t in zip(ids, texts, strict=True)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                names=["doc_id", "text", "ka", "kb"],
            )


def marked_spans(marks: list[dict]) -> list[tuple[int, int]]:
    """Maximal byte runs that the marked windows cover, from runs of windows."""
    spans: list[tuple[int, int]] = []
    for x in sorted((m["first"], m["last"] + LENGTH) for m in marks):
        if spans and x[0] <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], x[1]))
        else:
            spans.append(x)
    return spans


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            ids, texts, kept, counts = part.column("doc_id"), texts_of(part), [], []
            for text, marks in zip(texts, part.column("marks").to_pylist(), strict=True):
                spans = marked_spans(marks or [])
                cuts = [0, *(x for span in spans for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                counts.append((len(text), len(text) - len(kept[-1]), len(spans)))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def _shifted(at: str) -> Column:
    """``runs`` of a block, from where ``at`` says that it begins."""
    return F.transform("runs", lambda r: F.struct((F.col(at) + r["first"]).alias("first"), (F.col(at) + r["last"]).alias("last")))


def _whole(blocks: DataFrame) -> DataFrame:
    """All windows of ``blocks(name, block, windows)``."""
    return blocks.select("name", "block", F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))).alias("runs"))


def _varied(distinct: DataFrame, index_bytes: int) -> DataFrame:
    """Names of ``distinct(name, windows, inner)`` that an index must look into, negated, and whether they overfill one.

    Keys of joins are computed anew on both sides, here and below, so that both
    are dealt out anew and hot ones can be split.
    """
    size = F.sum(F.col("windows") + F.lit(LENGTH - 1))
    names = distinct.groupBy("name").agg(F.count("*").alias("n"), F.bool_or("inner").alias("within"), size.alias("size")).where("n > 1 OR within")
    return names.select(F.negate("name").alias("less"), (F.col("size") > index_bytes).alias("full"))


def _runs(pieces: DataFrame, level: int, index_bytes: int, paths: list[str]) -> DataFrame:
    """``pieces(name, block, full, bytes)``, distinct blocks, to their runs of windows that recur: ``(name, block, runs)``."""
    few = pieces.where("not full").select("name", "block", "bytes").repartition("name").sortWithinPartitions("name", "block")
    # the runs of a block in one row: as many as it has windows at most
    out = few.mapInArrow(_search, MARKS).groupBy("name", "block").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    full = pieces.where("full").select("name", "block", "bytes")
    return out if full.isEmpty() else out.union(_divided(full, level + 1, index_bytes, paths))


def _divided(full: DataFrame, level: int, index_bytes: int, paths: list[str]) -> DataFrame:
    """As :func:`_runs`, for blocks of names that overfill an index."""
    parts, path = stored(full.mapInArrow(_divide(ANCHORS[level]), PARTS))
    paths.append(path)
    if ANCHORS[level] == LENGTH:
        found = _whole(parts.groupBy("name", "block").agg(F.sum("windows").alias("n"), F.max("windows").alias("windows")).where("n > 1"))
        runs = F.array(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("windows") - 1).alias("last")))
    else:
        of_block = (F.count("*").alias("n"), F.max("windows").alias("windows"), F.bool_or("inner").alias("inner"), F.min("bytes").alias("bytes"))
        distinct, path = stored(parts.groupBy("name", "block").agg(*of_block))
        paths.append(path)
        pieces, path = stored(distinct.join(_varied(distinct, index_bytes), F.negate("name") == F.col("less")).select("name", "block", "full", "bytes"))
        paths.append(path)
        found = _whole(distinct.where("n > 1")).union(_runs(pieces, level, index_bytes, paths))
        runs = _shifted("at")
    found = found.select(F.struct("name", "block").alias("marked"), "runs")
    outer = parts.drop("bytes").join(found, F.struct("name", "block") == F.col("marked"))
    outer = outer.select(F.col("outer_name").alias("name"), F.col("outer_block").alias("block"), runs.alias("runs"))
    return outer.groupBy("name", "block").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def find_repeats(docs: DataFrame, index_bytes: int = INDEX_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows ``(doc_id, text, ka, kb)`` and their marks ``(ma, mb, marks)``: runs ``(first, last)`` of windows that also start elsewhere.

    Rows equal in doc_id and text share ``(ka, kb)`` and one row of marks.
    ``index_bytes`` bounds the blocks of one name in one index; results don't depend on it.
    """
    spark = docs.sparkSession
    some = with_text(docs, "doc_id")
    keyed = some.mapInArrow(_row_keys, some.select("doc_id", "text").schema.add("ka", "long").add("kb", "long"))
    blocks, path = stored(some.mapInArrow(_scan_blocks, BLOCKS))
    names = blocks.groupBy("name").agg(F.count("*").alias("n"), F.bool_or("inner").alias("within")).where("n > 1 OR within")
    shared, shared_path = stored(blocks.join(names.select(F.negate("name").alias("less")), F.negate("name") == F.col("less")).drop("less"))
    forget(spark, path)
    one = F.min(F.struct("ka", "kb", "at", "windows")).alias("one")
    distinct = materialise(
        shared.groupBy("name", "block").agg(F.count("*").alias("n"), F.bool_or("inner").alias("inner"), one)
        .select("name", "block", "n", "inner", "one", F.col("one.windows").alias("windows"))
    )
    wanted = distinct.join(_varied(distinct, index_bytes), F.negate("name") == F.col("less")).select(
        F.col("one.ka").alias("wa"), F.col("one.kb").alias("wb"), F.struct("one.at", "windows", "name", "block", "full").alias("x")
    )
    wanted = wanted.groupBy("wa", "wb").agg(F.collect_list("x").alias("wanted"))  # of one text: bounded by its length
    cut = keyed.join(wanted, (F.col("ka") == F.col("wa")) & (F.col("kb") == F.col("wb"))).select("text", "wanted")
    pieces, path = stored(cut.mapInArrow(_cut_blocks, PIECES))
    paths = [path, shared_path]
    runs = _whole(distinct.where("n > 1")).union(_runs(pieces, 0, index_bytes, paths))
    runs = materialise(runs.select(F.struct("name", "block").alias("marked"), "runs"))
    found = shared.join(runs, F.struct("name", "block") == F.col("marked")).select("ka", "kb", _shifted("at").alias("runs"))
    # a set: equal rows of the input have equal marks
    marks = found.groupBy(F.col("ka").alias("ma"), F.col("kb").alias("mb")).agg(F.flatten(F.collect_set("runs")).alias("marks"))
    marks = materialise(marks)
    for path in paths:
        forget(spark, path)
    return keyed, marks


def cut_repeats(docs: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` of every row, ``kept`` being the bytes left.

    A byte goes if a 200-byte string over it also starts anywhere else, in the
    same text or another; matches never cross texts.  Null counts as empty; texts
    under 200 bytes stay whole; equal rows lose everything from 200 bytes on;
    ``kept`` may begin or end within a character; texts of any length are taken
    whole; no rows give none; other columns are ignored.
    """
    keyed, marks = find_repeats(docs, index_bytes)
    rows = keyed.join(marks, (F.col("ka") == F.col("ma")) & (F.col("kb") == F.col("mb")), "left")
    return rows.select("doc_id", "text", "marks").mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_report(docs: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """As :func:`cut_repeats`, with the SHA-256 of the bytes left in place of them."""
    cut = cut_repeats(docs, index_bytes)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
