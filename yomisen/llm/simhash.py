"""Near-duplicate detection: SimHash fingerprints linked by pigeonring filtering.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments on a ring.  If two
fingerprints differ in at most ``DISTANCE`` bits, then for some start the
differences summed over the first l segments from there stay within
``l * DISTANCE / SEGMENTS`` for every l (the pigeonring principle).  With 8
segments and distance 2 the budgets are 0, 0, 0, 1, 1, 1, 1, 2: three segments
agree, and of the next four at least one half agrees.  So each fingerprint is
filed under 16 exact keys of 40 bits (8 starts, 2 halves).  Those that share a key
are filed anew under 9 longer keys of 56 bits that the rest of the chain allows;
candidates meet there, at most 256 in a file, and the whole chain of budgets is
tested before the full Hamming distance.

:func:`drop_similar` finds pairs that are further apart: all but 0.2 of whose
five-word shingles are shared, which moves some ten of 64 bits.  Shingles make a
wide fingerprint, the words themselves, which an edit moves much less, several
short ones.  Chains over the short ones bring candidates together; the full
Hamming distance of the wide ones decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import chunks, materialise, texts_of, unused, with_text
from .components import components

SHINGLE_WORDS = 3
SEED = 42
SEGMENTS = 8
SEGMENT_BITS = 64 // SEGMENTS
DISTANCE = 2
#: Fingerprints in one file at most: eight bits are left open.
FILE_SIZE = 256
#: For drop_similar: words of a shingle, 64-bit words of the wide fingerprint, short fingerprints, and the distance that their chains allow.
SIMILAR_WORDS, WIDE, SHORT, SHORT_DISTANCE = 5, 8, 3, 8
#: Fingerprints of a key that a task holds against the others at a time.
BLOCK = 1024
#: Steps along links to hubs that tell which nodes needn't be held against each other.
ROUNDS = 4


PRINTS = [*(f"w{i}" for i in range(WIDE)), *(f"s{i}" for i in range(SHORT))]
#: Odd multipliers that mix a hash anew.
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 for i in range(WIDE + 1)], np.uint64)


def fingerprint(data: bytes) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number; no words give 0."""
    words = data.lower().split()  # of bytes: A-Z only, and white space is space and 09-0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            prints = np.array([fingerprint(x) for x in texts_of(part)], dtype=np.uint64).view(np.int64)
            rest = [part.column(i) for i, name in enumerate(part.schema.names) if name != "text"]
            names = [name for name in part.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(prints)], names=[*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, hash, fp)`` of every row: fp has the fingerprint's bits as a signed long, hash tells texts of one doc_id apart."""
    some = with_text(docs, "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), "text")
    schema = StructType([some.schema["doc_id"]]).add("hash", LongType()).add("fp", LongType())
    return some.mapInArrow(_fingerprints, schema)


def budget(length: int, distance: int = DISTANCE) -> int:
    """Differing bits allowed in the first ``length`` segments of a chain."""
    return length * distance // SEGMENTS


def _turned(fp: Column, start: int) -> Column:
    """The ring turned so that segment ``start`` is on top."""
    n = start * SEGMENT_BITS
    return fp if not n else F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, 64 - n))


def _keys(fp: Column) -> Column:
    """The 16 exact keys, tagged with chain start and half."""
    out = []
    for start in range(SEGMENTS):
        ring = _turned(fp, start)
        first = F.shiftrightunsigned(ring, 24)
        second = F.shiftleft(F.shiftrightunsigned(ring, 40), 16).bitwiseOR(
            F.shiftrightunsigned(ring, 8).bitwiseAND(F.lit(0xFFFF))
        )
        out += [F.lit((2 * start + half) << 40).bitwiseOR(x) for half, x in enumerate((first, second))]
    return F.array(*out)


def _ring(bits: Column, start: Column) -> Column:
    """As :func:`_turned`, for a start that is a column."""
    turn = (start * SEGMENT_BITS).cast("int")
    below = F.when(turn == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", bits, 64 - turn))
    return F.call_function("shiftleft", bits, turn).bitwiseOR(below)


def _files(fp: Column, key: Column) -> Column:
    """The 9 files of a fingerprint under a key: the pair of segments that may differ agrees, or one of it, half the other and half the last."""
    tag = F.shiftrightunsigned(key, 40)
    ring = _ring(fp, F.shiftrightunsigned(tag, 1))
    pair = F.when(tag.bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned(ring, 8)).otherwise(F.shiftrightunsigned(ring, 24))

    def part(x: Column, at: int, bits: int) -> Column:
        return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    out = [part(pair, 0, 16)]
    for which in (0, 8):
        for half in (0, 4):
            for last in (0, 4):
                value = F.shiftleft(part(pair, which, 8), 8).bitwiseOR(F.shiftleft(part(pair, 8 - which + half, 4), 4)).bitwiseOR(part(ring, last, 4))
                out.append(F.lit(len(out) << 16).cast("long").bitwiseOR(value))
    return F.array(*out)


def _within(a: Column, b: Column, start: Column, distance: int = DISTANCE) -> Column:
    """Chain budgets from this start, then the whole distance."""
    apart = a.bitwiseXOR(b)
    ring = _ring(apart, start)
    ok = F.lit(True)
    for length in range(1, SEGMENTS):
        ok = ok & (F.bit_count(F.shiftrightunsigned(ring, 64 - length * SEGMENT_BITS)) <= budget(length, distance))
    return ok & (F.bit_count(apart) <= distance)


def _met(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed(key, ...)`` whose key is not theirs alone."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.negate("key").alias("less"))
    # keys are computed anew on both sides, so that both are dealt out anew and a hot one can be split
    return keyed.join(several, F.negate("key") == F.col("less")).drop("less")


def links_of(prints: DataFrame) -> DataFrame:
    """``prints(fp)``, distinct, to all links ``(a, b)`` within the distance.

    A file leaves eight bits open, so it has ``FILE_SIZE`` fingerprints at most
    and each of them 36 partners, however many texts are alike.
    """
    met = _met(prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key")))
    filed = met.select("fp", "key", F.explode(_files(F.col("fp"), F.col("key"))).alias("file"))
    files = filed.groupBy("key", "file").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    start = F.shiftrightunsigned("key", 41)
    partners = F.transform(
        "fps",
        lambda a, i: F.struct(a.alias("a"), F.filter(F.slice(F.col("fps"), i + 2, FILE_SIZE), lambda b: _within(a, b, start)).alias("bs")),
    )
    return files.select(F.explode(partners).alias("x")).select("x.a", F.explode("x.bs").alias("b")).distinct()


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`fingerprints`, and ``(fingerprint, least)`` with the first row of each one's component."""
    rows = materialise(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "hash")
    groups = materialise(rows.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links_of(groups.select("fp"))).select(F.col("node").alias("fp"), "root")
    roots = materialise(roots.union(roots.select(F.col("root").alias("fp"), "root").distinct()))
    linked = groups.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    placed = linked.join(least, "root").select("fp", "least")
    named = groups.join(placed, "fp", "left").select(_hex(F.col("fp")).alias("fingerprint"), F.coalesce("least", "first").alias("least"))
    return rows, materialise(named)


def _rows_with_least(docs: DataFrame) -> DataFrame:
    rows, named = _components(docs)
    # both sides compute the key anew, so that both are dealt out anew and a hot one can be split
    return rows.select("doc_id", "hash", _hex(F.col("fp")).alias("fingerprint")).join(named, "fingerprint", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links reach.  Null and empty
    texts have fingerprint zero and are linked like any other; a null doc_id is
    never a component's id unless the component has no other; repeated rows are
    reported as often as they come; texts of any length are read whole; no rows
    give none; other columns are ignored.
    """
    return _rows_with_least(docs).select("doc_id", "fingerprint", F.col("least.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each component: its smallest doc_id stays.

    Of one doc_id with several texts the one with the least text hash stays;
    rows equal in doc_id and text are one document and stay or go together.
    """
    return _without(docs, _rows_with_least(docs))


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` but for the rows of ``found(doc_id, hash, least)`` that aren't their group's first."""
    goes = found.where(~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("hash") == F.col("least.hash"))))
    id_, hash_ = unused(docs, "id"), unused(docs, "hash")
    goes = goes.select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_)).distinct()
    here = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(goes, docs["doc_id"].eqNullSafe(F.col(id_)) & (here == F.col(hash_)), "left_anti")


def _spread_bits(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` 64-bit fingerprints of hashed features: each hash is mixed anew for each."""
    counts = np.zeros((n, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14), None] * _ODD[None, :n]
        some ^= some >> np.uint64(32)
        some *= _ODD[None, 1 : n + 1]
        some ^= some >> np.uint64(29)
        counts += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(len(some), n, 8), axis=2).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), axis=1).reshape(n, 8).view(">u8").ravel().astype(np.uint64)


def wide_prints(data: bytes, words: int = SIMILAR_WORDS) -> np.ndarray:
    """``WIDE`` words of a fingerprint of the distinct shingles, then ``SHORT`` fingerprints of the distinct words; no words give zeros."""
    found = data.lower().split()
    if not found:
        return np.zeros(WIDE + SHORT, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    runs = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    shingles = np.unique(np.array([digest(b" ".join(x)) for x in runs], np.uint64))
    single = np.array([digest(x) for x in set(found)], np.uint64)
    return np.concatenate([_spread_bits(shingles, WIDE), _spread_bits(single, SHORT)])


def wide_distance(similarity: float) -> int:
    """Differing bits of a wide fingerprint that sets of this Jaccard similarity exceed one time in six.

    Their cosine is 2s / (1 + s), and a bit differs with the angle's share of a half turn.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * WIDE
    return int(bits * share + np.sqrt(bits * share * (1 - share)))


def _wide(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                prints = np.array([wide_prints(x, words) for x in texts_of(part)], np.uint64).reshape(-1, WIDE + SHORT).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(prints[:, i])) for i in range(WIDE + SHORT)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), *columns], names=["doc_id", "hash", *PRINTS])

    return run


def _similar_keys(i: int) -> Column:
    """The 16 keys of a short fingerprint, tagged with its number, chain start and half."""
    return F.transform(_keys(F.col(f"s{i}")), lambda k: k.bitwiseOR(F.lit(i << 44).cast("long")))


def _wide_apart() -> Column:
    return sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"w{i}_"))) for i in range(WIDE)), F.lit(0))


def similar_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """``nodes(node, w0.., s0..)`` to links ``(a, b)`` whose components are those of all similar pairs.

    Two nodes are similar if they share a key of a short fingerprint, keep to the chain
    budgets from there and the distance of the wide fingerprints.  Those that
    share a key are held against the least of them (another for each fingerprint)
    first, then :func:`_other_links` tests every pair of a key that isn't connected by then.
    """

    def chained(i: int) -> Column:
        own = F.filter("chains", lambda c: F.shiftrightunsigned(c, 3) == i)
        return F.exists(own, lambda c: _within(F.col(f"s{i}"), F.col(f"s{i}_"), c.bitwiseAND(F.lit(7).cast("long")), SHORT_DISTANCE))

    keyed = nodes.select("node", F.explode(F.concat(*map(_similar_keys, range(SHORT)))).alias("key"))
    order = F.xxhash64("node", F.shiftrightunsigned("key", 44))
    first = keyed.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = keyed.join(first.select(F.negate("key").alias("less"), "first"), F.negate("key") == F.col("less")).select("node", "key", order.alias("own"), "first")
    met = materialise(met)
    hubs = met.where("own = first").groupBy("key").agg(F.min("node").alias("hub")).select(F.negate("key").alias("less"), "hub")
    pairs = met.join(hubs, F.negate("key") == F.col("less")).where("node <> hub")
    pairs = pairs.groupBy("node", "hub").agg(F.collect_set(F.shiftrightunsigned("key", 41)).alias("chains"))  # of 24 chains
    other = nodes.select(F.bitwise_not("node").alias("other"), *(F.col(x).alias(f"{x}_") for x in PRINTS))
    pairs = pairs.join(nodes.withColumn("same", F.bitwise_not("node")).drop("node"), F.bitwise_not("node") == F.col("same"))
    pairs = pairs.join(other, F.bitwise_not("hub") == F.col("other"))
    pairs = pairs.where(reduce(Column.__or__, map(chained, range(SHORT)))).where(_wide_apart() <= wide_distance(similarity))
    links = materialise(pairs.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    return links.union(_other_links(nodes, met.select("node", "key"), links, similarity))


def _other_links(nodes: DataFrame, met: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs of ``met(node, key)`` but for those that ``links`` (to hubs) plainly connect, as links ``(a, b)`` of the hubs they are linked to.

    In each key those outside the largest group around a hub are held against all
    others of the key, ``BLOCK`` of them at a time.  Keys of one group need no test.
    """
    # equal roots mean connected nodes: the least of those that ROUNDS steps along the links reach
    both = links.select("a", "b").union(links.select("b", "a")).union(links.select("a", "a")).union(links.select("b", "b")).toDF("a", "b").distinct()
    roots = both.groupBy("a").agg(F.min("b").alias("root"))
    for _ in range(ROUNDS - 1):
        roots = roots.select(F.bitwise_not("a").alias("other"), "root")
        roots = both.join(roots, F.bitwise_not("b") == F.col("other")).groupBy("a").agg(F.min("root").alias("root"))
    roots = roots.select(F.bitwise_not("a").alias("other"), "root")
    placed = met.join(roots, F.bitwise_not("node") == F.col("other"), "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    placed = materialise(placed)
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    blocks = F.ceil((F.col("n") - F.col("most.n")) / F.lit(BLOCK))
    mixed = mixed.select(F.negate("key").alias("less"), F.col("most.root").alias("main"), blocks.alias("blocks"))
    rows = placed.join(mixed, F.negate("key") == F.col("less")).drop("less")
    tag = F.shiftrightunsigned("key", 44)
    short = reduce(lambda x, i: F.when(tag == i, F.col(f"s{i}")).otherwise(x), range(1, SHORT), F.col("s0"))
    wide = [f"w{i}" for i in range(WIDE)]
    prints = nodes.withColumn("same", F.bitwise_not("node")).drop("node")
    rows = rows.join(prints, F.bitwise_not("node") == F.col("same")).select("key", "node", "root", "main", "blocks", short.alias("s"), *wide)
    rows = materialise(rows)
    some = rows.where("root <> main").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).drop("main", "blocks")
    all_ = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    all_ = all_.select("key", "block", F.col("main"), *(F.col(x).alias(f"{x}_") for x in ("node", "root", "s", *wide)))
    # once where neither is in the largest group
    new = (F.col("root") != F.col("root_")) & ((F.col("root_") == F.col("main")) | (F.col("node") < F.col("node_")))
    start = F.shiftrightunsigned("key", 41).bitwiseAND(F.lit(7).cast("long"))
    pairs = some.hint("merge").join(all_, ["key", "block"]).where(new).where(_wide_apart() <= wide_distance(similarity))
    return pairs.where(_within(F.col("s"), F.col("s_"), start, SHORT_DISTANCE)).select(F.col("root").alias("a"), F.col("root_").alias("b")).distinct()


def drop_similar(docs: DataFrame, similarity: float = 0.8, words: int = SIMILAR_WORDS) -> DataFrame:
    """``docs`` without all but one document of each group that links of similar texts make: its smallest doc_id stays.

    ``similarity`` is that of the sets of ``words``-word shingles, as the wide
    fingerprints show it.  Of one doc_id with several texts the one with the least
    text hash stays; rows equal in doc_id and text are one document and stay or go
    together; texts without words are alike; a null doc_id goes before others; no
    rows give none.
    """
    some = with_text(docs, "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), "text")
    schema = StructType([some.schema["doc_id"]]).add("hash", LongType())
    for name in PRINTS:
        schema = schema.add(name, LongType())
    rows = materialise(some.mapInArrow(_wide(words), schema).withColumn("node", F.xxhash64(*PRINTS)))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "hash")
    nodes = materialise(rows.groupBy("node", *PRINTS).agg(F.min(order).alias("first")))
    roots = components(similar_links(nodes.drop("first"), similarity))
    roots = roots.union(roots.select("root", "root").distinct()).select(F.bitwise_not("node").alias("other"), "root")
    placed = nodes.join(materialise(roots), F.bitwise_not("node") == F.col("other"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least")).select(F.bitwise_not("root").alias("other"), "least")
    placed = materialise(placed.join(least, F.bitwise_not("root") == F.col("other")).select(F.bitwise_not("node").alias("other"), "least"))
    found = rows.join(placed, F.bitwise_not("node") == F.col("other"))
    return _without(docs, found)


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
