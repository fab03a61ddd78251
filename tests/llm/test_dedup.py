"""The three deduplication operators against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from yomisen.llm import components, exact_dedup, repeats, simhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = lower(text).encode().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """The least member of each fingerprint's component, by comparing all pairs."""
    names = sorted(set(prints))
    parent = {x: x for x in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if bin(a ^ b).count("1") <= 2:
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {x: root(x) for x in names}


def plain_near(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(prints)
    least: dict = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    return [(i, f"{f:016x}", least.get(group[f])) for (i, _), f in zip(rows, prints, strict=True)]


def test_near_duplicates(docs, rows):
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == Counter(plain_near(rows))


def test_near_duplicates_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.drop_near_duplicates(no_docs).collect() == []


def test_drop_near_duplicates_keeps_one_of_each(docs, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = [plain_fingerprint(r["text"]) for r in kept.collect()]
    group = plain_groups([plain_fingerprint(t) for _, t in rows])
    assert {group[f] for f in found} == set(group.values())
    distinct = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert len(distinct) == len(set(group.values()))


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(3)
    prints: set[int] = set()
    for _ in range(30):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 14))):
            x = base
            for b in rng.integers(0, 64, int(rng.integers(0, 4))):
                x ^= 1 << int(b)
            prints.add(x)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    want = Counter(Counter(plain_groups(prints).values()).values())
    links = simhash.links_of(spark.createDataFrame([(x,) for x in signed], "fp long"))
    pairs = {(min(a, b), max(a, b)) for a, b in links.collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert Counter(Counter(roots.get(x, x) for x in signed).values()) == want


def test_one_full_key_loses_no_link_and_fills_no_file(spark):
    """Every pattern of ten bits that one key leaves open."""
    signed = [0x0123456789000000 | i & 31 | (i & 0x3E0) << 5 for i in range(1024)]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.links_of(prints)
    assert links.count() == sum((a ^ b).bit_count() <= 2 for i, a in enumerate(signed) for b in signed[:i])
    met = simhash._met(prints.select("fp", F.explode(simhash._keys(F.col("fp"))).alias("key")))
    files = met.select("key", F.explode(simhash._files(F.col("fp"), F.col("key"))).alias("file")).groupBy("key", "file").count()
    assert files.agg(F.max("count")).first()[0] <= simhash.FILE_SIZE


def plain_similarity(a, b):
    a, b = (lower(x).encode().split() for x in (a, b))
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) / len(a | b)


def test_drop_similar(spark):
    """Finds nearly all texts that share 0.8 of their five-word shingles, and leaves alone those that share under half."""
    rng = random.Random(4)
    rows = []
    for group in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 400))]
        rows.append((10 * group, " ".join(words)))
        for copy in range(1, 4):
            share = rng.choice((0.004, 0.01, 0.02, 0.2))
            changed = [f"w{rng.randrange(3000)}" if rng.random() < share else w for w in words]
            rows.append((10 * group + copy, " ".join(changed)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (5004, "one three"), (None, "one  two")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, w0 int")
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    kept = {r["doc_id"] for r in kept.collect()}
    texts = dict(rows)
    assert {5000, 5002, 5004} <= kept and not {5001, 5003, None} & kept
    alike = [(a, b) for g in range(60) for a in range(10 * g, 10 * g + 4) for b in range(10 * g, a) if plain_similarity(texts[a], texts[b]) >= 0.8]
    clean = [a for g in range(60) for a in range(10 * g, 10 * g + 4) if all(plain_similarity(texts[a], texts[b]) < 0.5 for b in range(10 * g, 10 * g + 4) if b != a)]
    assert len(alike) > 60 and sum(a in kept and b in kept for a, b in alike) <= 0.1 * len(alike)
    assert len(clean) > 20 and set(clean) <= kept


def test_similar_links_are_those_of_all_pairs_in_a_key(spark, monkeypatch):
    """Texts that share a key with many others are linked to each other, not to one of them alone."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(12)
    most = simhash.wide_distance(0.8)
    flip = lambda x, size, bits: x ^ sum(1 << i for i in rng.sample(range(size), bits))
    nodes = []
    for common in [rng.getrandbits(64) for _ in range(2)]:
        for _ in range(25):
            wide = rng.getrandbits(64 * simhash.WIDE)
            for _ in range(rng.randint(1, 6)):  # steps away, so that the ends of a chain aren't similar
                wide = flip(wide, 64 * simhash.WIDE, rng.choice((most // 2, most, most + 1)))
                nodes.append((wide, [flip(common, 64, rng.randint(0, 6)) for _ in range(simhash.SHORT)]))

    def similar(a, b):
        if (a[0] ^ b[0]).bit_count() > most:
            return False
        for x in (p ^ q for p, q in zip(a[1], b[1], strict=True)):
            for start in range(8):
                ring = (x << 8 * start | x >> 64 - 8 * start) & (1 << 64) - 1
                segments = [(ring >> 56 - 8 * k & 255).bit_count() for k in range(8)]
                if (ring >> 24 == 0 or (ring >> 40 == 0 and ring >> 8 & 0xFFFF == 0)) and all(sum(segments[: k + 1]) <= k + 1 for k in range(8)):
                    return True
        return False

    def groups(pairs):
        root = list(range(len(nodes)))
        for a, b in pairs:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *(signed(w >> 64 * k & (1 << 64) - 1) for k in range(simhash.WIDE)), *map(signed, s)) for i, (w, s) in enumerate(nodes)]
    table = spark.createDataFrame(rows, ", ".join(f"{x} long" for x in ["node", *simhash.PRINTS]))
    got = {(r["a"], r["b"]) for r in simhash.similar_links(table, 0.8).collect()}
    want = {(a, b) for a in range(len(nodes)) for b in range(a) if similar(nodes[a], nodes[b])}
    assert len(want) > 40 and groups(got) == groups(want)


def test_drop_similar_holds_one_of_a_full_group(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [(i, " ".join([*words[: i % 190], f"x{i}", *words[i % 190 :]])) for i in range(600)]
    docs = spark.createDataFrame([*rows, *rows], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.drop_similar(docs).collect()] == [0, 0]
    assert simhash.drop_similar(docs.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in components.components(links).collect()} == {0}


def plain_repeats(rows):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()
        out.append((doc_id, len(t), int(gone.sum()), spans, kept))
    return out


@pytest.mark.parametrize("index_bytes", [repeats.INDEX_BYTES, 300])
def test_repeats(docs, rows, index_bytes):
    assert Counter(map(tuple, repeats.repeats_report(docs, index_bytes).collect())) == Counter(plain_repeats(rows))


def test_repeats_of_a_passage_in_many_texts(spark):
    """Its edges, and strings too short to count, fill their names; every anchor is used."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, short = letters(260), letters(196)
    rows = [(i, letters(rng.randint(150, 400)) + passage + letters(rng.randint(150, 400))) for i in range(40)]
    rows += [(100 + i, letters(250) + short + rng.choice("xy") + letters(250)) for i in range(40)]
    rows += [(200 + i, letters(100) + "=" * rng.randint(201, 260) + letters(100)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, repeats.repeats_report(docs, 2000).collect())) == Counter(plain_repeats(rows))


def test_repeats_of_many_equal_rows(spark):
    """Equal rows share their marks, so that what is gathered of a text doesn't grow with its copies."""
    rng = random.Random(9)
    text = " ".join(str(rng.random()) for _ in range(60))
    docs = spark.createDataFrame([(7, text)] * 1000 + [(8, "q" + text), (9, "other")], "doc_id long, text string")
    keyed, marks = repeats.find_repeats(docs)
    assert marks.count() == 2
    assert sum(len(r["marks"]) for r in marks.collect()) < 4 * len(text)
    got = Counter((r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in repeats.repeats_report(docs).collect())
    assert got == {(7, 0): 1000, (8, 1): 1, (9, 5): 1}


def test_repeats_of_nothing(no_docs):
    assert repeats.repeats_report(no_docs).collect() == []


def test_matching_statistics_are_longest_repeats():
    rng = np.random.default_rng(1)
    for letters, n in ((2, 200), (3, 300), (1, 60)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        data = text.tobytes()
        want = []
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while j != i and max(i, j) + k < n and data[i + k] == data[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        index = repeats.RunLengthIndex(text)
        assert index.matching_statistics().tolist() == want
        assert int(index.lengths.sum()) == n


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_duplicates(spark, docs, rows, batches):
    index = exact_dedup.new_index(spark, 5)
    got = exact_dedup.exact_duplicates(docs, index, batches=batches).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text])
        assert r["keep_id"] == (max(ids) if ids else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)
    assert index.digests().count() == len(groups)
    again = exact_dedup.exact_duplicates(docs, index, "later").collect()
    assert not any(r["kept"] for r in again) and {r["text_sha256"]: r["keep_id"] for r in again} == {r["text_sha256"]: r["keep_id"] for r in got}


def test_drop_exact_duplicates_and_a_second_batch(spark, docs, rows):
    index = exact_dedup.new_index(spark, 5)
    first = exact_dedup.drop_exact_duplicates(docs, index, "first")
    assert first.columns == docs.columns
    kept = first.collect()
    assert Counter(lower(r["text"]) for r in kept) == Counter({lower(t) for _, t in rows})
    more = spark.createDataFrame([(9000, rows[0][1]), (9001, "quite new"), (9002, "QUITE NEW")], "doc_id long, text string")
    assert [r["doc_id"] for r in exact_dedup.drop_exact_duplicates(more, index, "second").collect()] == [9002]
    again = exact_dedup.DigestIndex(spark, index.table, 5)
    assert exact_dedup.drop_exact_duplicates(more, again, "third").collect() == []
    assert index.digests().count() == len({lower(t) for _, t in rows}) + 1


def test_a_batch_that_failed_and_is_run_again(spark, docs, rows):
    """What it has appended before its result was written doesn't count against it."""
    index = exact_dedup.new_index(spark, 5)
    exact_dedup.drop_exact_duplicates(docs, index, "b1")  # its result is lost
    kept = exact_dedup.drop_exact_duplicates(docs, index, "b1").collect()
    assert Counter(lower(r["text"]) for r in kept) == Counter({lower(t) for _, t in rows})
    assert index.digests().count() == len({lower(t) for _, t in rows})
    assert exact_dedup.drop_exact_duplicates(docs, index, "b2").collect() == []


def test_the_index_is_joined_in_its_buckets(spark, docs):
    index = exact_dedup.new_index(spark, 5)
    exact_dedup.drop_exact_duplicates(docs, index, "first")
    groups = docs.select(exact_dedup.digest_of(docs["text"]).alias("digest"))
    plan = index.unseen(groups, "second")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert "Bucketed: true" in plan


def test_exact_duplicates_of_nothing(spark, no_docs):
    index = exact_dedup.new_index(spark, 5)
    assert exact_dedup.exact_duplicates(no_docs, index, batches=2).collect() == []
    assert exact_dedup.drop_exact_duplicates(no_docs, index).collect() == []
