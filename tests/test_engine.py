"""The text analysis engine: characters, grammar, dictionary, matching, segmentation, ranking, assembly."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from yomisen import fixtures as fx
from yomisen.functions import flags as fl
from yomisen.functions import kana, romaji
from yomisen.operators import assemble, lexicon, matching, parse, rank, segment
from yomisen.plans import explain
from yomisen.plans import grammar as gr
from yomisen.sources import dictionary_xml, generations, grammar_json
from yomisen.sources.grammar_json import _row


@pytest.fixture(scope="module")
def grammar(spark):
    return gr.load(spark, grammar_json.default_grammar_json())


@pytest.fixture(scope="module")
def parsed(spark, grammar):
    p = parse.parse(fx.sentences(spark), parse.build(fx.raw_entries(spark), grammar))
    return p


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_unify_over_all_code_points(spark):
    codes = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, s string").select("c", kana.unify(F.col("s"))).collect()
    for c, got in rows:
        want = c
        if 0x3041 <= c <= 0x3095:
            want = c + 0x60
        elif 0xFF01 <= c <= 0xFF1F:
            want = c - 0xFEE0
        assert got == (chr(want).upper() if want < 128 else chr(want))


@pytest.mark.parametrize(
    ("text", "want"),
    [("きって", "kitte"), ("ざっし", "zasshi"), ("ボッチャン", "botchan"), ("きんえん", "kin'en"), ("こんや", "kon'ya"), ("さんぽ", "sanpo"), ("コーヒー", "kōhī"), ("あっえ", "aっe"), ("書く", "書ku")],
)
def test_romaji(spark, text, want):
    assert one(spark, romaji.to_romaji(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("he", "e"), ("ha", "wa"), ("cha", "cha"), ("niha", "niwa"), ("sha", "swa"), ("ka", "ka"), ("", "")])
def test_particle_romaji(spark, text, want):
    assert one(spark, romaji.particle_romaji(F.lit(text))) == want


@pytest.mark.parametrize(("text", "suffix", "want"), [("おう", "ウ", "お"), ("する", "する", ""), ("a", "", "a"), ("あ", "いあ", None), ("か", "き", None)])
def test_strip_suffix(spark, text, suffix, want):
    assert one(spark, kana.strip_suffix_unified(F.lit(text), F.lit(suffix))) == want


def test_grammar_links_cut_their_target_ending(spark):
    types = [
        {"Name": "v1", "Part of Speech": "Verb", "Tenses": [_row("Remove", "る"), _row("Non-past", "る")]},
        {"Name": "v5s", "Part of Speech": "Verb", "Tenses": [_row("Remove", "す"), _row("Potential", "せる", "v1"), _row("Own", "x")]},
    ]
    g = gr.load(spark, json.dumps(types, ensure_ascii=False))
    rows = {(r["type_id"], r["conj"]): (r["suffix"], r["next_type"], r["tense"]) for r in g.edges.collect()}
    assert rows[1, 1] == ("せ", 0, 3)
    assert rows[1, 2] == ("x", None, len(grammar_json.TENSES))


def test_grammar_errors(spark):
    bad = [{"Name": "a", "Part of Speech": "Noun", "Tenses": [_row("Remove", "x")]}]
    with pytest.raises(Exception, match="unsupported part of speech"):
        gr.load(spark, json.dumps(bad))
    loose = [{"Name": "a", "Part of Speech": "Verb", "Tenses": [_row("Stem", "x", "b")]}]
    with pytest.raises(ValueError, match="fit no type"):
        gr.load(spark, json.dumps(loose))
    circle = [
        {"Name": "a", "Part of Speech": "Verb", "Tenses": [_row("Remove", ""), _row("Stem", "", "b")]},
        {"Name": "b", "Part of Speech": "Verb", "Tenses": [_row("Remove", ""), _row("Stem", "", "a")]},
    ]
    with pytest.raises(ValueError, match="lead back"):
        gr.load(spark, json.dumps(circle))


def sequential_chains(edges, root):
    """All chains by plain recursion."""
    by_type: dict = {}
    for e in sorted(edges):
        by_type.setdefault(e[0], []).append(e)
    out = []

    def walk(t, suffix, chain, path):
        for type_id, conj, tense, form, text, following in by_type.get(t, []):
            if tense == 0:
                continue
            link = (type_id, tense, form, conj)
            if following is None:
                out.append((suffix + text, (*chain, link), (*path, conj)))
            elif chain and tense == 2 and form == 0:
                walk(following, suffix + text, chain, (*path, conj))
            elif len(chain) < 4:
                walk(following, suffix + text, (*chain, link), (*path, conj))

    walk(root, "", (), ())
    return [x for x in out if not any(a[1] == b[1] == 3 for a, b in zip(x[1], x[1][1:], strict=False))]


def test_closure_is_the_recursion(spark, grammar):
    edges = [tuple(r) for r in grammar.edges.select("type_id", "conj", "tense", "form", "suffix", "next_type").collect()]
    got: dict = {}
    for r in gr.closure(grammar).collect():
        got.setdefault(r["type_id"], []).append((r["suffix_raw"], tuple(tuple(c) for c in r["chain"]), tuple(r["ord"])))
    for t in {e[0] for e in edges}:
        want = [(s, c, p) for s, c, p in sequential_chains(sorted(edges, key=lambda e: e[:2]), t)]
        assert sorted(got.get(t, [])) == sorted(want)


def test_grammar_size(grammar):
    assert grammar.types.count() == 31
    assert {"vk", "vs", "v5uru"} == {r[0] for r in grammar.types.groupBy("name").count().where("count > 1").collect()}


# --- dictionary ----------------------------------------------------------------------------------------------------------

MINI = """<?xml version="1.0"?><!DOCTYPE JMdict [<!ENTITY v5k "x"><!ENTITY n "w"><!ENTITY prt "y"><!ENTITY adj-i "z"><!ENTITY vt "t">]><JMdict>
<entry><ent_seq>1</ent_seq><k_ele><keb>結ぶ</keb><ke_pri>news2</ke_pri></k_ele><r_ele><reb>むすぶ</reb><re_pri>spec1</re_pri></r_ele>
<sense><pos>&v5k;</pos><pos> &vt; </pos><gloss>to tie</gloss><gloss>a &amp; b</gloss></sense></entry>
<entry><ent_seq>2</ent_seq><r_ele><reb>も</reb></r_ele><sense><pos>&prt;</pos><gloss>also</gloss></sense></entry>
<entry><ent_seq>4</ent_seq><k_ele><keb>窓</keb></k_ele><r_ele><reb>まど</reb></r_ele><sense><pos>&n;</pos><gloss>window</gloss></sense></entry>
<entry><ent_seq>bad</ent_seq><r_ele><reb>x</reb></r_ele></entry>
<entry><ent_seq>3</ent_seq><k_ele><keb>遅い</keb></k_ele><r_ele><reb>おそい</reb></r_ele><sense><pos>&adj-i;</pos><gloss>late</gloss></sense></entry></JMdict>"""


def test_a_small_file_to_a_lexicon(spark, grammar, tmp_path):
    path = tmp_path / "dict.xml"
    path.write_text(MINI)
    entries = dictionary_xml.read_entries(spark, str(path)).cache()
    assert entries.agg(dictionary_xml.count_skipped(F.col("ent_seq"))).first()[0] == 1
    raw = dictionary_xml.raw_entries(entries)
    assert [r["id"] for r in raw.orderBy("seq").collect()] == [1, 2, 4, 3]
    assert raw.where("id = 1").first()["senses"][0]["pos"] == ["v5k", "vt"]
    assert raw.where("id = 1").first()["senses"][0]["glosses"] == ["to tie", "a & b"]
    heads = lexicon.headwords(raw)
    stemmed = lexicon.stems(heads, grammar)
    report = lexicon.build_report(None, lexicon.lexicon(heads, stemmed), raw, stemmed).first()
    assert (report["keys"], report["records"], report["entries"], report["exact_stems"], report["v5_fallback_stems"]) == (11, 11, 4, 2, 2)
    plain = lexicon.stems(heads, grammar, v5_fallback=False)
    report = lexicon.build_report(None, lexicon.lexicon(heads, plain), raw, plain).first()
    assert (report["keys"], report["records"], report["v5_fallback_stems"]) == (9, 9, 0)


def test_an_unknown_entity_within_text_is_an_error(spark):
    rows = spark.createDataFrame([("<entry><ent_seq>1</ent_seq><sense><gloss>a &odd; b</gloss></sense>",)], "value string")
    with pytest.raises(Exception, match="unknown entity"):
        dictionary_xml.entries_of_text(rows).collect()


@pytest.mark.parametrize(("head", "kind"), [(b"\x1f\x8b\x08", "gzip"), (b"\xef\xbb\xbf \n<?xml", "xml"), (b"<JMdict>", "xml")])
def test_sniffing(head, kind):
    assert dictionary_xml.sniff(head) == kind
    with pytest.raises(dictionary_xml.NotADictionary):
        dictionary_xml.sniff(b"<html>")


def test_corpus_files(spark, tmp_path):
    from yomisen.sources import corpus

    (tmp_path / "c.txt").write_text("# note\n\n  one  \n\t#x\ntwo # no comment\n")
    rows = corpus.read_corpus(spark, str(tmp_path / "c.txt")).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["one", "two # no comment"]


def test_grammar_files(spark, tmp_path):
    text = '[{"Name": "あ"}]'
    (tmp_path / "a.json").write_bytes(text.encode("utf-16"))
    (tmp_path / "b.json").write_bytes(text.encode("utf-8-sig"))
    assert grammar_json.read_grammar(spark, str(tmp_path / "a.json")) == grammar_json.read_grammar(spark, str(tmp_path / "b.json")) == text
    assert grammar_json.fingerprint("") == 0xCBF29CE484222325 and grammar_json.fingerprint("a") == 0xAF63DC4C8601EC8C


def test_sources_are_published_only_when_whole(spark, tmp_path):
    import gzip
    import io

    folder, whole, calls = str(tmp_path), gzip.compress(MINI.encode()), []

    def flaky():
        calls.append(1)
        return io.BytesIO(whole[:-9] if len(calls) < 3 else whole)

    target = f"{folder}/JMdict.gz"
    assert dictionary_xml.fetch(spark, flaky, target, pause=0) == target and len(calls) == 3
    assert dictionary_xml.resolve(spark, folder) == target
    assert dictionary_xml.read_entries(spark, target).count() == 5
    for opener, error in (
        (lambda: io.BytesIO(whole[:-9]), EOFError), (lambda: io.BytesIO(gzip.compress(b"<html>")), dictionary_xml.NotADictionary), (lambda: io.BytesIO(b"<html>"), dictionary_xml.NotADictionary),
    ):
        with pytest.raises(error):
            dictionary_xml.fetch(spark, opener, f"{folder}/other.gz", pause=0)
    with pytest.raises(dictionary_xml.NotADictionary, match="bytes"):
        dictionary_xml.fetch(spark, lambda: io.BytesIO(whole), f"{folder}/other.gz", most_bytes=10)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["JMdict.gz"]
    with pytest.raises(FileNotFoundError):
        dictionary_xml.resolve(spark, f"{folder}/none")
    assert dictionary_xml.resolve(spark, f"{folder}/none", download=lambda: "got") == "got"


def test_files_are_read_by_their_content(spark, tmp_path):
    import gzip

    (tmp_path / "packed.xml").write_bytes(gzip.compress(MINI.encode()))
    (tmp_path / "page.xml").write_text("<html><entry></entry></html>")
    assert [r["ent_seq"] for r in dictionary_xml.read_entries(spark, str(tmp_path / "packed.xml")).orderBy("seq").collect()] == ["1", "2", "4", "bad", "3"]
    with pytest.raises(dictionary_xml.NotADictionary):
        dictionary_xml.read_entries(spark, str(tmp_path / "page.xml"))


# --- segmentation -----------------------------------------------------------------------------------------------------------


def solve(spark, text, words, hints=None):
    """Cost and spans of a text with words (start, length, flags, inexact)."""
    rows = [(0, s, n, n, text[s : s + n], f, 100 + i, x, [], (n, i)) for i, (s, n, f, x) in enumerate(words)]
    schema = (
        "doc_id long, start int, len int, src_len int, surface string, flags int, entry_id long, inexact boolean, "
        "chain array<struct<verb_type:int,tense:int,form:int,conj:int>>, ord struct<a:int,b:int>"
    )
    texts = spark.createDataFrame([(0, text)], "doc_id long, text string")
    h = spark.createDataFrame(hints, "doc_id long, pos int, bad_start boolean, bad_end boolean") if hints else None
    scored = segment.scored(spark.createDataFrame(rows, schema), texts, h)
    edges = segment.edges_of(scored)
    got = segment.paths(texts, edges).first()
    assert segment.fold_costs(texts, edges).first()["total_cost"] == got["total_cost"]
    return got["total_cost"], [(s["start"], s["len"], s["matched"]) for s in got["spans"]]


P, C, K, N = fl.PARTICLE, fl.COMMON, fl.COUNTER, fl.IS_NAME


@pytest.mark.parametrize(
    ("text", "words", "cost"),
    [
        ("かきく", [], 300), ("本", [], 500), ("々", [], 100), ("かき", [(0, 2, 0, False)], 10), ("か", [(0, 1, 0, False)], 11), ("か", [(0, 1, P, False)], 8),
        ("かき", [(0, 2, C, False)], 7), ("かき", [(0, 2, C | fl.COMMON_LINE, False)], 7), ("か", [(0, 1, P | C, False)], 5), ("12", [(1, 1, 0, False)], 111),
        ("123", [(1, 2, 0, False)], 210), ("3か", [(1, 1, K, False)], 109), ("3 　か", [(3, 1, K, False)], 309), ("かき", [(0, 2, 0, True)], 20),
        ("カキ", [(0, 2, N, False)], 15), ("カキク", [(0, 2, N, False)], 300), ("", [], 0),
    ],
)
def test_costs(spark, text, words, cost):
    assert solve(spark, text, words)[0] == cost


def test_ties(spark):
    words = [(0, 2, 0, False), (0, 1, P, False), (1, 3, 0, False), (2, 2, P, False)]
    for order in (words, words[::-1]):  # the shorter last word
        assert solve(spark, "かきくけ", order) == (18, [(0, 2, True), (2, 2, True)])
    assert solve(spark, "12か", [(1, 2, 0, True), (0, 2, C | N, False)])[1][0][2] is False


def test_hints(spark):
    words = [(0, 2, 0, False), (2, 1, 0, False)]
    assert solve(spark, "かきく", words, [(0, 2, True, True)])[0] == 10 + 11 + 20


def test_random_lattices_against_all_paths():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        skips = [rng.choice([100, 500]) for _ in range(n)]
        edges = [(e, k, rng.randint(5, 120)) for e in range(1, n + 1) for k in range(1, e + 1) if rng.random() < 0.3]
        best = [0] + [None] * n
        for i in range(1, n + 1):
            best[i] = min([best[i - 1] + skips[i - 1], *(best[e - k] + c for e, k, c in edges if e == i)])
        cost, path = segment.shortest(skips, edges)
        assert cost == best[n]
        assert [p[0] for p in path] == [sum(q[1] for q in path[:i]) for i in range(len(path))] and sum(p[1] for p in path) == n
        assert not any(not a[2] and not b[2] for a, b in zip(path, path[1:], strict=False))


def test_interior_hints(spark):
    tokens = spark.createDataFrame([(0, 0, 2, "n,,,,,,,トウキョウ"), (0, 2, 3, "n,,,,,,,*")], "doc_id long, tok_start int, tok_end int, feature string")
    assert sorted(map(tuple, segment.interior_hints(tokens).collect())) == [(0, 0, False, True), (0, 1, True, False)]


# --- whole analyses -----------------------------------------------------------------------------------------------------------


def segments_of(parsed, doc_id):
    return parsed.segments.where(F.col("doc_id") == doc_id).orderBy("start").collect()


@pytest.mark.parametrize(
    ("doc_id", "surfaces", "head", "label", "reading"),
    [
        (0, ["本", "も", "読みました"], "読む", "Formal Past", "よみました"), (3, ["来た"], "来る", "Past", "きた"), (12, ["来られる", "々"], "来る", "Potential", "こられる"),
        (4, ["勉強しました"], "勉強", "Formal Past", "べんきょうしました"), (10, ["静かな", "東京"], "静か", "Prenominal", "しずかな"),
    ],
)
def test_sentences(parsed, doc_id, surfaces, head, label, reading):
    segs = segments_of(parsed, doc_id)
    assert [s["surface"] for s in segs] == surfaces
    entry = next(e for s in segs for e in s["entries"] if e["headword"] == head)
    assert (entry["conjugation"], entry["reading"]) == (label, reading)


def test_unmatched_and_counters(parsed):
    assert [(s["surface"], s["matched"], s["entries"]) for s in segments_of(parsed, 8)] == [("abc 12", False, [])]
    three = segments_of(parsed, 5)
    assert three[1]["entries"][0]["senses"][0]["pos"] == ["ctr"] and "counter" in three[1]["entries"][0]["flags"]
    book = segments_of(parsed, 0)[0]["entries"]
    assert book[0]["senses"][0]["glosses"] == ["book"] and not any("counter" in e["flags"] for e in book)
    assert segments_of(parsed, 7) == []


def test_the_plain_verb_gives_way_to_the_headword(parsed):
    eat = segments_of(parsed, 5)[-1]
    assert [(e["headword"], e["conjugation"]) for e in eat["entries"]] == [("食べる", None)]


def sequential_rank(rows):
    """Ranking by the adjacent scan, on (entry, inexact, flags, chain key or None, order)."""
    rows = sorted(rows, key=lambda r: (r["e"], *(r["c"] or (0, 0, 0))))
    for e in {r["e"] for r in rows}:
        mine = [r for r in rows if r["e"] == e]
        if any(not r["x"] for r in mine):
            for r in mine:
                r["x"] = False
    kept = []
    for r in rows:
        mine = [q for q in rows if q["e"] == r["e"]]
        plain = r["c"] and r["c"][1] == 1 and r["c"][2] == 0
        if plain and sum(q["c"] is not None for q in mine) == 1 and any(q["c"] is None for q in mine):
            continue
        kept.append(r)
    return sorted(kept, key=lambda r: (r["x"], bool(r["f"] & fl.IS_NAME), -(r["f"] & fl.RANKED), r["e"], (r["c"] or (0, 0, 0))[2]))


def test_ranks_against_the_scan(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for doc in range(150):
        made = []
        for i in range(rng.randint(1, 7)):
            c = None if rng.random() < 0.5 else (rng.randint(1, 3), rng.randint(0, 3), rng.randint(0, 3))
            r = {"e": rng.randint(1, 3), "x": rng.random() < 0.5, "f": rng.choice([0, 1, 9, 16, 32, 128, 33]), "c": c, "o": i}
            if not any((q["e"], q["f"], q["c"]) == (r["e"], r["f"], r["c"]) for q in made):
                made.append(r)
        for r in made:
            chain = [(r["c"][0] - 1, r["c"][1], r["c"][2], 0)] if r["c"] else []
            rows.append((doc, 0, 1, r["e"], r["x"], r["f"], chain, r["o"]))
        want[doc] = [(r["e"], r["o"]) for r in sequential_rank([dict(r) for r in made])]
    schema = "doc_id long, start int, len int, entry_id long, inexact boolean, flags int, chain array<struct<verb_type:int,tense:int,form:int,conj:int>>, ord int"
    got: dict = {}
    for r in rank.ranked(spark.createDataFrame(rows, schema)).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append((r["entry_id"], r["ord"]))
    assert {d: [e for e, _ in x] for d, x in got.items()} == {d: [e for e, _ in x] for d, x in want.items()}


def test_renderings(parsed):
    lines = {(r["doc_id"], r["start"]): r["lines"] for r in assemble.listing(parsed.segments).collect()}
    assert lines[0, 2] == "start=2 len=5 読みました matched reading=よみました\n    読む (Formal Past) [よみました] to read"
    assert lines[8, 0] == "start=0 len=6 abc 12 unmatched"
    short = {(r["doc_id"], r["start"]): r["lines"] for r in assemble.listing(parsed.segments, 1).collect()}
    assert short[0, 0].endswith("    ... 1 more")
    tips = {(r["doc_id"], r["start"]): r["tooltip"] for r in assemble.tooltip(parsed.segments).collect()}
    assert tips[3, 0].split("\n")[:3] == ["\x01Past", "来る【きた】", "(vk,vi) (1) to come/(P)"]
    chips = {(r["doc_id"], r["start"]): r["chip"] for r in assemble.chip_class(parsed.segments).collect()}
    assert (chips[0, 0], chips[0, 1], chips[5, 1], chips[5, 3], chips[8, 0]) == ("kanji", "particle", "counter", "kana", "unmatched")


@pytest.mark.parametrize(
    ("line", "runs"),
    [
        ("\x01Past", [("Past", "conj")]), ("\x01", []), ("光る【ひかる】", [("光る", "kanji"), ("【ひかる】", "kana")]), ("(v1,vi) (1) to go", [("(v1,vi)", "paren"), (" ", "text"), ("(1)", "paren"), (" to go", "text")]),
        ("a (b (c) 本", [("a ", "text"), ("(b (c) 本", "paren")]), ("((x)) y", [("((x))", "paren"), (" y", "text")]),
    ],
)
def test_colour_runs(line, runs):
    assert assemble.colour_runs(line) == runs


# --- generations, streams, plans -----------------------------------------------------------------------------------------------


def test_generations(spark, grammar, tmp_path):
    root, text = str(tmp_path / "root"), grammar_json.default_grammar_json()
    calls = []

    def source():
        calls.append(1)
        return fx.raw_entries(spark)

    first = generations.ensure(spark, root, grammar, text, source)
    assert generations.numbers(spark, root) == [0] and first.entries.count() == len(fx.ENTRIES)
    generations.ensure(spark, root, grammar, text, source)
    assert len(calls) == 1
    generations.ensure(spark, root, grammar, text + " ", source)  # another grammar: built again
    generations.write(spark, root, first, text)
    assert generations.numbers(spark, root) == [0, 1, 2]
    (tmp_path / "root" / ".build-left").mkdir()
    (tmp_path / "root" / "gen-07").mkdir()
    assert sorted(generations.sweep(spark, root, keep=0)) == [".build-left", "gen-0", "gen-1"]
    assert generations.folder_names(spark, root) == ["gen-07", "gen-2"]
    with pytest.raises(generations.Unusable):
        generations.open_generation(spark, f"{root}/gen-07", grammar, text)
    assert generations.remove(spark, root, 2) and not generations.remove(spark, root, 2)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from yomisen.streaming import texts

    rows = [(u, f"2024-01-01 00:00:{i:02d}", i, random.Random(i * 7 + u).choice("ab")) for u in range(3) for i in range(20)]
    table = spark.createDataFrame(rows, "user_id long, t string, seq long, text string").selectExpr("user_id", "timestamp(t) AS ts", "seq", "text")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = texts.without_repeats(stream).writeStream.format("memory").queryName("fresh").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, texts.without_repeats_batch(table).collect()))
    assert sorted(map(tuple, spark.table("fresh").collect())) == want
    assert texts.latest(table).count() == 3
    seen = []
    running = texts.analyse(stream.withColumn("text", F.concat("text", F.lit("本"))), lambda df: df, lambda df, n: seen.extend(df.collect()), "0 seconds")
    running.processAllAvailable()
    running.stop()
    assert len(seen) == 3


def test_a_stream_waits_for_its_dictionary_and_keeps_bad_texts_apart(spark, tmp_path):
    from yomisen.streaming import texts

    rows = [(u, "2024-01-01 00:00:00", u, "bad本" if u == 3 else f"本{u}") for u in range(8)]
    table = spark.createDataFrame(rows, "user_id long, t string, seq long, text string").selectExpr("user_id", "timestamp(t) AS ts", "seq", "text")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    analysis = lambda rows, d: rows.select("user_id", F.when(F.col("text").startswith("bad"), F.raise_error(F.lit("no")).cast("string")).otherwise(F.lit(d)).alias("made"))

    def run(readiness):
        seen = []
        query = texts.analyse(stream, analysis, lambda df, n: seen.extend(r.asDict() for r in df.collect()), "0 seconds", readiness)
        query.processAllAvailable()
        query.stop()
        return seen

    ready = texts.Readiness()
    assert run(ready) == []  # no dictionary yet
    assert ready.prepare(lambda: "xml", lambda x: x + "-1") and ready.dictionary == "xml-1"
    seen = run(ready)
    assert sorted(r["user_id"] for r in seen if r.get("made") == "xml-1") == [0, 1, 2, 4, 5, 6, 7]
    assert [r["user_id"] for r in seen if "error" in r] == [3]
    ready.prepare(None, lambda _: "next")
    assert {r["made"] for r in run(ready) if "made" in r} == {"next"}
    ready.paused = True
    assert run(ready) == []
    ready.prepare(lambda: 1 / 0, lambda x: x)
    assert ready.dictionary == "next" and not ready._busy.locked()
    assert [r["phase"] for r in ready.status(spark).collect()] == ["downloading", "building", "ready", "building", "ready", "downloading", "error"]
    refused = []
    ready.prepare(None, lambda _: refused.append(ready.prepare(None, lambda _: "x")))
    assert refused == [False]


def test_plans_push_down_columns_and_join_by_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lex = spark.createDataFrame([("THE", 3, "the", 1, None, 1, (0,))], "key string, key_chars int, surface string, flags int, verb_type int, entry_id long, ord struct<a:int>")
    hits = matching.prefix_hits(docs, lex)
    assert explain.columns_read(hits) == ["doc_id:bigint,text:string"]
    plan = explain.summary(hits)
    assert not plan.get("CartesianProduct") and not plan.get("BroadcastNestedLoopJoin")
    assert plan.get("BroadcastHashJoin") or plan.get("SortMergeJoin")


@pytest.mark.parametrize("most", [0, matching.MOST_BYTES])
def test_texts_are_never_broadcast(spark, monkeypatch, tmp_path, most):
    """The lexicon's side is built or both are merged, with empty keys and without, whatever Spark takes the texts' size to be."""
    monkeypatch.setattr(matching, "MOST_BYTES", most)
    rows = [(i, f"{i} abcab{'xy' * i}") for i in range(40)] + [(98, ""), (99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    schema = "key string, key_chars int, surface string, flags int, verb_type int, entry_id long, ord struct<a:int>"
    for words in (["", ""], ["", "ab", "a", "yx"], ["ab", "cab"], []):
        lex = spark.createDataFrame([(w.upper(), len(w), w, 1, None, i, (i,)) for i, w in enumerate(words)], schema)
        hits = matching.prefix_hits(texts, lex)
        got = sorted((r["doc_id"], r["start"], r["entry_id"]) for r in hits.collect())
        assert got == sorted((i, at, e) for i, t in rows for at in range(len(t or "")) for e, w in enumerate(words) if t[at:].startswith(w))
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan
        if words == ["", ""]:
            assert "BuildRight" in plan and "SortMergeJoin" not in plan


def test_probes_cover_long_texts(spark):
    text = "".join(random.Random(3).choice("abcé本") for _ in range(700))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = matching.probes(docs, [1, 5], ahead=4).collect()
    want = {(i, n, text[i : i + n], text[i + n : i + n + 4]) for n in (1, 5) for i in range(len(text) - n + 1)}
    assert {(r["start"], r["len"], r["source"], r["behind"]) for r in got} == want and len(got) == len(want)


# --- words in one pass ------------------------------------------------------------------------------------------------


def _random_words(rng):
    letters = "かきくカキク本々3３ab "
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))
    flags = [0, 0, fl.COMMON, fl.PARTICLE, fl.COUNTER, fl.IS_NAME, fl.COUNTER | fl.COMMON, fl.IS_NAME | fl.COMMON_LINE]
    rows = {(w, rng.choice(flags)) for w in (word() for _ in range(60))}
    text = lambda n: "".join(rng.choice(letters + "   日x") for _ in range(n))
    return sorted(rows), text


def test_words_in_one_pass_are_those_of_the_joins(spark):
    from yomisen.operators import scan

    rows, text = _random_words(random.Random(11))
    words = spark.createDataFrame([(w, f, i) for i, (w, f) in enumerate(rows)], "surface string, flags int, entry_id long")
    words = words.select(kana.unify(F.col("surface")).alias("key"), F.length("surface").alias("key_chars"), "surface", "flags", "entry_id")
    texts = spark.createDataFrame([(i, text(i)) for i in range(150)] + [(500, None), (501, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["total_cost"], r["spans"]) for r in scan.paths_of_words(texts, words).collect()}
    assert got == {r["doc_id"]: (r["total_cost"], r["spans"]) for r in scan.paths_of_words(texts, words, most_bytes=0).collect()}
    assert scan.paths_of_words(texts, words.limit(0)).where("doc_id = 7").first()["total_cost"] >= 700


def test_long_texts_are_cut_where_nothing_straddles():
    from time import perf_counter

    from yomisen.operators import scan

    rng = random.Random(12)
    rows, text = _random_words(rng)
    words = scan.Words([(kana.unify_text(w), w, f) for w, f in rows])
    for _ in range(30):
        one_text = text(rng.randint(0, 300))
        whole = scan.solve_text(one_text, words)
        assert whole == scan.solve_text(one_text, words, block=7)
        assert sum(n for _, n, _ in whole[1]) == len(one_text)
    chained = scan.Words([("AAA", "aaa", 0)])
    assert scan.solve_text("a" * 1000, chained, block=10) == scan.solve_text("a" * 1000, chained)
    began = perf_counter()
    cost, path = scan.solve_text(text(1000) * 5000, words)
    assert cost > 0 and path[-1][0] + path[-1][1] == 5_000_000 and perf_counter() - began < 60
