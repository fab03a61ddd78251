"""Queries for every operator, and the same in DuckDB's SQL where it can say them."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import flags as fl
from .functions import kana, romaji
from .operators import assemble, lexicon, matching, parse, rank, scan, segment
from .plans import grammar as gr
from .plans.spread import spread
from .plans.store import stored
from .sources import corpus, dictionary_xml, generations, grammar_json
from .streaming import texts as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(text: str) -> str:
    return text.replace("'", "''")


def d_unify(x: str) -> str:
    return f"translate({x}, '{_q(kana.UNIFY_FROM)}', '{_q(kana.UNIFY_TO)}')"


def d_fold(x: str) -> str:
    return f"translate({x}, '{kana.FOLD_FROM}', '{kana.FOLD_TO}')"


#: Letters as hiragana, so that Latin text exercises the kana rules; capitals become katakana.
PSEUDO_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
PSEUDO_TO = "あいうえおかきくけこさしすせそたちつてとなにぬねのはアイウエオカキクケコサシスセソタチツテトナニヌネノハ"


def _pseudo(text: Column) -> Column:
    return F.translate(text, PSEUDO_FROM, PSEUDO_TO)


D_PSEUDO = f"translate(text, '{PSEUDO_FROM}', '{PSEUDO_TO}')"

# --- characters -------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({d_unify('text')}) AS unified, md5({d_unify(D_PSEUDO)}) AS unified_kana FROM documents")
def unify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(kana.unify(text)).alias("unified"), F.md5(kana.unify(_pseudo(text))).alias("unified_kana"))


@query(
    f"SELECT doc_id, md5(translate({D_PSEUDO}, '{kana.KATAKANA_FROM}', '{kana.KATAKANA_TO}')) AS katakana FROM documents"
)
def to_katakana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(kana.to_katakana(_pseudo(F.col("text")))).alias("katakana"))


_CLASSES = {"hiragana": kana.HIRAGANA, "katakana": kana.KATAKANA, "half_width": kana.HALF_WIDTH_KATAKANA, "kanji": kana.KANJI, "digits": kana.DIGIT, "japanese": kana.JAPANESE}
_D_CLASSES = ", ".join(f"len(regexp_extract_all(t, '{c}'))::BIGINT AS {n}" for n, c in _CLASSES.items())


@query(f"SELECT doc_id, {_D_CLASSES} FROM (SELECT doc_id, {D_PSEUDO} AS t FROM documents)")
def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _pseudo(F.col("text"))
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(F.regexp_count(text, F.lit(c)).cast("long").alias(n) for n, c in _CLASSES.items()))


_CHARS = [(i, c) for i, c in enumerate("あんゖ゛アヶ・ーｱﾛﾞ々一龿九3３百千万億aZ！ 　é")]


@query(
    "WITH "
    + fx.values("chars", "i, c", _CHARS)
    + f""" SELECT i, c, regexp_matches(c, '{kana.HIRAGANA}') AS hiragana, regexp_matches(c, '{kana.KATAKANA}') AS katakana,
    regexp_matches(c, '{kana.HALF_WIDTH_KATAKANA}') AS half_width, regexp_matches(c, '{kana.KANJI}') AS kanji, regexp_matches(c, '{kana.IDEOGRAPH}') AS ideograph,
    regexp_matches(c, '{kana.DIGIT}') AS digit, regexp_matches(c, '{kana.JAPANESE}') AS japanese, {d_unify('c')} AS unified FROM chars"""
)
def char_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    tests = {"hiragana": kana.HIRAGANA, "katakana": kana.KATAKANA, "half_width": kana.HALF_WIDTH_KATAKANA, "kanji": kana.KANJI, "ideograph": kana.IDEOGRAPH, "digit": kana.DIGIT, "japanese": kana.JAPANESE}
    return spark.createDataFrame(_CHARS, "i int, c string").select("i", "c", *(kana.has(c, x).alias(n) for n, x in tests.items()), kana.unify(c).alias("unified"))


@query(f"SELECT page_id, regexp_matches(html, '{kana.JAPANESE}') AS japanese, regexp_matches(html, '{kana.DIGIT}') AS digits FROM pages")
def has_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", kana.has(html, kana.JAPANESE).alias("japanese"), kana.has(html, kana.DIGIT).alias("digits"))


_SUFFIXES = [(0, ""), (1, "RING"), (2, "ing"), (3, "t"), (4, "widget"), (5, "longer than any name")]


@query(
    "WITH "
    + fx.values("s", "s_id, suffix", _SUFFIXES)
    + f""" SELECT p_partkey, s_id, CASE WHEN suffix = '' THEN p_name
    WHEN right({d_unify('p_name')}, length(suffix)) = {d_unify('suffix')} AND length(p_name) >= length(suffix) THEN left(p_name, length(p_name) - length(suffix)) END AS stem
    FROM part, s"""
)
def strip_suffix_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    each = some.join(F.broadcast(spark.createDataFrame(_SUFFIXES, "s_id int, suffix string")))
    return each.select("p_partkey", "s_id", kana.strip_suffix_unified(F.col("p_name"), F.col("suffix")).alias("stem"))


_PAIRS = [(0, "かな", "カナ"), (1, "ABC", "abc"), (2, "Ａ", "A"), (3, "１", "1"), (4, "É", "é"), (5, "", ""), (6, "か", "かな"), (7, "！", "!")]


@query(
    "WITH "
    + fx.values("pairs", "i, a, b", _PAIRS)
    + f" SELECT i, {d_fold('a')} = {d_fold('b')} AS strict, {d_unify('a')} = {d_unify('b')} AS unified FROM pairs"
)
def strict_vs_unified_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return spark.createDataFrame(_PAIRS, "i int, a string, b string").select("i", kana.strict_eq(a, b).alias("strict"), kana.unified_eq(a, b).alias("unified"))


@query(
    f"""SELECT conv_id, turn, length(t) <= 10000 AND regexp_matches(t, '{kana.CLIPBOARD_JAPANESE}')
        AND t IS DISTINCT FROM lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS worth
    FROM (SELECT conv_id, turn, {D_PSEUDO} AS t FROM conversations)"""
)
def should_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", _pseudo(F.col("text")).alias("t"))
    before = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", kana.should_parse(F.col("t"), before).alias("worth"))


_D_ROMAJI = f"""
    chunked AS (SELECT id, regexp_extract_all(k, '{romaji.CHUNK}') AS cs FROM kana_text),
    folded AS (SELECT id, cs, list_transform(cs, lambda c: translate(c, '{romaji._FOLD_FROM}', '{romaji._FOLD_TO}')) AS ks FROM chunked),
    spoken AS (SELECT id, unnest(cs) AS c, unnest(ks) AS k, unnest(list_append(ks[2:], NULL)) AS nxt, unnest(range(1, len(cs) + 1)) AS i FROM folded),
    plain(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in (romaji.ONE | romaji.TWO).items())}),
    doubled(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in romaji.DOUBLED.items())}),
    written AS (SELECT s.id, s.i, CASE WHEN s.k = 'ー' THEN chr(772) WHEN s.k = 'ッ' THEN coalesce(d.v, s.c)
        WHEN s.k = 'ン' AND regexp_matches(coalesce(left(s.nxt, 1), ''), '{romaji.AFTER_N}') THEN 'n''' ELSE coalesce(p.v, s.c) END AS v
        FROM spoken s LEFT JOIN plain p ON p.k = s.k LEFT JOIN doubled d ON d.k = left(s.nxt, 1)),
    joined AS (SELECT id, string_agg(v, '' ORDER BY i) AS romaji FROM written GROUP BY id)"""
_KANA = ["きって", "ざっし", "ボッチャン", "きんえん", "こんや", "さんぽ", "コーヒー", "あっえ", "書く", "ッ", "ヴィ", "しゅっちょう", "ん", "ゎ", "フォーク", "りょっか", "は", "へ", "ちゃ", "こんばんは"]


@query(
    f"""WITH kana_text AS (SELECT p_partkey AS id, translate(p_name, '{PSEUDO_FROM}', '{PSEUDO_TO}') AS k FROM part
        UNION ALL SELECT -1 - i, k FROM (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(_KANA))}) t(i, k)), {_D_ROMAJI}
    SELECT id, romaji, CASE WHEN romaji = 'he' THEN 'e' WHEN right(romaji, 2) = 'ha' AND right(romaji, 3) <> 'cha'
        THEN left(romaji, length(romaji) - 2) || 'wa' ELSE romaji END AS particle FROM joined"""
)
def romaji_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _pseudo(F.col("p_name")).alias("k"))
    own = spark.createDataFrame([(-1 - i, k) for i, k in enumerate(_KANA)], "id long, k string")
    out = parts.union(own).select("id", romaji.to_romaji(F.col("k")).alias("romaji"))
    return out.withColumn("particle", romaji.particle_romaji(F.col("romaji")))


@query(
    r"""SELECT doc_id, count(*) AS sentences, sum(length(l))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
    WHERE NOT regexp_matches(l, '\A\s*(?:#|\z)') GROUP BY doc_id"""
)
def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.sentences_of(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"))


# --- dictionary -------------------------------------------------------------------------------------------------

D_FLAGS = """(CASE WHEN f.form_ord = 0 THEN 1 ELSE 0 END | CASE WHEN f.is_reading AND f.n_kanji > 0 THEN 2 ELSE 0 END
    | CASE WHEN (SELECT bool_or(g.pri) FROM forms g WHERE g.id = f.id) THEN 4 ELSE 0 END | CASE WHEN f.pri THEN 8 ELSE 0 END
    | CASE WHEN list_has_any(c.pos, ['prt', 'conj']) THEN 16 ELSE 0 END
    | CASE WHEN list_has_any(c.pos, ['ctr', 'suf']) AND NOT list_contains(c.misc, 'arch') THEN 32 ELSE 0 END)::INTEGER"""
D_HEADS = f"{fx.duck_entries()}, heads AS (SELECT f.seq, f.id AS entry_id, f.form_ord, f.surface, {D_FLAGS} AS flags, c.pos FROM forms f JOIN codes c USING (id))"


@query(f"WITH {D_HEADS} SELECT entry_id, form_ord::INTEGER AS form_ord, surface, flags, array_to_string(pos, ',') AS pos FROM heads")
def headword_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.headwords(fx.raw_entries(spark)).select("entry_id", "form_ord", "surface", "flags", F.array_join("pos", ",").alias("pos"))


_D_NAMES = ", ".join(f"CASE WHEN x & {b} <> 0 THEN '{n}' END" for n, b in fl.FLAGS.items())


@query(f"SELECT x, array_to_string(list_filter([{_D_NAMES}], lambda n: n IS NOT NULL), ',') AS names FROM (SELECT range::INTEGER AS x FROM range(512))")
def flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(512).select(F.col("id").cast("int").alias("x")).select("x", F.array_join(fl.flag_names(F.col("x")), ",").alias("names"))


def _xml_file(spark: SparkSession) -> DataFrame:
    """The inline dictionary as rows of XML text, cut at entry ends as the reader cuts a file."""
    rows = []
    for e in fx.ENTRIES:
        k = "".join(f"<k_ele><keb>{t}</keb>{'<ke_pri>ichi1</ke_pri>' * p}</k_ele>" for t, p in e[1])
        r = "".join(f"<r_ele><reb>{t}</reb>{'<re_pri>news1</re_pri><re_pri>nf01</re_pri>' * p}</r_ele>" for t, p in e[2])
        s = "".join(
            "<sense>" + "".join(f"<pos>&{p};</pos>" for p in pos) + "".join(f"<misc> &{m}; </misc>" for m in misc) + "".join(f"<gloss>{g} &amp; so</gloss>" for g in glosses) + "</sense>"
            for pos, glosses, _, misc, _ in e[3]
        )
        rows.append((f"<entry><ent_seq>{e[0]}</ent_seq>{k}{r}{s}",))
    rows.append(("<entry><ent_seq>none</ent_seq><r_ele><reb>x</reb></r_ele>",))
    return spark.createDataFrame(rows, "value string").coalesce(1)


_XML_ROWS = [
    (e[0], ",".join(t for t, _ in e[1]), ",".join(f"{t}:{str(p).lower()}" for t, p in e[2]), ",".join(p for s in e[3] for p in s[0]), ",".join(m for s in e[3] for m in s[3]),
     "/".join(f"{g} & so" for s in e[3] for g in s[1]))
    for e in fx.ENTRIES
]


@query("WITH " + fx.values("x", "id, kanji, readings, pos, misc, glosses", _XML_ROWS) + " SELECT id::BIGINT AS id, kanji, readings, pos, misc, glosses FROM x")
def dict_xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dictionary_xml.raw_entries(dictionary_xml.entries_of_text(_xml_file(spark)))
    flat = lambda f: F.flatten(F.transform("senses", lambda s: s[f]))
    return raw.select(
        "id", F.array_join(F.transform("kanji", lambda k: k["text"]), ",").alias("kanji"),
        F.array_join(F.transform("readings", lambda r: F.concat(r["text"], F.lit(":"), r["has_priority"].cast("string"))), ",").alias("readings"),
        F.array_join(flat("pos"), ",").alias("pos"), F.array_join(flat("misc"), ",").alias("misc"), F.array_join(flat("glosses"), "/").alias("glosses"),
    )


@query(
    "WITH " + fx.values("x", "ent_seq", [*((str(e[0]),) for e in fx.ENTRIES), ("none",)]) + " SELECT count(*) FILTER (try_cast(ent_seq AS BIGINT) IS NULL) AS skipped FROM x"
)
def dict_xml_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_xml.entries_of_text(_xml_file(spark)).agg(dictionary_xml.count_skipped(F.col("ent_seq")).alias("skipped"))


_HEADS = [(0, "<?xml version='1.0'?>"), (1, "﻿  <JMdict>"), (2, "<!DOCTYPE JMdict ["), (3, "<html>"), (4, ""), (5, "x<?xml")]


@query("WITH " + fx.values("h", "i, head", _HEADS) + " SELECT i, regexp_matches(ltrim(regexp_replace(head, '^\\x{FEFF}', '')), '^\\s*(<\\?xml|<!DOCTYPE JMdict|<JMdict)') AS ok FROM h")
def sniff_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_HEADS, "i int, head string").select("i", dictionary_xml.is_dictionary_xml(F.col("head")).alias("ok"))


# --- grammar ----------------------------------------------------------------------------------------------------


def _grammar_rows() -> list[tuple]:
    return [
        (i, t["Name"], t["Part of Speech"] == "Adj", j, x["Tense"], x["Formal"] + 2 * x["Negative"], x["Suffix"], x.get("Next Type"))
        for i, t in enumerate(grammar_json.default_grammar())
        for j, x in enumerate(t["Tenses"])
    ]


_OTHER_TENSES = list(dict.fromkeys(r[4] for r in _grammar_rows() if r[4] not in grammar_json.TENSES))
D_GRAMMAR = (
    fx.values("rows_", "type_id, name, is_adj, conj, tense_name, form, suffix, next_name", _grammar_rows())
    + ",\n" + fx.values("tenses", "tense, tense_name", list(enumerate([*grammar_json.TENSES, *_OTHER_TENSES])))
    + f""",
    named AS (SELECT r.*, t.tense FROM rows_ r JOIN tenses t USING (tense_name)),
    types AS (SELECT type_id, name, CASE WHEN bool_or(tense = 0) THEN 0 ELSE 1 END AS remove_tense FROM named GROUP BY type_id, name),
    ends AS (SELECT n.type_id, n.name, n.conj, n.suffix AS ending FROM named n JOIN types t USING (type_id) WHERE n.tense = t.remove_tense AND n.form = 0),
    linked AS (SELECT n.type_id, n.conj, e.type_id AS target, left(n.suffix, length(n.suffix) - length(e.ending)) AS rest,
        row_number() OVER (PARTITION BY n.type_id, n.conj ORDER BY e.type_id, e.conj) AS k
        FROM named n JOIN ends e ON e.name = n.next_name AND length(n.suffix) >= length(e.ending) AND right({d_unify('n.suffix')}, length(e.ending)) = {d_unify('e.ending')}),
    grammar_edges AS (SELECT n.type_id::INTEGER AS type_id, n.conj::INTEGER AS conj, n.tense::INTEGER AS tense, n.form::INTEGER AS form, coalesce(l.rest, n.suffix) AS suffix,
        l.target::INTEGER AS next_type FROM named n LEFT JOIN linked l ON l.type_id = n.type_id AND l.conj = n.conj AND l.k = 1)"""
)


def _session(spark: SparkSession) -> str:
    return f"{spark.sparkContext.applicationId}/{spark._jsparkSession.hashCode()}"


@lru_cache(1)
def _grammar_of(session: str) -> gr.Grammar:
    spark = SparkSession.active()
    return gr.load(spark, grammar_json.default_grammar_json())


def _grammar(spark: SparkSession) -> gr.Grammar:
    return _grammar_of(_session(spark))


@query(f"WITH {D_GRAMMAR} SELECT * FROM grammar_edges")
def grammar_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grammar_json.rows_of(spark, grammar_json.default_grammar_json())
    return gr.resolve(rows)[0].edges.select("type_id", "conj", "tense", "form", "suffix", "next_type")


_BROKEN = [
    {"Name": "a", "Part of Speech": "Verb", "Tenses": [grammar_json._row("Remove", "る"), grammar_json._row("Stem", "た", "b"), grammar_json._row("Past", "x", "b")]},
    {"Name": "b", "Part of Speech": "Adj", "Tenses": [grammar_json._row("Remove", "タ"), grammar_json._row("Own Tense", "た", "none")]},
]


_BROKEN_ROWS = [(i, t["Name"], j, x["Suffix"], x["Tense"], x.get("Next Type")) for i, t in enumerate(_BROKEN) for j, x in enumerate(t["Tenses"])]


@query(
    "WITH " + fx.values("r", "type_id, name, conj, suffix, tense, next_name", _BROKEN_ROWS)
    + f""" SELECT type_id, name, conj, next_name FROM r WHERE next_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r e WHERE e.name = r.next_name AND e.tense = 'Remove'
        AND length(r.suffix) >= length(e.suffix) AND right({d_unify('r.suffix')}, length(e.suffix)) = {d_unify('e.suffix')})"""
)
def grammar_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.resolve(grammar_json.rows_of(spark, json.dumps(_BROKEN, ensure_ascii=False)))[1]


def _chain_text(chain: Column) -> Column:
    return F.array_join(F.transform(chain, lambda c: F.concat_ws(".", c["verb_type"], c["tense"], c["form"], c["conj"])), " ")


@query(
    f"""WITH RECURSIVE {D_GRAMMAR}, paths AS ({gr.closure_sql(False).replace("WITH RECURSIVE walk", "WITH RECURSIVE walk")})
    SELECT type_id, suffix_raw, suffix_key, n_chars::INTEGER AS n_chars,
        array_to_string(list_transform(chain, lambda c: concat_ws('.', c.verb_type, c.tense, c.form, c.conj)), ' ') AS chain, array_to_string(ord, '.') AS ord FROM paths"""
)
def conj_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = gr.closure(_grammar(spark))
    return paths.select("type_id", "suffix_raw", "suffix_key", "n_chars", _chain_text(F.col("chain")).alias("chain"), F.array_join("ord", ".").alias("ord"))


D_STEMS = f"""coded AS (SELECT h.*, unnest(h.pos) AS code, unnest(range(len(h.pos))) AS pos_ord FROM heads h),
    tagged AS (SELECT h.*, t.type_id AS annotated, t.name AS annotated_name FROM coded h JOIN types t ON t.name = h.code),
    tried AS (SELECT g.seq, g.entry_id, g.form_ord, g.flags, g.pos_ord, g.annotated, e.type_id AS verb_type, e.conj, g.annotated_name <> e.name AS by_fallback,
        left(g.surface, length(g.surface) - length(e.ending)) AS stem
        FROM tagged g JOIN ends e ON (e.name = g.annotated_name OR (starts_with(e.name, 'v5') AND starts_with(g.annotated_name, 'v5') AND length(e.name) = length(g.annotated_name)))
            AND length(g.surface) >= length(e.ending) AND (e.ending = '' OR right({d_unify('g.surface')}, length(e.ending)) = {d_unify('e.ending')})),
    firsts AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY seq, form_ord, pos_ord, annotated, verb_type ORDER BY conj) = 1),
    stems AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY seq, form_ord, stem, verb_type ORDER BY pos_ord, annotated, conj) = 1)"""


@query(f"WITH {D_HEADS}, {D_GRAMMAR}, {D_STEMS} SELECT entry_id, form_ord::INTEGER AS form_ord, stem, flags, verb_type::INTEGER AS verb_type, by_fallback FROM stems")
def stem_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.stems(lexicon.headwords(fx.raw_entries(spark)), _grammar(spark))
    return out.select("entry_id", "form_ord", F.col("surface").alias("stem"), "flags", "verb_type", "by_fallback")


@query(
    f"""WITH {D_HEADS}, {D_GRAMMAR}, {D_STEMS}, recs AS (SELECT surface, flags, NULL AS verb_type, entry_id FROM heads UNION SELECT stem, flags, verb_type, entry_id FROM stems)
    SELECT (SELECT count(DISTINCT {d_unify('surface')}) FROM recs) AS keys, (SELECT count(*) FROM recs) AS records, (SELECT count(*) FROM codes) AS entries,
        count(*) FILTER (NOT by_fallback) AS exact_stems, count(*) FILTER (by_fallback) AS v5_fallback_stems, count(*) FILTER (stem = '') AS empty_stems, 0::BIGINT AS skipped FROM stems"""
)
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw_entries(spark)
    heads = lexicon.headwords(raw)
    stemmed = lexicon.stems(heads, _grammar(spark))
    return lexicon.build_report(None, lexicon.lexicon(heads, stemmed), raw, stemmed)


# --- a lexicon from the part names: words, and words in pseudo-kana ------------------------------------------------

D_WORDS = f"""words AS (SELECT word, dense_rank() OVER (ORDER BY word) AS entry_id FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''),
    lex AS (SELECT {d_unify('word')} AS key, length(word) AS key_chars, word AS surface,
        (CASE WHEN entry_id % 2 = 0 THEN 8 ELSE 0 END | CASE WHEN entry_id % 3 = 0 THEN 16 ELSE 0 END | CASE WHEN entry_id % 5 = 0 THEN 32 ELSE 0 END | 1)::INTEGER AS flags, entry_id FROM
        (SELECT word, entry_id FROM words UNION ALL SELECT upper(word[1:3]), 1000 + entry_id FROM words))"""


def _word_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names and their first three letters as capitals; ids in order, flags by arithmetic."""
    from pyspark.sql import Window

    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''").distinct()
    words = words.select("word", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("word")).cast("long").alias("entry_id"))  # two dozen words
    both = words.union(words.select(F.upper(F.substring("word", 1, 3)), F.col("entry_id") + 1000))
    bit = lambda n, b: F.when(F.col("entry_id") % n == 0, b).otherwise(0)
    flags = bit(2, fl.COMMON).bitwiseOR(bit(3, fl.PARTICLE)).bitwiseOR(bit(5, fl.COUNTER)).bitwiseOR(F.lit(fl.PRIMARY))
    return both.select(
        kana.unify(F.col("word")).alias("key"), F.length("word").alias("key_chars"), F.col("word").alias("surface"), flags.alias("flags"),
        F.lit(None).cast("int").alias("verb_type"), "entry_id", F.struct(F.col("entry_id").alias("seq")).alias("ord"),
    )


@query(f"WITH {D_WORDS} SELECT key, key_chars::INTEGER AS key_chars, surface, flags, entry_id FROM lex")
def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_lexicon(spark, sf_dir).select("key", "key_chars", "surface", "flags", "entry_id")


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names behind their numbers, so that digits come before words."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_size", F.lit(" "), "p_name", "p_size").alias("text"))


D_TEXTS = "texts AS (SELECT p_partkey AS doc_id, p_size || ' ' || p_name || p_size AS text FROM part)"
D_HITS = f"""hits AS MATERIALIZED (SELECT t.doc_id, i::INTEGER AS start, l.key_chars::INTEGER AS len, l.surface, l.flags, l.entry_id, {d_fold('substr(t.text, i::INTEGER + 1, l.key_chars::INTEGER)')} <> {d_fold('l.surface')} AS inexact, t.text
    FROM (SELECT doc_id, text, unnest(range(length(text))) AS i FROM texts) t JOIN lex l ON starts_with({d_unify('substr(t.text, i::INTEGER + 1)')}, l.key))"""


@query(f"WITH {D_WORDS}, {D_TEXTS}, {D_HITS} SELECT doc_id, start, len, surface, flags, entry_id, inexact FROM hits")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = matching.prefix_hits(_part_texts(spark, sf_dir), _word_lexicon(spark, sf_dir))
    return hits.select("doc_id", "start", F.col("key_chars").alias("len"), "surface", "flags", "entry_id", "inexact")


@query(f"WITH {D_TEXTS} SELECT doc_id, unnest(range(length(text)))::INTEGER AS start, 0 AS len FROM texts")
def prefix_lookup_empty_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([("", 0, "", 1, 5, 7, (0,))], "key string, key_chars int, surface string, flags int, verb_type int, entry_id long, ord struct<seq:long>")
    hits = matching.prefix_hits(_part_texts(spark, sf_dir), empty)
    return hits.select("doc_id", "start", F.col("key_chars").alias("len"))


def _part_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = matching.prefix_hits(_part_texts(spark, sf_dir), _word_lexicon(spark, sf_dir))
    plain = hits.select(
        "doc_id", "start", F.col("key_chars").alias("len"), F.col("key_chars").alias("src_len"), "surface", "flags", "entry_id", "inexact",
        F.array().cast(matching.EMPTY_CHAIN).alias("chain"), F.struct("key_chars", "ord", F.array().cast("array<int>").alias("path")).alias("ord"),
    )
    return matching.dedupe(plain)


D_DIGIT = f"regexp_matches(substr(text, start + 1, 1), '{kana.DIGIT}')"
D_COST = f"""scored AS MATERIALIZED (SELECT *, regexp_matches(substr(text, 1, start), '[0-9０-９一二三四五六七八九十百千万][ 　]*\\z') AS after_number,
    10 + CASE WHEN flags & 16 <> 0 THEN -2 WHEN len = 1 THEN 1 WHEN start > 0 AND {D_DIGIT} AND regexp_matches(substr(text, start, 1), '{kana.DIGIT}') THEN 100 ELSE 0 END
    + CASE WHEN flags & 12 <> 0 THEN -3 ELSE 0 END + CASE WHEN flags & 32 <> 0 AND regexp_matches(substr(text, 1, start), '[0-9０-９一二三四五六七八九十百千万][ 　]*\\z') THEN -2 ELSE 0 END
    + CASE WHEN inexact THEN 10 ELSE 0 END AS cost FROM hits)"""


@query(f"WITH {D_WORDS}, {D_TEXTS}, {D_HITS}, {D_COST} SELECT doc_id, start, len, entry_id, after_number, cost::BIGINT AS cost FROM scored")
def edge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.scored(_part_matches(spark, sf_dir), _part_texts(spark, sf_dir))
    return out.select("doc_id", "start", "len", "entry_id", "after_number", "cost")


#: Least (cost, skip, length) at each position, one position a step for all texts at once.
D_FOLD = """edges AS MATERIALIZED (SELECT doc_id, start + len AS dst, len, min(cost) AS cost FROM scored GROUP BY ALL),
    ins AS MATERIALIZED (SELECT doc_id, dst, list({'cost': cost, 'len': len}) AS es FROM edges GROUP BY ALL),
    fold(doc_id, n, i, cells, t) AS (
        SELECT doc_id, length(text), 0::BIGINT, [{'cost': 0::BIGINT, 'skip': 0, 'len': 0::BIGINT}], text FROM texts
      UNION ALL
        SELECT f.doc_id, f.n, f.i + 1, list_append(f.cells, list_min(list_concat([{'cost': f.cells[f.i + 1].cost
            + CASE WHEN regexp_matches(substr(f.t, f.i + 1, 1), '[\\x{4E00}-\\x{9FBF}]') THEN 500 ELSE 100 END, 'skip': 1, 'len': 1::BIGINT}],
            list_transform(coalesce(x.es, []), lambda e: {'cost': f.cells[f.i + 2 - e.len].cost + e.cost, 'skip': 0, 'len': e.len::BIGINT})))), f.t
        FROM fold f LEFT JOIN ins x ON x.doc_id = f.doc_id AND x.dst = f.i + 1 WHERE f.i < f.n),
    done AS MATERIALIZED (SELECT * FROM fold WHERE i = n),
    back(doc_id, pos, cells, start, len, skip) AS (
        SELECT doc_id, n, cells, n - cells[n + 1].len, cells[n + 1].len, cells[n + 1].skip FROM done WHERE n > 0
      UNION ALL
        SELECT doc_id, start, cells, start - cells[start + 1].len, cells[start + 1].len, cells[start + 1].skip FROM back WHERE start > 0)"""


@query(f"WITH RECURSIVE {D_WORDS}, {D_TEXTS}, {D_HITS}, {D_COST}, {D_FOLD} SELECT doc_id, cells[n + 1].cost AS total_cost FROM done")
def segment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _part_texts(spark, sf_dir)
    edges = segment.edges_of(segment.scored(_part_matches(spark, sf_dir), texts))
    return segment.fold_costs(texts, edges)


def _part_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = _part_texts(spark, sf_dir)
    scored = segment.scored(_part_matches(spark, sf_dir), texts)
    solved = segment.paths(texts, segment.edges_of(scored))
    return texts, scored, segment.spans(solved)


D_SPANS = """steps AS (SELECT b.doc_id, b.start, b.len, b.skip, b.pos - row_number() OVER (PARTITION BY b.doc_id, b.skip ORDER BY b.start) AS island FROM back b),
    path_spans AS (SELECT doc_id, min(start) AS start, sum(len) AS len, skip = 0 AS matched FROM steps GROUP BY doc_id, skip, CASE WHEN skip = 1 THEN island ELSE -1 - start END)"""


@query(
    f"""WITH RECURSIVE {D_WORDS}, {D_TEXTS}, {D_HITS}, {D_COST}, {D_FOLD}, {D_SPANS}
    SELECT p.doc_id, p.start::INTEGER AS start, p.len::INTEGER AS len, matched, substr(t.text, p.start::INTEGER + 1, p.len::INTEGER) AS surface FROM path_spans p JOIN texts t USING (doc_id)"""
)
def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_paths(spark, sf_dir)[2]


@query(
    f"""WITH RECURSIVE {D_WORDS}, {D_TEXTS}, {D_HITS}, {D_COST}, {D_FOLD}, {D_SPANS}
    SELECT doc_id, count(*) AS runs, sum(len)::BIGINT AS chars FROM path_spans WHERE NOT matched GROUP BY doc_id"""
)
def unmatched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _part_paths(spark, sf_dir)[2]
    return spans.where("NOT matched").groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum("len").alias("chars"))


D_RANKED = """aligned AS (SELECT s.doc_id, s.start, s.len, s.surface, s.entry_id, CASE WHEN s.flags & 32 <> 0 AND NOT s.after_number THEN s.flags & ~32 ELSE s.flags END AS flags, s.inexact
        FROM scored s JOIN path_spans p ON p.doc_id = s.doc_id AND p.start = s.start AND p.len = s.len AND p.matched),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, len ORDER BY inexact, (flags & 61) DESC, entry_id) AS rank
        FROM (SELECT * REPLACE (min(inexact) OVER (PARTITION BY doc_id, start, len, entry_id) AS inexact) FROM aligned))"""


@query(f"WITH RECURSIVE {D_WORDS}, {D_TEXTS}, {D_HITS}, {D_COST}, {D_FOLD}, {D_SPANS}, {D_RANKED} SELECT doc_id, start, len, entry_id, flags, inexact, rank::INTEGER AS rank FROM ranked")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored, spans = _part_paths(spark, sf_dir)
    return rank.ranked(rank.aligned(spans, scored)).select("doc_id", "start", "len", "entry_id", "flags", "inexact", "rank")


@query(
    f"""WITH RECURSIVE {D_WORDS}, {D_TEXTS}, {D_HITS}, {D_COST}, {D_FOLD}, {D_SPANS}, {D_RANKED}
    SELECT doc_id, start, count(*) AS n, greatest(count(*) - 5, 0) AS more, string_agg(entry_id, ',' ORDER BY rank) FILTER (rank <= 5) AS top, max(entry_id) FILTER (rank = 1) AS primary_entry
    FROM ranked GROUP BY doc_id, start"""
)
def top5_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored, spans = _part_paths(spark, sf_dir)
    r = rank.ranked(rank.aligned(spans, scored)).groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("rank", "entry_id"))).alias("e"))
    ids = F.transform("e", lambda x: x["entry_id"].cast("string"))
    n = F.size("e")
    return r.select("doc_id", "start", n.cast("long").alias("n"), F.greatest(n - 5, F.lit(0)).cast("long").alias("more"), F.array_join(F.slice(ids, 1, 5), ",").alias("top"), F.get("e", F.lit(0))["entry_id"].alias("primary_entry"))


_TOKENS = [(0, 0, 2, "n,,,,,,,トウキョウ,x"), (0, 2, 5, "n,,,,,,,*"), (0, 5, 9, "v,,,,,,,ヨミマシタ"), (1, 0, 1, "p,,,,,,,ハ"), (1, 1, 4, "x,y"), (2, 0, 3, "n,,,,,,,")]


@query(
    "WITH "
    + fx.values("tokens", "doc_id, s, e, feature", _TOKENS)
    + """, inner_ AS (SELECT doc_id, unnest(range(s, e - 1)) AS p FROM tokens WHERE coalesce(string_split(feature, ',')[8], '') NOT IN ('', '*')),
    both_ AS (SELECT doc_id, p AS pos, false AS s, true AS e FROM inner_ UNION ALL SELECT doc_id, p + 1, true, false FROM inner_)
    SELECT doc_id::BIGINT AS doc_id, pos::INTEGER AS pos, bool_or(s) AS bad_start, bool_or(e) AS bad_end FROM both_ GROUP BY doc_id, pos"""
)
def hints_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.interior_hints(spark.createDataFrame(_TOKENS, "doc_id long, tok_start int, tok_end int, feature string"))


# --- whole analyses of the sentences --------------------------------------------------------------------------------


@lru_cache(1)
def _dictionary_of(session: str) -> parse.Dictionary:
    spark = SparkSession.active()
    d = parse.build(fx.raw_entries(spark), _grammar(spark))
    return parse.Dictionary(stored(d.lexicon), d.entries, d.grammar, stored(d.paths))


def _dictionary(spark: SparkSession) -> parse.Dictionary:
    return _dictionary_of(_session(spark))


D_LEXICON = f"""recs AS (SELECT surface, flags, NULL::INTEGER AS verb_type, entry_id, {{'seq': seq, 'form_ord': form_ord, 'stem_ord': []::BIGINT[]}} AS met FROM heads
    UNION ALL SELECT stem, flags, verb_type::INTEGER, entry_id, {{'seq': seq, 'form_ord': form_ord, 'stem_ord': [pos_ord, annotated, verb_type]::BIGINT[]}} FROM stems),
    lex AS (SELECT {d_unify('surface')} AS key, length(surface) AS key_chars, surface, flags, verb_type, entry_id, min(met) AS met FROM recs GROUP BY ALL)"""
D_SENTENCES = fx.values("texts", "doc_id, text", fx.SENTENCES)
D_CHAIN = "array_to_string(list_transform(chain, lambda c: concat_ws('.', c.verb_type, c.tense, c.form, c.conj)), ' ')"
D_MATCHES = f"""places AS (SELECT doc_id, text, unnest(range(length(text))) AS i FROM texts),
    found AS (SELECT a.doc_id, a.text, a.i, l.*, {d_fold('substr(a.text, a.i::INTEGER + 1, l.key_chars::INTEGER)')} <> {d_fold('l.surface')} AS loose FROM places a JOIN lex l ON starts_with({d_unify('substr(a.text, a.i::INTEGER + 1)')}, l.key)),
    every AS (SELECT doc_id, i AS start, key_chars AS len, key_chars AS src_len, surface, flags, entry_id, loose AS inexact, '' AS chain, {{'n': key_chars, 'met': met, 'path': []::INTEGER[]}} AS ord, NULL::INTEGER AS conj0
        FROM found WHERE verb_type IS NULL
      UNION ALL SELECT f.doc_id, f.i, f.key_chars + p.n_chars, f.key_chars, f.surface, f.flags, f.entry_id,
        f.loose OR {d_fold('substr(f.text, (f.i + f.key_chars)::INTEGER + 1, p.n_chars::INTEGER)')} <> {d_fold('p.suffix_raw')}, {D_CHAIN}, {{'n': f.key_chars, 'met': f.met, 'path': p.ord::INTEGER[]}}, p.chain[1].conj::INTEGER
        FROM found f JOIN paths p ON p.type_id = f.verb_type AND substr({d_unify('f.text')}, (f.i + f.key_chars)::INTEGER + 1, p.n_chars::INTEGER) = p.suffix_key)"""


@query(
    f"""WITH RECURSIVE {D_HEADS}, {D_GRAMMAR}, {D_STEMS}, {D_LEXICON}, paths AS ({gr.closure_sql(False)}), {D_SENTENCES}, {D_MATCHES}
    SELECT doc_id::BIGINT AS doc_id, start::INTEGER AS start, len::INTEGER AS len, src_len::INTEGER AS src_len, surface, flags, entry_id, bool_and(inexact) AS inexact, chain
    FROM every WHERE len > 0 GROUP BY ALL"""
)
def sentence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionary(spark)
    out = matching.matches(fx.sentences(spark), d.lexicon, d.paths)
    return out.select("doc_id", "start", "len", "src_len", "surface", "flags", "entry_id", "inexact", _chain_text(F.col("chain")).alias("chain"))


D_ANALYSIS = f"""{D_HEADS}, {D_GRAMMAR}, {D_STEMS}, {D_LEXICON}, paths AS MATERIALIZED ({gr.closure_sql(False)}), {D_SENTENCES}, {D_MATCHES},
    hits AS MATERIALIZED (SELECT e.doc_id, t.text, e.start, e.len, e.src_len, e.surface, e.flags, e.entry_id, e.chain, e.conj0, bool_and(e.inexact) AS inexact, min(e.ord) AS ord
        FROM every e JOIN texts t USING (doc_id) WHERE e.len > 0 GROUP BY ALL),
    {D_COST}, {D_FOLD}, {D_SPANS}"""


@query(
    f"""WITH RECURSIVE {D_ANALYSIS} SELECT p.doc_id::BIGINT AS doc_id, p.start::INTEGER AS start, p.len::INTEGER AS len, p.matched,
        substr(t.text, p.start::INTEGER + 1, p.len::INTEGER) AS surface, (d.cells[d.n + 1].cost)::BIGINT AS total_cost
    FROM path_spans p JOIN texts t USING (doc_id) JOIN done d USING (doc_id)"""
)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark)
    return p.spans.join(p.solved.select("doc_id", "total_cost"), "doc_id").select("doc_id", "start", "len", "matched", "surface", "total_cost")


_D_NAMED = fx.duck([*grammar_json.TENSES, *_OTHER_TENSES])


D_ALTERNATIVES = f"""on_path AS (SELECT s.*, CASE WHEN s.flags & 32 <> 0 AND NOT s.after_number THEN s.flags & ~32 ELSE s.flags END AS shown,
        try_cast(nullif(split_part(split_part(s.chain, ' ', 1), '.', 1), '') AS INTEGER) AS type0, split_part(split_part(s.chain, ' ', 1), '.', 2) AS tense0,
        split_part(split_part(s.chain, ' ', 1), '.', 3) AS form0, substr(s.text, (s.start + s.src_len)::INTEGER + 1, (s.len - s.src_len)::INTEGER) AS tail
        FROM scored s JOIN path_spans p ON p.doc_id = s.doc_id AND p.start = s.start AND p.len = s.len AND p.matched),
    counted AS (SELECT *, count(*) FILTER (chain <> '') OVER w AS n_verbs, count(*) FILTER (chain = '') OVER w AS n_plain, min(inexact) OVER w AS loose
        FROM on_path WINDOW w AS (PARTITION BY doc_id, start, len, entry_id)),
    first_ends AS (SELECT type_id, arg_min(ending, conj) AS ending FROM ends GROUP BY type_id),
    kept AS (SELECT c.*, c.surface || coalesce(f.ending, '') AS headword,
        nullif(array_to_string(list_filter(list_transform(string_split(c.chain, ' '), lambda l, i: concat_ws(' ',
            CASE WHEN try_cast(split_part(l, '.', 3) AS INTEGER) & 2 <> 0 THEN 'Negative' END, CASE WHEN try_cast(split_part(l, '.', 3) AS INTEGER) & 1 <> 0 THEN 'Formal' END,
            CASE WHEN split_part(l, '.', 2) <> '2' AND NOT (i > 1 AND split_part(l, '.', 2) = '1' AND (i > 2 OR c.tense0 <> '2'))
                THEN ({_D_NAMED})[try_cast(split_part(l, '.', 2) AS INTEGER) + 1] END)), lambda w: w <> ''), ' '), '') AS conjugation,
        row_number() OVER (PARTITION BY doc_id, start, len ORDER BY loose, shown & {fl.IS_NAME} <> 0, shown & {fl.RANKED} DESC, entry_id,
            coalesce(try_cast(form0 AS INTEGER), 0), coalesce(type0 + 1, 0), coalesce(try_cast(tense0 AS INTEGER), 0), ord) AS rank
        FROM counted c LEFT JOIN first_ends f ON f.type_id = c.type0
        WHERE NOT (c.chain <> '' AND c.tense0 = '1' AND c.form0 = '0' AND c.n_verbs = 1 AND c.n_plain > 0))"""


@query(
    f"""WITH RECURSIVE {D_ANALYSIS}, {D_ALTERNATIVES}
    SELECT doc_id::BIGINT AS doc_id, start::INTEGER AS start, len::INTEGER AS len, rank::INTEGER AS rank, entry_id, shown AS flags, loose AS inexact, headword, conjugation FROM kept"""
)
def sentence_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark)
    ranks = p.ranked.select("doc_id", "start", "len", "rank", F.col("flags").alias("bits"), "inexact")
    out = p.alternatives.join(ranks, ["doc_id", "start", "len", "rank"])
    return out.select("doc_id", "start", "len", "rank", "entry_id", F.col("bits").alias("flags"), "inexact", "headword", "conjugation")


@query(
    "WITH RECURSIVE " + D_GRAMMAR + ", paths AS (" + gr.closure_sql(False) + ")" + """,
    words AS (SELECT type_id, ord, unnest(chain) AS l, unnest(range(len(chain))) AS i, chain[1].tense AS t0 FROM paths),
    said AS (SELECT type_id, ord, i, concat_ws(' ', CASE WHEN l.form & 2 <> 0 THEN 'Negative' END, CASE WHEN l.form & 1 <> 0 THEN 'Formal' END,
        CASE WHEN l.tense <> 2 AND NOT (i > 0 AND l.tense = 1 AND (i > 1 OR t0 <> 2)) THEN t.tense_name END) AS w FROM words JOIN tenses t ON t.tense = l.tense)
    SELECT type_id, array_to_string(ord, '.') AS ord, nullif(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (w <> ''), ''), '') AS label FROM said GROUP BY type_id, ord"""
)
def conj_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grammar(spark)
    return gr.closure(g).select("type_id", F.array_join("ord", ".").alias("ord"), gr.conjugation_label(F.col("chain"), assemble.tense_array(g)).alias("label"))


D_TWINS = f"""pairs AS (SELECT a.type_id, a.conj, b.type_id AS twin, b.suffix, length(a.suffix) AS n, length(b.suffix) AS m, b.conj AS bc
        FROM grammar_edges a JOIN types ta ON ta.type_id = a.type_id JOIN types tb ON tb.name = ta.name AND tb.type_id <> ta.type_id JOIN grammar_edges b ON b.type_id = tb.type_id
        WHERE a.tense = b.tense AND a.form = b.form AND a.next_type IS NOT DISTINCT FROM b.next_type AND regexp_matches(a.suffix, '^{kana.IDEOGRAPH}') AND length(b.suffix) >= length(a.suffix)
            AND {d_unify('substr(a.suffix, 2)')} = {d_unify('substr(b.suffix, length(b.suffix) - length(a.suffix) + 2)')}),
    nearest AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY type_id, conj, twin ORDER BY m, bc) = 1),
    twins AS (SELECT type_id, conj, arg_min(left(suffix, (m - n + 1)::INTEGER), twin) AS substitution FROM nearest WHERE m - n + 1 <= 3 GROUP BY type_id, conj)"""


@query(f"WITH {D_GRAMMAR}, {D_TWINS} SELECT * FROM twins")
def twin_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.twins(_grammar(spark))


def _parsed(spark: SparkSession, hints: DataFrame | None = None) -> parse.Parsed:
    return parse.parse(fx.sentences(spark), _dictionary(spark), hints)


_D_SHOWN = ", ".join(f"CASE WHEN shown & {bit} <> 0 THEN '{n}' END" for n, bit in fl.FLAGS.items())
_D_CUT = f"length(r.r) >= length(e.ending) AND (e.ending = '' OR right({d_unify('r.r')}, length(e.ending)) = {d_unify('e.ending')})"
_D_ENTRY = "'headword': headword, 'reading': reading, 'conjugation': conjugation, 'pos': pos, 'senses': senses, 'flags': flags"
#: Readings, then one row for each alternative and for each segment.
D_RESULT = f"""{D_ANALYSIS}, {D_ALTERNATIVES}, {D_TWINS}, {fx.duck_senses()},
    read_ AS (SELECT id AS entry_id, surface AS r, row_number() OVER (PARTITION BY id ORDER BY form_ord) AS r_ord FROM forms WHERE is_reading AND n_kanji > 0),
    ways AS (SELECT k.doc_id, k.start, k.len, k.rank, {{'r_ord': r.r_ord, 'way': 0, 'twin': e.type_id, 'conj': e.conj}} AS way, left(r.r, length(r.r) - length(e.ending)) || k.tail AS reading
        FROM kept k JOIN read_ r USING (entry_id) JOIN ends e ON e.type_id = k.type0 AND {_D_CUT}
      UNION ALL SELECT k.doc_id, k.start, k.len, k.rank, {{'r_ord': r.r_ord, 'way': 1, 'twin': e.type_id, 'conj': e.conj}},
        left(r.r, length(r.r) - length(e.ending)) || t.substitution || substr(k.tail, 2)
        FROM kept k JOIN read_ r USING (entry_id) JOIN types y ON y.type_id = k.type0 JOIN twins t ON t.type_id = k.type0 AND t.conj = k.conj0
            JOIN ends e ON e.name = y.name AND e.type_id <> k.type0 AND {_D_CUT} WHERE length(k.tail) >= 1),
    verb_readings AS (SELECT doc_id, start, len, rank, arg_min(reading, way) AS verb_reading FROM ways GROUP BY ALL),
    meanings AS (SELECT id AS entry_id, list({{'pos': s.pos, 'glosses': s.glosses, 'xrefs': []::VARCHAR[], 'misc': CASE WHEN i = 1 THEN c.misc ELSE []::VARCHAR[] END, 'info': []::VARCHAR[]}} ORDER BY i) AS senses
        FROM senses s JOIN codes c USING (id) GROUP BY id),
    alts AS (SELECT k.doc_id, k.start, k.len, k.rank::INTEGER AS rank, k.headword, k.conjugation, c.pos, m.senses, list_filter([{_D_SHOWN}], lambda n: n IS NOT NULL) AS flags,
        CASE WHEN k.shown & {fl.PRONOUNCE} <> 0 THEN NULL WHEN k.chain = '' THEN f.r ELSE v.verb_reading END AS reading
        FROM kept k JOIN codes c ON c.id = k.entry_id JOIN meanings m USING (entry_id) LEFT JOIN read_ f ON f.entry_id = k.entry_id AND f.r_ord = 1
            LEFT JOIN verb_readings v ON v.doc_id = k.doc_id AND v.start = k.start AND v.len = k.len AND v.rank = k.rank),
    segments AS MATERIALIZED (SELECT p.doc_id::BIGINT AS doc_id, p.start::INTEGER AS start, p.len::INTEGER AS len, any_value(substr(t.text, p.start::INTEGER + 1, p.len::INTEGER)) AS surface,
        any_value(p.matched) AS matched, arg_min(a.reading, a.rank) FILTER (a.rank = 1) AS reading, coalesce(list({{{_D_ENTRY}}} ORDER BY a.rank) FILTER (a.rank IS NOT NULL), []) AS entries
        FROM path_spans p JOIN texts t USING (doc_id) LEFT JOIN alts a ON a.doc_id = p.doc_id AND a.start = p.start AND a.len = p.len GROUP BY p.doc_id, p.start, p.len)"""


def _entries_json() -> Column:
    bare = F.transform("entries", lambda e: e.dropFields("rank"))
    return F.to_json(bare, {"ignoreNullFields": "false"})


@query(f"WITH RECURSIVE {D_RESULT} SELECT doc_id, start, len, surface, reading, matched, to_json(entries)::VARCHAR AS entries FROM segments")
def parse_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark)
    return p.segments.select("doc_id", "start", "len", "surface", "reading", "matched", _entries_json().alias("entries"))


@query(
    f"""WITH RECURSIVE {D_RESULT} SELECT doc_id, to_json({{'segments': list({{'start': start, 'len': len, 'surface': surface, 'reading': reading, 'matched': matched, 'entries': entries}}
        ORDER BY start)}})::VARCHAR AS json FROM segments GROUP BY doc_id"""
)
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.result_json(_parsed(spark).segments)


_HINT_TOKENS = [(1, 0, 3, "n,,,,,,,トウキョウト"), (5, 0, 2, "n,,,,,,,サンボン")]
D_HINTED = D_ANALYSIS.replace(
    D_COST,
    D_COST.replace("scored AS", "unhinted AS")
    + ",\n" + fx.values("tokens", "doc_id, s, e, feature", _HINT_TOKENS)
    + """, within AS (SELECT doc_id, unnest(range(s, e - 1)) AS p FROM tokens),
    scored AS MATERIALIZED (SELECT u.* REPLACE (u.cost + CASE WHEN EXISTS (SELECT 1 FROM within w WHERE w.doc_id = u.doc_id AND w.p + 1 = u.start) THEN 10 ELSE 0 END
        + CASE WHEN EXISTS (SELECT 1 FROM within w WHERE w.doc_id = u.doc_id AND w.p = u.start + u.len - 1) THEN 10 ELSE 0 END AS cost) FROM unhinted u)""",
)


@query(
    f"""WITH RECURSIVE {D_HINTED} SELECT p.doc_id::BIGINT AS doc_id, p.start::INTEGER AS start, p.len::INTEGER AS len, p.matched,
        substr(t.text, p.start::INTEGER + 1, p.len::INTEGER) AS surface FROM path_spans p JOIN texts t USING (doc_id)"""
)
def parse_with_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = segment.interior_hints(spark.createDataFrame(_HINT_TOKENS, "doc_id long, tok_start int, tok_end int, feature string"))
    return _parsed(spark, hints).spans


_D_HEAD_LINE = "'start=' || start || ' len=' || len || ' ' || surface || CASE WHEN matched THEN ' matched reading=' || coalesce(reading, '-') ELSE ' unmatched' END"
_D_ENTRY_LINE = "'    ' || e.headword || ' (' || coalesce(e.conjugation, '-') || ') [' || coalesce(e.reading, '-') || '] '"


@query(
    f"""WITH RECURSIVE {D_RESULT} SELECT doc_id, start, concat_ws(chr(10), {_D_HEAD_LINE},
        nullif(array_to_string(list_transform(entries, lambda e: {_D_ENTRY_LINE} || array_to_string(e.senses[1].glosses, '; ')), chr(10)), '')) AS lines FROM segments"""
)
def parse_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.listing(_parsed(spark).segments)


@query(
    f"""WITH RECURSIVE {D_RESULT} SELECT doc_id, start, concat_ws(chr(10), {_D_HEAD_LINE},
        nullif(array_to_string(list_transform(entries[1:1], lambda e: {_D_ENTRY_LINE} || e.senses[1].glosses[1]), chr(10)), ''),
        CASE WHEN len(entries) > 1 THEN '    ... ' || (len(entries) - 1) || ' more' END) AS lines FROM segments"""
)
def parse_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one alternative of each segment, so that some have more; the operator's own default shows five."""
    return assemble.listing(_parsed(spark).segments, 1)


_D_LABELS = ", ".join(f"CASE WHEN l.flags & {bit} <> 0 THEN '{n}' END" for n, bit in fl.LOOKUP_LABELS)


@query(
    f"""WITH {D_HEADS}, {D_GRAMMAR}, {D_STEMS}, {D_LEXICON}, {D_SENTENCES}, {fx.duck_senses()}
    SELECT t.doc_id::BIGINT AS doc_id, l.key_chars::INTEGER AS key_chars, l.surface, coalesce(y.name, '-') AS type, concat_ws(',', {_D_LABELS}) AS labels,
        array_to_string(s.glosses, '; ') AS glosses
    FROM texts t JOIN lex l ON length(t.text) > 0 AND starts_with({d_unify('t.text')}, l.key) LEFT JOIN types y ON y.type_id = l.verb_type JOIN senses s ON s.id = l.entry_id AND s.i = 1"""
)
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionary(spark)
    return matching.lookup(fx.sentences(spark), d.lexicon, d.grammar.types, d.entries).drop("ord")


D_TOOLTIPS = f"""{D_RESULT}, tips AS (SELECT doc_id, start, array_to_string(list_transform(entries, lambda e: concat_ws(chr(10), chr(1) || e.conjugation, e.headword || coalesce('【' || e.reading || '】', ''),
        array_to_string(list_transform(e.senses, lambda s, i: '(' || array_to_string(s.pos, ',') || ') (' || i || ') ' || array_to_string(s.glosses, '/')
            || CASE WHEN list_contains(e.flags, 'common') AND i = len(e.senses) THEN '/(P)' ELSE '' END), chr(10)))), chr(10)) AS tooltip FROM segments WHERE matched)"""


@query(f"WITH RECURSIVE {D_TOOLTIPS} SELECT * FROM tips")
def tooltip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.tooltip(_parsed(spark).segments)


_D_KANA, _D_CJK = "\\x{3040}-\\x{30FF}", "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}々"


@query(
    f"""WITH RECURSIVE {D_TOOLTIPS},
    lines AS (SELECT doc_id, start, unnest(string_split(tooltip, chr(10))) AS l, unnest(range(len(string_split(tooltip, chr(10))))) AS line FROM tips),
    cut AS (SELECT *, CASE WHEN starts_with(l, chr(1)) THEN [l[2:]] ELSE regexp_extract_all(l, '\\([^()]*\\)|[{_D_KANA}{_D_CJK}【】][{_D_KANA}{_D_CJK}】]*|[^(【】{_D_KANA}{_D_CJK}]+') END AS runs FROM lines),
    each_ AS (SELECT doc_id, start, line, starts_with(l, chr(1)) AS label, unnest(runs) AS text, unnest(range(len(runs))) AS run FROM cut)
    SELECT doc_id, start, line::INTEGER AS line, run::INTEGER AS run, text, CASE WHEN label THEN 'conj' WHEN starts_with(text, '(') THEN 'paren' WHEN regexp_matches(text, '[{_D_CJK}]') THEN 'kanji'
        WHEN regexp_matches(text, '[{_D_KANA}【】]') THEN 'kana' ELSE 'text' END AS kind FROM each_"""
)
def tooltip_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.coloured(assemble.tooltip(_parsed(spark).segments))


@query(
    f"""WITH RECURSIVE {D_RESULT} SELECT doc_id, start, surface, CASE WHEN NOT matched THEN 'unmatched' WHEN list_contains(entries[1].flags, 'particle') THEN 'particle'
        WHEN list_contains(entries[1].flags, 'counter') THEN 'counter' WHEN regexp_matches(surface, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN 'kanji' ELSE 'kana' END AS chip FROM segments"""
)
def chip_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.chip_class(_parsed(spark).segments)


@query(
    f"""WITH RECURSIVE {D_WORDS}, {D_TEXTS}, {D_HITS}, {D_COST}, {D_FOLD}, {D_SPANS}
    SELECT p.doc_id, p.start::INTEGER AS start, p.len::INTEGER AS len, matched, substr(t.text, p.start::INTEGER + 1, p.len::INTEGER) AS surface FROM path_spans p JOIN texts t USING (doc_id)
    WHERE p.start = 3"""
)
def segment_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that begin at a place: a filter."""
    return assemble.segment_at(_part_paths(spark, sf_dir)[2], 3)


@query(f"WITH {D_HEADS}, {D_GRAMMAR}, {D_STEMS}, {D_LEXICON} SELECT key, key_chars::INTEGER AS key_chars, surface, flags, verb_type, entry_id FROM lex")
def lexicon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = lexicon.headwords(fx.raw_entries(spark))
    return lexicon.lexicon(heads, lexicon.stems(heads, _grammar(spark))).drop("ord")


@query(f"WITH {D_GRAMMAR} SELECT count(DISTINCT type_id) AS types, count(*) AS rows_, count(next_type) AS linked FROM grammar_edges")
def grammar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.counts(_grammar(spark))


@query()
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against a lexicon of benchmark words: the throughput query."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("surface")).where("length(surface) > 1").distinct()
    words = words.select(kana.unify(F.col("surface")).alias("key"), F.length("surface").alias("key_chars"), "surface", F.lit(0).alias("flags"), F.xxhash64("surface").alias("entry_id"))
    texts = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    solved = scan.paths_of_words(texts, words)
    return solved.select("doc_id", "total_cost", F.size("spans").alias("n_spans"), F.size(F.filter("spans", lambda s: s["matched"])).alias("n_matched"))


@query(
    f"""WITH {D_WORDS}, joined AS (SELECT string_agg({d_unify("text")}, chr(10)) AS corpus FROM benchmark)
    SELECT entry_id, surface FROM lex, joined WHERE contains(corpus, key)"""
)
def subset_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon rows whose key occurs in the benchmark texts."""
    lex = _word_lexicon(spark, sf_dir)
    texts = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    grams = matching.probes(texts, matching.key_lengths(lex)).select("key").distinct()
    return lex.join(grams, "key", "left_semi").select("entry_id", "surface")


@query(
    f"""WITH {D_HEADS}, {D_GRAMMAR}, {D_SENTENCES}, keys AS (SELECT entry_id, {d_unify('surface')} AS key FROM heads
        UNION SELECT h.entry_id, left({d_unify('h.surface')}, length(h.surface) - length(e.ending)) FROM heads h JOIN (SELECT DISTINCT {d_unify('ending')} AS ending FROM ends WHERE ending <> '') e
            ON ends_with({d_unify('h.surface')}, e.ending) WHERE len(list_filter(h.pos, lambda p: regexp_matches(p, '^(v|adj-)'))) > 0)
    SELECT DISTINCT entry_id AS id FROM keys k WHERE k.key = '' OR EXISTS (SELECT 1 FROM texts t WHERE contains({d_unify('t.text')}, k.key))"""
)
def subset_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.needed_entries(fx.raw_entries(spark), fx.sentences(spark), _grammar(spark)).select("id")


# --- generations and streams ------------------------------------------------------------------------------------------

D_GENERATIONS = """names AS (SELECT CASE i % 5 WHEN 0 THEN 'gen-' || i WHEN 1 THEN 'gen-0' || i WHEN 2 THEN '.build-' || i WHEN 3 THEN 'gen-' || i || 'x' ELSE 'gen-' || (i * 7) END AS name
    FROM range(40) t(i)), numbered AS (SELECT name, try_cast(nullif(regexp_extract(name, '^gen-(0|[1-9][0-9]*)$', 1), '') AS BIGINT) AS number FROM names)"""


def _names(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    s = i.cast("string")
    name = (
        F.when(i % 5 == 0, F.concat(F.lit("gen-"), s)).when(i % 5 == 1, F.concat(F.lit("gen-0"), s)).when(i % 5 == 2, F.concat(F.lit(".build-"), s))
        .when(i % 5 == 3, F.concat(F.lit("gen-"), s, F.lit("x"))).otherwise(F.concat(F.lit("gen-"), (i * 7).cast("string")))
    )
    return spark.range(40).select(name.alias("name"))


@query(f"WITH {D_GENERATIONS} SELECT arg_max(name, number) AS name, max(number) AS number FROM numbered")
def generation_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations.latest(_names(spark))


@query(f"WITH {D_GENERATIONS} SELECT name, number FROM numbered ORDER BY number DESC NULLS LAST")
def generation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations.listing(_names(spark))


@query(
    f"""WITH {D_GENERATIONS} SELECT name FROM (SELECT name, row_number() OVER (ORDER BY number DESC) AS k FROM numbered WHERE number IS NOT NULL) WHERE k > 2
    UNION ALL SELECT name FROM names WHERE starts_with(name, '.build-')"""
)
def generation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations.doomed(_names(spark))


def _event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("text"))


@query(
    """SELECT user_id, ts, event_type AS text FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE k = 1 OR event_type IS DISTINCT FROM before"""
)
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.without_repeats_batch(_event_texts(spark, sf_dir))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS text, max(ts) AS ts FROM events GROUP BY user_id")
def stream_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.latest(_event_texts(spark, sf_dir))
