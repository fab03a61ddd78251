"""Conjugation grammars: reading them, and one of our own.

A grammar is a JSON list of types, each with ``Name``, ``Part of Speech`` (Verb
or Adj) and ``Tenses``: a list of ``Tense``, ``Formal``, ``Negative``, ``Suffix``
and, for forms that conjugate further, ``Next Type``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tense names with fixed numbers; others are numbered as they are met.
TENSES = (
    "Remove", "Non-past", "Stem", "Potential", "Past", "Te-form", "Conditional", "Provisional", "Passive", "Causative", "Caus-Pass", "Volitional",
    "Conjectural", "Adverbal", "Alternative", "Imperative", "Imperfective", "Continuative", "Hypothetical", "Prenominal",
)
REMOVE, NON_PAST, STEM, POTENTIAL = range(4)
SCHEMA = (
    "Name STRING, `Part of Speech` STRING, "
    "Tenses ARRAY<STRUCT<Formal: BOOLEAN, Negative: BOOLEAN, Suffix: STRING, Tense: STRING, `Next Type`: STRING>>"
)


def read_grammar(spark: SparkSession, path: str) -> str:
    """The text of a grammar file (UTF-8, or UTF-16 with a byte order mark)."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    if bytes(content[:2]) in (b"\xff\xfe", b"\xfe\xff"):
        return bytes(content).decode("utf-16")
    return bytes(content).decode("utf-8-sig")


def fingerprint(text: str) -> int:
    """FNV-1a over the grammar's bytes: binds a dictionary to the grammar it was built with."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def rows_of(spark: SparkSession, text: str) -> DataFrame:
    """One row per tense of each type: ``(type_id, name, is_adjective, conj, tense_name, form, suffix, next_name)``.

    A part of speech other than Verb and Adj raises an error.
    """
    types = spark.createDataFrame([(text,)], "json string").select(F.posexplode(F.from_json("json", f"ARRAY<STRUCT<{_inner()}>>")))
    types = types.select(F.col("pos").alias("type_id"), "col.*")
    part = F.col("Part of Speech")
    checked = F.when(part.isin("Verb", "Adj"), part == "Adj").otherwise(
        F.raise_error(F.concat(F.lit("unsupported part of speech: "), F.coalesce(part, F.lit("null")))).cast("boolean")
    )
    rows = types.select("type_id", F.col("Name").alias("name"), checked.alias("is_adjective"), F.posexplode("Tenses").alias("conj", "t"))
    form = F.col("t.Formal").cast("int").bitwiseOR(F.shiftleft(F.col("t.Negative").cast("int"), 1))
    return rows.select(
        "type_id", "name", "is_adjective", "conj", F.col("t.Tense").alias("tense_name"), form.alias("form"),
        F.col("t.Suffix").alias("suffix"), F.col("t.`Next Type`").alias("next_name"),
    )


def _inner() -> str:
    return SCHEMA.replace("Name STRING", "Name: STRING").replace("`Part of Speech` STRING", "`Part of Speech`: STRING").replace("Tenses ARRAY", "Tenses: ARRAY")


def _row(tense: str, suffix: str, next_type: str | None = None, formal: bool = False, negative: bool = False) -> dict:
    out = {"Tense": tense, "Formal": formal, "Negative": negative, "Suffix": suffix}
    return out | ({"Next Type": next_type} if next_type else {})


def _verb_tail(short_a: str, stem_i: str, stem_e: str, past: str, te: str, potential: str, passive: str, volitional: str, imperative: str) -> list[dict]:
    """Rows that all verbs share, from their stems."""
    return [
        _row("Non-past", short_a + "ない", "adj-i", negative=True),
        _row("Stem", stem_i, "v-i-stem"),
        _row("Stem", past, "v-ta-stem"),
        _row("Te-form", te),
        _row("Potential", potential, "v1"),
        _row("Passive", passive, "v1"),
        _row("Causative", short_a + "せる" if stem_i else short_a + "させる", "v1"),
        _row("Provisional", stem_e + "ば"),
        _row("Volitional", volitional),
        _row("Imperative", imperative),
        _row("Continuative", stem_i),
    ]


#: Each five-row verb's endings in a, i, u, e, o, and its past.
_GODAN = {
    "v5u": "わいうえおった", "v5k": "かきくけこいた", "v5k-s": "かきくけこった", "v5g": "がぎぐげごいだ", "v5s": "さしすせそした", "v5t": "たちつてとった",
    "v5n": "なにぬねのんだ", "v5b": "ばびぶべぼんだ", "v5m": "まみむめもんだ", "v5r": "らりるれろった", "v5r-i": "らりるれろった", "v5u-s": "わいうえおうた",
}


def default_grammar() -> list[dict]:
    """A compact grammar of modern Japanese, written for this library from public knowledge of the language."""
    types: list[dict] = []

    def add(name: str, rows: list[dict], part: str = "Verb") -> None:
        types.append({"Name": name, "Part of Speech": part, "Tenses": rows})

    add("adj-i", [
        _row("Remove", "い"), _row("Remove", "し"), _row("Non-past", "い"), _row("Past", "かった"), _row("Non-past", "くない", "adj-i", negative=True),
        _row("Te-form", "くて"), _row("Adverbal", "く"), _row("Provisional", "ければ"), _row("Conjectural", "かろう"), _row("Adj Stem", ""),
    ], "Adj")
    add("adj-na", [
        _row("Remove", ""), _row("Non-past", "です", formal=True), _row("Non-past", "だ"), _row("Past", "だった"), _row("Prenominal", "な"),
        _row("Te-form", "で"), _row("Adverbal", "に"),
    ], "Adj")
    add("copula", [
        _row("Remove", "だ"), _row("Remove", "である"), _row("Non-past", "だ"), _row("Past", "だった"), _row("Te-form", "で"),
        _row("Non-past", "です", formal=True), _row("Past", "でした", formal=True),
    ])
    add("v1", [
        _row("Remove", "る"), _row("Non-past", "る"), _row("Stem", "", "v-i-stem"), _row("Stem", "", "v-a-stem"), _row("Stem", "た", "v-ta-stem"),
        _row("Past", "なかった", negative=True), _row("Te-form", "て"), _row("Potential", "られる", "v1"), _row("Passive", "られる", "v1"),
        _row("Causative", "させる", "v1"), _row("Provisional", "れば"), _row("Volitional", "よう"), _row("Imperative", "ろ"),
    ])
    for name, x in _GODAN.items():
        a, i, u, e, o, past = x[0], x[1], x[2], x[3], x[4], x[5:]
        te = past[:-1] + {"た": "て", "だ": "で"}[past[-1]]
        tail = _verb_tail("" if name == "v5r-i" else a, i, e, past, te, e + "る", a + "れる", o + "う", e)
        add(name, [_row("Remove", u), _row("Non-past", u), *tail])
    add("v5aru", [_row("Remove", "る"), _row("Non-past", "る"), *_verb_tail("ら", "い", "れ", "った", "って", "れる", "られる", "ろう", "い")])
    for written in ("う", "得"):
        add("v5uru", [
            _row("Remove", written + "る"), _row("Remove", "える"), _row("Non-past", written + "る"), _row("Stem", "", "v-i-stem"), _row("Stem", "", "v-a-stem"),
        ])
    add("vz", [_row("Remove", "ずる"), _row("Non-past", "ずる"), _row("Stem", "じ", "v-i-stem"), _row("Stem", "じた", "v-ta-stem"), _row("Te-form", "じて")])
    for k, i, o in (("来", "来", "来"), ("く", "き", "こ")):
        add("vk", [
            _row("Remove", k + "る"), _row("Non-past", k + "る"), _row("Stem", i + "た", "v-ta-stem"), _row("Stem", i, "v-i-stem"), _row("Te-form", i + "て"),
            _row("Potential", o + "られる", "v1"), _row("Passive", o + "られる", "v1"), _row("Non-past", o + "ない", "adj-i", negative=True),
            _row("Provisional", k + "れば"), *([_row("Imperfective", "来")] if k == "来" else []),
        ])
    suru = [
        _row("Remove", "する"), _row("Non-past", "する"), _row("Stem", "し", "v-i-stem"), _row("Stem", "した", "v-ta-stem"), _row("Te-form", "して"),
        _row("Non-past", "しない", "adj-i", negative=True), _row("Passive", "される", "v1"), _row("Causative", "させる", "v1"), _row("Provisional", "すれば"),
        _row("Volitional", "しよう"),
    ]
    add("vs", [_row("Remove", ""), _row("Stem", "する", "vs-i"), _row("Stem", "した", "v-ta-stem")])
    add("vs", [_row("Remove", ""), _row("Stem", "する", "vs-i")])
    add("vs-s", [_row("Remove", "する"), _row("Non-past", "する"), *suru[2:5]])
    add("vs-i", suru)
    add("v-i-stem", [
        _row("Remove", ""), _row("Non-past", "ます", formal=True), _row("Past", "ました", formal=True), _row("Non-past", "ません", formal=True, negative=True),
        _row("Past", "ませんでした", formal=True, negative=True), _row("Volitional", "ましょう", formal=True), _row("Te-form", "まして", formal=True),
        _row("-Masu Stem/Continuative/Nominalizer", ""), _row("Non-past", "たい", "adj-i"),
    ])
    add("v-a-stem", [_row("Remove", ""), _row("Non-past", "ない", "adj-i", negative=True), _row("Te-form", "ないで", negative=True)])
    add("v-ta-stem", [_row("Remove", ""), _row("Past", ""), _row("Conditional", "ら"), _row("Alternative", "り"), _row("Past Volitional", "ろう")])
    add("v-u-stem", [_row("Remove", ""), _row("Conjectural", "だろう"), _row("Conjectural", "でしょう", formal=True)])
    add("adj-ta", [_row("Remove", ""), _row("Adverbal", "と"), _row("Prenominal", "たる")], "Adj")
    return types


def default_grammar_json() -> str:
    return json.dumps(default_grammar(), ensure_ascii=False)
