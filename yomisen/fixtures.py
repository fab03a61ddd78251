"""Small inline tables, freshly written: a dictionary, sentences, and the same as SQL for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENTRY_SCHEMA = (
    "seq long, id long, kanji array<struct<text:string,has_priority:boolean>>, readings array<struct<text:string,has_priority:boolean>>, "
    "senses array<struct<pos:array<string>,glosses:array<string>,xrefs:array<string>,misc:array<string>,info:array<string>>>"
)


def _entry(number: int, kanji: str, readings: str, *senses: tuple) -> tuple:
    def forms(text: str) -> list[tuple[str, bool]]:
        return [(w.rstrip("!"), w.endswith("!")) for w in text.split()]

    full = [(pos.split(), glosses, [], (misc[0].split() if misc else []), []) for pos, glosses, *misc in senses]
    return (number, forms(kanji), forms(readings), full)


#: Forms with an exclamation mark have a priority marker.
ENTRIES = [
    _entry(1000010, "洗う!", "あらう!", ("v5u vt", ["to wash", "to rinse"])),
    _entry(1000020, "読む!", "よむ!", ("v5m vt", ["to read"])),
    _entry(1000025, "話す", "はなす", ("v5r vt", ["to speak"])),
    _entry(1000030, "", "も", ("prt", ["also", "too"])),
    _entry(1000035, "", "を!", ("prt", ["object marker"])),
    _entry(1000040, "本!", "ほん!", ("n", ["book"])),
    _entry(1000045, "本", "ほん", ("ctr", ["counter for long things"])),
    _entry(1000046, "匹", "ひき", ("ctr", ["old counter"], "arch")),
    _entry(1000050, "食べる!", "たべる!", ("v1 vt", ["to eat"]), ("v1", ["to live on"])),
    _entry(1000060, "来る!", "くる!", ("vk vi", ["to come"])),
    _entry(1000070, "", "する!", ("vs-i", ["to do"])),
    _entry(1000080, "勉強!", "べんきょう!", ("n vs", ["study"])),
    _entry(1000090, "良い!", "よい! いい", ("adj-i", ["good", "fine"])),
    _entry(1000100, "東京!", "とうきょう!", ("n", ["Tokyo"])),
    _entry(1000110, "京都", "きょうと", ("n", ["Kyoto"])),
    _entry(1000120, "都", "と", ("n suf", ["metropolis"])),
    _entry(1000130, "三!", "さん!", ("num", ["three"])),
    _entry(1000140, "", "バナナ!", ("n", ["banana"])),
    _entry(1000150, "静か", "しずか", ("adj-na", ["quiet"])),
    _entry(1000160, "", "ホン", ("n", ["phon"])),
]

SENTENCES = [
    (0, "本も読みました"), (1, "東京都も良い"), (2, "洗わなかった"), (3, "来た"), (4, "勉強しました"), (5, "三本のバナナを食べる"),
    (6, "ホンも本"), (7, ""), (8, "abc 12"), (9, "良くなかった本を話さない"), (10, "静かな東京"), (11, "３ 本読ませられた"), (12, "来られる々"),
    (13, "ほんをよむ"), (14, "食べさせられたかった"),
]


def raw_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(ENTRIES)], ENTRY_SCHEMA)


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENTENCES, "doc_id long, text string")


def duck(value) -> str:
    """A Python value as a DuckDB literal; tuples become structs by the names given in :func:`values`."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(duck, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"'{k}': {duck(v)}" for k, v in value.items()) + "}"
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(duck, r)) + ")" for r in rows) + ")"


def duck_senses() -> str:
    """``senses(id, i, pos, glosses)``, i from 1."""
    return values("senses", "id, i, pos, glosses", [(e[0], i, s[0], s[1]) for e in ENTRIES for i, s in enumerate(e[3], 1)])


def duck_entries() -> str:
    """The dictionary as two tables: forms in order, and parts of speech and misc codes by entry."""
    forms = [
        (seq, e[0], i, text, pri, i >= len(e[1]), len(e[1]))
        for seq, e in enumerate(ENTRIES)
        for i, (text, pri) in enumerate([*e[1], *e[2]])
    ]
    codes = [(e[0], list(dict.fromkeys(p for s in e[3] for p in s[0])), [m for s in e[3] for m in s[3]], [g for s in e[3] for g in s[1]]) for e in ENTRIES]
    return (
        values("forms", "seq, id, form_ord, surface, pri, is_reading, n_kanji", forms) + ",\n"
        + "codes(id, pos, misc, glosses) AS (VALUES " + ", ".join(f"({i}, {duck(p)}, {duck(m)}::VARCHAR[], {duck(g)})" for i, p, m, g in codes) + ")"
    )
