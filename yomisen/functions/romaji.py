"""Kana to Latin letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kana import UNIFY_FROM

_VOWELS = "aiueo"
#: Rows of the syllabary by consonant, in vowel order, and syllables that are written otherwise.
_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ",
    "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ", "w": "ワヰ・ヱヲ", "y": "ヤ・ユ・ヨ", "v": "ヷヸヴヹヺ",
}
_IRREGULAR = {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "dzu"}
#: What a kana becomes before a small ya, yu, yo, and before small vowels.
_BEFORE_YA = {
    "キ": "ky", "シ": "sh", "チ": "ch", "ニ": "ny", "ヒ": "hy", "ミ": "my", "リ": "ry", "ヰ": "wy", "ギ": "gy", "ヂ": "j", "ジ": "j", "ビ": "by", "ピ": "py",
    "ス": "sy", "ズ": "zy", "テ": "ty", "デ": "dy", "フ": "fy", "ウ": "wy",
}
_BEFORE_VOWEL = {
    "イ": ("y", "ィェ"), "ユ": ("y", "ィェ"), "ヴ": ("v", "ァィ"), "シ": ("sh", "ェ"), "ジ": ("j", "ェ"), "チ": ("ch", "ェ"), "ス": ("s", "ィ"),
    "ズ": ("z", "ィ"), "テ": ("t", "ィ"), "ト": ("t", "ゥ"), "デ": ("d", "ィ"), "ド": ("d", "ゥ"), "ツ": ("ts", "ァィェォ"), "フ": ("f", "ァィェォ"),
    "ホ": ("h", "ゥ"), "リ": ("ry", "ェ"), "ウ": ("w", "ァィェォ"), "ク": ("kw", "ァヮィゥェォ"), "グ": ("gw", "ァヮィゥェォ"),
}
_SMALL = dict(zip("ァィゥェォ", _VOWELS, strict=True)) | {"ヮ": "a"}


def _tables() -> tuple[dict[str, str], dict[str, str]]:
    one = {k: c + v for c, row in _ROWS.items() for k, v in zip(row, _VOWELS, strict=True) if k != "・"}
    one |= _IRREGULAR | {"ン": "n"} | _SMALL | {"ャ": "ya", "ュ": "yu", "ョ": "yo", "ヮ": "wa"}
    two = {k + small: c + v for k, c in _BEFORE_YA.items() for small, v in zip("ャュョ", "auo", strict=True)}
    two |= {k + small: c + _SMALL[small] for k, (c, row) in _BEFORE_VOWEL.items() for small in row}
    return one, two


ONE, TWO = _tables()
_FOLD_FROM = UNIFY_FROM[:85]
_FOLD_TO = "".join(chr(ord(c) + 0x60) for c in _FOLD_FROM)


def _either(kana: str) -> str:
    """A class of a katakana and its hiragana."""
    low = chr(ord(kana) - 0x60)
    return f"[{kana}{low}]" if low in _FOLD_FROM else kana


#: One chunk: two kana that are read together, else any character.
CHUNK = "(?s)" + "|".join(_either(k[0]) + _either(k[1]) for k in sorted(TWO)) + "|."
#: Doubles a consonant.
DOUBLED = {k: ("t" if v[0] == "c" else v[0]) for k, v in ONE.items() if v[0] not in "aeiouy"}
#: Kana before which n gets an apostrophe.
AFTER_N = "[ァアィイゥウェエォオャヤュユョヨ]"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def to_romaji(text: Column) -> Column:
    """Kana in Latin letters, other characters as they are.

    The text is cut into chunks of one or two kana, each of which is looked up
    with a view to the next.
    """
    chunks = F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))

    def letters(chunk: Column, i: Column) -> Column:
        kana = F.translate(chunk, _FOLD_FROM, _FOLD_TO)
        following = F.translate(F.substring(F.coalesce(F.get(chunks, i + 1), F.lit("")), 1, 1), _FOLD_FROM, _FOLD_TO)
        plain = F.try_element_at(_map(ONE | TWO), kana)
        return (
            F.when(kana == "ー", F.lit("̄"))
            .when(kana == "ッ", F.coalesce(F.try_element_at(_map(DOUBLED), following), chunk))
            .when((kana == "ン") & following.rlike(AFTER_N), F.lit("n'"))
            .otherwise(F.coalesce(plain, chunk))
        )

    return F.array_join(F.transform(chunks, letters), "")


def particle_romaji(romaji: Column) -> Column:
    """The reading of a particle: he is e, and a final ha not after c is wa."""
    stem = F.substring(romaji, F.lit(1), F.length(romaji) - 2)
    wa = F.endswith(romaji, F.lit("ha")) & ~F.endswith(romaji, F.lit("cha"))
    return F.when(romaji == "he", F.lit("e")).when(wa, F.concat(stem, F.lit("wa"))).otherwise(romaji)
