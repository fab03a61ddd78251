"""Character functions as Column expressions.

All positions count code points, as Spark's string functions do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIRAGANA = [chr(x) for x in range(0x3041, 0x3096)]
_WIDE = [chr(x) for x in range(0xFF01, 0xFF20)]
_LOWER = [chr(x) for x in range(ord("a"), ord("z") + 1)]
UNIFY_FROM = "".join(_HIRAGANA + _WIDE + _LOWER)
UNIFY_TO = "".join([chr(ord(c) + 0x60) for c in _HIRAGANA] + [chr(ord(c) - 0xFEE0) for c in _WIDE] + [c.upper() for c in _LOWER])
FOLD_FROM, FOLD_TO = "".join(_LOWER), "".join(_LOWER).upper()
KATAKANA_FROM = "".join(chr(x) for x in range(0x3040, 0x30A0))
KATAKANA_TO = "".join(chr(x + 0x60) for x in range(0x3040, 0x30A0))

#: Character classes, for Java's, Python's and RE2's regular expressions alike.
HIRAGANA = r"[\x{3040}-\x{309F}]"
KATAKANA = r"[\x{30A0}-\x{30FA}\x{30FC}-\x{30FF}]"
HALF_WIDTH_KATAKANA = r"[\x{FF65}-\x{FF9B}]"
IDEOGRAPH = r"[\x{4E00}-\x{9FBF}]"
KANJI = r"[\x{3005}\x{4E00}-\x{9FBF}]"
JAPANESE = r"[\x{3005}\x{3040}-\x{30FA}\x{30FC}-\x{30FF}\x{4E00}-\x{9FBF}\x{FF65}-\x{FF9B}]"
DIGIT = r"[0-9\x{FF10}-\x{FF19}一二三四五六七八九十百千万]"
CLIPBOARD_JAPANESE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"


def unify(text: Column) -> Column:
    """Hiragana to katakana, full-width ASCII punctuation and digits to ASCII, then a-z to A-Z: the key form."""
    return F.translate(text, UNIFY_FROM, UNIFY_TO)


def unify_text(text: str) -> str:
    return text.translate(str.maketrans(UNIFY_FROM, UNIFY_TO))


def strict_fold(text: Column) -> Column:
    """Folds the case of a-z only; two texts are strictly equal if this is equal."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def strict_eq(a: Column, b: Column) -> Column:
    return strict_fold(a) == strict_fold(b)


def unified_eq(a: Column, b: Column) -> Column:
    return unify(a) == unify(b)


def to_katakana(text: Column) -> Column:
    """The whole hiragana block moved by 0x60, as displayed; everything else as it is."""
    return F.translate(text, KATAKANA_FROM, KATAKANA_TO)


def has(text: Column, chars: str) -> Column:
    return text.rlike(chars)


def consists_of(text: Column, chars: str) -> Column:
    return text.rlike(rf"\A{chars}+\z")


def char_class(char: Column) -> Column:
    """The class of one character: hiragana, katakana, halfwidth, kanji, digit or other."""
    return (
        F.when(char.rlike(HIRAGANA), "hiragana")
        .when(char.rlike(KATAKANA), "katakana")
        .when(char.rlike(HALF_WIDTH_KATAKANA), "halfwidth")
        .when(char.rlike(DIGIT), "digit")
        .when(char.rlike(KANJI), "kanji")
        .otherwise("other")
    )


def strip_suffix_unified(text: Column, suffix: Column) -> Column:
    """``text`` without ``suffix`` if it ends with it kana-insensitively (possibly empty), else null."""
    n = F.length(suffix)
    rest = F.length(text) - n
    ends = (rest >= 0) & (unify(F.substring(text, rest + 1, n)) == unify(suffix))
    return F.when(n == 0, text).when(ends, F.substring(text, F.lit(1), rest))


def should_parse(text: Column, last: Column, most: int = 10_000) -> Column:
    """Whether a polled text is worth parsing: short enough, Japanese, and not the last one."""
    fresh = ~text.eqNullSafe(last)
    return (F.length(text) <= most) & text.rlike(CLIPBOARD_JAPANESE) & fresh
