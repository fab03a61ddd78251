"""Secret scan: fixed patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax (``name = "literal"``, ``name:
literal``, ``"name": "literal"``, ``export NAME=literal``, ``:=``, ``=>``, sums of
literals and names, subscripts, types, brackets and calls around values, values
on the next line) into pairs of a name and the literals it gets.  Constants are
propagated: a name that takes its value from another name hands its sensitivity
back to that name's literals.  A literal is reported if its target's name, or one
that gets it, is sensitive and the literal doesn't look like a placeholder.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

#: Kinds in the order in which equal starts are listed; the last is the lexer's.
KINDS = ("assign", "access", "hex", "lexed")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns.  The lengths are tested after matching, so that a failing match still uses up its characters.
_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is the same as a run, tested for its length
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: How a literal is written in each kind of quotes.
_STRINGS = {'"': r'"(?:[^"\\\n]|\\.)*"', "'": r"'(?:[^'\\\n]|\\.)*'", "`": r"`[^`\n]*`"}


_OTHER = r"""(?P<op>:=|=>|(?<![=!<>])=(?!=)|:)
      | (?P<plus>\+)
      | (?P<name>[A-Za-z_$][A-Za-z0-9_$.\-]*)
      | (?P<bare>[A-Za-z0-9+/_.=~!@%^&*\-]{8,})
      | (?P<end>[\n;,{}()\[\]])"""


@lru_cache
def _token_pattern(quotes: str) -> re.Pattern:
    """Tokens of a line in which only these quotes still close; one that doesn't is ``loose``."""
    strings = [f"(?P<string>{'|'.join(_STRINGS[q] for q in quotes)})"] if quotes else []
    loose = [f"(?P<loose>[{quotes}])"] if quotes else []
    return re.compile("|".join([*strings, _OTHER, *loose]), re.X)


def tokens(line: str) -> Iterator[re.Match]:
    """The tokens of a line.  Where one quote doesn't close, no later one of its kind does, so none is tried again."""
    quotes, at = "".join(_STRINGS), 0
    while True:
        for m in _token_pattern(quotes).finditer(line, at):
            if m.lastgroup == "loose":
                quotes, at = quotes.replace(m.group(), ""), m.end()
                break
            yield m
        else:
            return


#: Parts of a target's name and how strongly they speak for a secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3,
    "private": 1, "key": 1, "auth": 1, "access": 1, "api": 1, "signing": 1, "encryption": 1, "bearer": 2, "salt": 1, "dsn": 2,
}
HARMLESS = {"file", "path", "name", "url", "uri", "length", "size", "type", "id", "public", "policy", "expires", "count", "field", "header"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%\(.*\)s|your.*|change.?me.*|example.*|none|null|true|false|todo|dummy|placeholder|test)$")
#: Types that may stand between a name and what it gets.
TYPES = frozenset("string str byte bytes rune char".split())
LEAST_SCORE = 4.0
MAY_ASSIGN = re.compile(r"[=:]")


def name_parts(name: str) -> list[str]:
    """``dbPassWord-2`` to lower-case parts, with ``apikey`` and the like also as one."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)
    return [w.lower() for w in words]


def sensitivity(name: str) -> int:
    """How strongly a name speaks for a secret; 0 if it doesn't."""
    parts = name_parts(name)
    joined = "".join(parts)
    total = sum(SENSITIVE.get(p, 0) for p in set(parts))
    total = max([total, *(v for k, v in SENSITIVE.items() if v >= 2 and k in joined)])
    return 0 if parts and parts[-1] in HARMLESS else total


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def literal_score(name_score: int, value: str) -> float:
    """The name's part, and the value's length and evenness; placeholders and short values give nothing."""
    if name_score < 2 or len(value) < 6 or " " in value or PLACEHOLDER.match(value):
        return 0.0
    mixed = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return name_score + min(entropy(value), 4) / 2 + (mixed >= 2) * 0.5


#: Names that get a value, its literals with their places, and the names of other values in it.
Pair = tuple[list[str], list[tuple[str, int, int]], list[str]]


class _Place:
    """What has been read of one statement, or of one argument in brackets that belong to a value."""

    def __init__(self, kind: str = "line") -> None:
        self.kind = kind  # "line"; "group": brackets around values; "subscript": brackets right after a value's name
        self.clear()

    def clear(self) -> None:
        self.targets: list[str] = []  # the names that get the value, once an operator was read
        self.op = ""
        self.last: list[str] = []  # the names that a following operator would assign to
        self.end = -1  # where in the text they end
        self.literals: list[tuple[str, int, int]] = []
        self.inner: list[tuple[str, int, int]] = []  # those of brackets within
        self.names: list[str] = []

    def pairs(self) -> Iterator[Pair]:
        if self.targets:
            yield self.targets, self.literals + self.inner, self.names

    def take(self, place: _Place) -> None:
        """What a place within holds is part of the value; the shorter lists are moved, so that nesting costs no more."""
        kept = [x for x in place.literals if not _is_a_key(x[0])]
        self.inner = _joined(self.inner, _joined(place.inner, kept))
        self.names = _joined(self.names, place.names)


def _joined(a: list, b: list) -> list:
    """Both in one of them, which are then no one else's."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    long += short
    return long


class _Reader:
    """Reads assignments line by line; brackets of a value and values that begin on the next line are carried on."""

    def __init__(self) -> None:
        self.places = [_Place()]
        self.goes_on = False  # the line ended in an operator or a plus
        self.key: list[str] | None = None  # within a target's subscript: what it holds

    @property
    def open(self) -> bool:
        return self.goes_on or bool(self.places[0].targets)

    def _shut(self) -> Iterator[Pair]:
        """Ends the innermost argument; one that assigns nothing is part of the value around it."""
        place = self.places[-1]
        if len(self.places) > 1 and not place.targets and place.kind == "group":
            self.places[-2].take(place)
        yield from place.pairs()
        place.clear()

    def close(self) -> Iterator[Pair]:
        """Ends everything that is open."""
        while len(self.places) > 1:
            yield from self._shut()
            self.places.pop()
        yield from self._shut()
        self.goes_on, self.key = False, None

    def line(self, line: str, at: int) -> Iterator[Pair]:
        first, carried = True, self.open
        if carried and not line.strip():
            yield from self.close()
        for m in tokens(line):
            kind, value, place = m.lastgroup, m.group(), self.places[-1]
            if first and carried and len(self.places) == 1 and kind != "plus" and not (self.goes_on and (kind == "string" or value == "(")):
                yield from self.close()
            first, self.goes_on = False, False
            if self.key is not None and value != "]":
                if kind in ("string", "name"):
                    self.key = [value[1:-1]] if kind == "string" else [*place.last, value]
                elif kind == "end":
                    self.key = None
                    yield from self.close()
            elif kind == "op":
                self._operator(value)
            elif kind == "plus":
                self.goes_on = bool(place.targets or len(self.places) > 1)
            elif kind == "end":
                yield from self._bracket(value, m.start(), line, at)
            else:
                self._value(kind, value, m, line, at, carried)
        place = self.places[-1]
        self.goes_on = self.goes_on or bool(place.targets and not place.literals and not place.inner and not place.names and place.kind == "line")
        if len(self.places) == 1 and not place.targets:
            yield from self.close()

    def _operator(self, op: str) -> None:
        place = self.places[-1]
        if place.kind == "subscript" or not place.last:
            return
        if not place.targets:
            place.targets, place.literals, place.inner, place.names = [*place.last], [], [], []
        elif place.names and not place.literals and not place.inner:
            if op == ":":
                place.targets = [*place.last]  # key: key2: literal
            elif place.op != ":":
                place.targets += place.last  # a = b = "literal"
            place.names = []  # else name: type = "literal"
        else:
            return
        place.op, place.last = op, []
        self.goes_on = True

    def _bracket(self, value: str, start: int, line: str, at: int) -> Iterator[Pair]:
        place = self.places[-1]
        valued = place.targets or len(self.places) > 1
        touches = place.end == at + start
        if value == "[" and not valued and place.last and (touches or line[start + 1 : start + 2] == "]"):
            self.key = []
        elif value == "]" and self.key is not None:
            place.last, self.key = self.key or place.last, None
            place.end = at + start + 1
        elif value in "([" and valued:
            self.places.append(_Place("subscript" if value == "[" and touches else "group"))
        elif value in ")]" and len(self.places) > 1:
            yield from self._shut()
            self.places.pop()
            self.places[-1].end = at + start + 1
        elif value == "," and len(self.places) > 1:
            yield from self._shut()
        else:
            yield from self.close()

    def _value(self, kind: str, value: str, m: re.Match, line: str, at: int, carried: bool) -> None:
        place = self.places[-1]
        if place.targets or len(self.places) > 1:
            if kind == "string":
                place.literals.append((value[1:-1], at + m.start() + 1, at + m.end() - 1))
            elif re.search(r"\d", value) and len(value) >= 8:
                # an unquoted value with digits in it is a literal, else a name
                if not carried:
                    place.literals.append((value, at + m.start(), at + m.end()))
            else:
                place.names.append(value)
        if kind == "name":
            typed = value in TYPES and place.last and not place.targets and not line[max(place.end - at, -1) : m.start()].strip(" \t*&[]")
            if not typed:  # name type = "literal"
                place.last = [value]
        elif kind == "string":
            place.last = [value[1:-1]] if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$.\-]*", value[1:-1]) else []
        place.end = at + m.end()


def _is_a_key(value: str) -> bool:
    """A call's argument that names a secret and isn't one, as in ``getenv("DB_PASSWORD")``."""
    return bool(re.fullmatch(r"[A-Za-z_.\-]+", value)) and sensitivity(value) > 0


def pairs(text: str) -> Iterator[Pair]:
    """``(names, literals with their places, names of other values)`` of each assignment."""
    at, reader = 0, _Reader()
    for line in text.split("\n"):
        if reader.open or MAY_ASSIGN.search(line):
            yield from reader.line(line, at)
        at += len(line) + 1
    yield from reader.close()


def lexed(text: str) -> list[tuple[int, int]]:
    """Places of the literals that sensitive names get, directly or by way of other names."""
    found = list(pairs(text))
    score: dict[str, int] = {}
    gets: dict[str, list[int]] = {}  # the assignments to each name
    for i, (targets, _, _) in enumerate(found):
        for name in targets:
            if name not in score:
                score[name] = sensitivity(name)
            gets.setdefault(name, []).append(i)
    of = [0] * len(found)  # the score of each assignment: of the most sensitive name that gets it, at length
    queue = [n for n in score if score[n] >= 2]
    while queue:  # a sensitive name makes what it takes its value from sensitive
        name = queue.pop()
        for i in gets[name]:
            if of[i] < score[name]:
                of[i] = score[name]
                for source in found[i][2]:
                    if source in score and score[source] < score[name]:
                        score[source] = score[name]
                        queue.append(source)
    out = {(a, b) for i, (_, literals, _) in enumerate(found) for value, a, b in literals if literal_score(of[i], value) >= LEAST_SCORE}
    return sorted(out)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans in code points: leftmost, not overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every whole text of ``docs(doc_id, text)``; null is empty.

    Texts without a span have counts 0, an empty ``spans`` and the digest of the
    empty string; spans of equal start go by kind, then end; a text costs its length,
    whatever is in it; repeats repeat; no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = text or ""
                    base = base_spans(text)
                    extra = [("lexed", a, b) for a, b in lexed(text)]
                    n = Counter(k for k, _, _ in base)
                    digest = hashlib.sha256(listed(base).encode()).hexdigest()
                    out.append((doc_id, n["assign"], n["access"], n["hex"], digest, listed(base + extra), len(extra)))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
                names = [x.split()[0] for x in SCANNED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)
