"""Result rows: dictionary forms, readings, labels, senses, and renderings of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions.kana import strip_suffix_unified
from ..plans.grammar import Grammar, conjugation_label, twins
from .lexicon import all_pos

NONE = "-"
CONJUGATION_MARK = "\x01"


def tense_array(grammar: Grammar) -> Column:
    names = [r[1] for r in sorted(grammar.tenses.collect())]  # about thirty
    return F.array(*map(F.lit, names))


def readings(candidates: DataFrame, entries: DataFrame, grammar: Grammar) -> DataFrame:
    """Adds ``reading`` to candidates ``(doc_id, start, len, source, src_len, flags, entry_id, chain, rank)``.

    Null for what is itself a reading and for entries without kanji; plain words
    take the first reading; verbs the first reading that has the type's ending,
    with the matched tail; failing that, by a type of the same name with the
    leading ideograph's kana put in.
    """
    key = ["doc_id", "start", "len", "rank"]
    e = entries.select(F.col("id").alias("entry_id"), F.col("readings").alias("all_readings"))
    c = candidates.join(e, "entry_id")
    c = c.withColumns({
        "type0": F.get("chain", F.lit(0))["verb_type"], "conj0": F.get("chain", F.lit(0))["conj"],
        "tail": F.substring(F.col("source"), F.col("src_len") + 1, F.col("len") - F.col("src_len")),
    })
    verbs = c.where((F.size("chain") > 0) & ~fl.has_flag(F.col("flags"), fl.PRONOUNCE)).select(*key, "type0", "conj0", "tail", F.posexplode("all_readings").alias("r_ord", "r"))
    ends = grammar.removes()
    same = verbs.join(F.broadcast(ends), verbs["type0"] == ends["type_id"]).withColumn("stem", strip_suffix_unified(F.col("r"), F.col("remove_suffix")))
    same = same.where("stem IS NOT NULL").select(*key, "r_ord", F.lit(0).alias("way"), F.col("type_id").alias("twin"), "conj", F.concat("stem", "tail").alias("reading"))
    names = grammar.types.select(F.col("type_id").alias("type0"), F.col("name").alias("name0"))
    t = twins(grammar).withColumnsRenamed({"type_id": "type0", "conj": "conj0"})
    other = verbs.join(F.broadcast(names), "type0").join(F.broadcast(t), ["type0", "conj0"])
    other = other.join(F.broadcast(ends), (F.col("name0") == F.col("name")) & (F.col("type0") != F.col("type_id")))
    other = other.withColumn("stem", strip_suffix_unified(F.col("r"), F.col("remove_suffix"))).where("stem IS NOT NULL AND length(tail) >= 1")
    rest = F.substring(F.col("tail"), F.lit(2), F.length("tail"))
    other = other.select(*key, "r_ord", F.lit(1).alias("way"), F.col("type_id").alias("twin"), "conj", F.concat("stem", "substitution", rest).alias("reading"))
    best = same.unionByName(other).groupBy(*key).agg(F.min_by("reading", F.struct("r_ord", "way", "twin", "conj")).alias("verb_reading"))
    out = c.join(best, key, "left")
    own = F.when(fl.has_flag(F.col("flags"), fl.PRONOUNCE) | (F.size("all_readings") == 0), F.lit(None).cast("string"))
    return out.withColumn("reading", own.when(F.size("chain") == 0, F.get("all_readings", F.lit(0))).otherwise(F.col("verb_reading"))).select(*candidates.columns, "reading")


def entries_of_spans(ranked: DataFrame, entries: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per span and alternative: ``(doc_id, start, len, rank, headword, reading, conjugation, pos, senses, flags)``.

    Candidates whose entry is missing are dropped.
    """
    read = readings(ranked, entries, grammar)
    first = F.get("chain", F.lit(0))["verb_type"]
    formed = read.withColumn("type0", first).join(F.broadcast(grammar.first_removes().withColumnRenamed("type_id", "type0")), "type0", "left")
    headword = F.when(first.isNull(), F.col("surface")).otherwise(F.concat("surface", F.coalesce("first_remove", F.lit(""))))
    labelled = formed.join(entries.select(F.col("id").alias("entry_id"), "senses"), "entry_id")
    return labelled.select(
        "doc_id", "start", "len", "rank", headword.alias("headword"), "reading", conjugation_label(F.col("chain"), tense_array(grammar)).alias("conjugation"),
        all_pos(F.col("senses")).alias("pos"), "senses", fl.flag_names(F.col("flags")).alias("flags"), "entry_id",
    )


def segments(spans: DataFrame, alternatives: DataFrame) -> DataFrame:
    """One row per segment: ``(doc_id, start, len, surface, reading, matched, entries)``, the reading being the primary entry's."""
    body = F.struct("rank", "headword", "reading", "conjugation", "pos", "senses", "flags")
    grouped = alternatives.groupBy("doc_id", "start", "len").agg(F.sort_array(F.collect_list(body)).alias("entries"))
    out = spans.join(grouped, ["doc_id", "start", "len"], "left")
    none = F.array().cast(grouped.schema["entries"].dataType)
    return out.select("doc_id", "start", "len", "surface", F.get("entries", F.lit(0))["reading"].alias("reading"), "matched", F.coalesce("entries", none).alias("entries"))


def result_json(segs: DataFrame) -> DataFrame:
    """One nested JSON document per text, as sinks take it."""
    one = F.struct("start", "len", "surface", "reading", "matched", F.transform("entries", lambda e: e.dropFields("rank")).alias("entries"))
    whole = segs.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("segments"))
    return whole.select("doc_id", F.to_json(F.struct("segments"), {"ignoreNullFields": "false"}).alias("json"))


def _first_glosses(e: Column, most: int | None = None) -> Column:
    glosses = F.coalesce(F.get(e["senses"], F.lit(0))["glosses"], F.array().cast("array<string>"))
    return F.array_join(F.slice(glosses, 1, most) if most else glosses, "; ")


def listing(segs: DataFrame, most: int | None = None) -> DataFrame:
    """Segments as lines of text; with ``most``, that many alternatives with one gloss each and how many more there are."""
    none = lambda c: F.coalesce(c, F.lit(NONE))
    head = F.concat(F.lit("start="), F.col("start"), F.lit(" len="), F.col("len"), F.lit(" "), F.col("surface"))
    head = F.when(F.col("matched"), F.concat(head, F.lit(" matched reading="), none(F.col("reading")))).otherwise(F.concat(head, F.lit(" unmatched")))
    shown = F.slice("entries", 1, most) if most else F.col("entries")
    lines = F.transform(
        shown, lambda e: F.concat(F.lit("    "), e["headword"], F.lit(" ("), none(e["conjugation"]), F.lit(") ["), none(e["reading"]), F.lit("] "), _first_glosses(e, 1 if most else None))
    )
    more = F.when(F.size("entries") > (most or 1 << 30), F.concat(F.lit("    ... "), F.size("entries") - (most or 0), F.lit(" more")))
    return segs.select("doc_id", "start", F.concat_ws("\n", head, lines, more).alias("lines"))


def tooltip(segs: DataFrame) -> DataFrame:
    """All alternatives of a segment as flat text: label, headword with reading, numbered senses."""

    def block(e: Column) -> Column:
        label = F.when(e["conjugation"].isNotNull(), F.concat(F.lit(CONJUGATION_MARK), e["conjugation"]))
        head = F.when(e["reading"].isNull(), e["headword"]).otherwise(F.concat(e["headword"], F.lit("【"), e["reading"], F.lit("】")))
        last = F.size(e["senses"]) - 1
        senses = F.transform(
            e["senses"],
            lambda s, i: F.concat(
                F.lit("("), F.array_join(s["pos"], ","), F.lit(") ("), i + 1, F.lit(") "), F.array_join(s["glosses"], "/"),
                F.when(F.array_contains(e["flags"], "common") & (i == last), F.lit("/(P)")).otherwise(F.lit("")),
            ),
        )
        return F.concat_ws("\n", label, head, senses)

    return segs.where("matched").select("doc_id", "start", F.array_join(F.transform("entries", block), "\n").alias("tooltip"))


def segment_at(segs: DataFrame, start: int) -> DataFrame:
    """The segment of each text that begins at a place, if one does."""
    return segs.where(F.col("start") == start)


def chip_class(segs: DataFrame) -> DataFrame:
    """How a segment is shown: by its primary entry's flags, else by its writing."""
    flags = F.get("entries", F.lit(0))["flags"]
    shown = (
        F.when(~F.col("matched"), "unmatched").when(F.array_contains(flags, "particle"), "particle").when(F.array_contains(flags, "counter"), "counter")
        .when(F.col("surface").rlike(r"[\x{4E00}-\x{9FFF}]"), "kanji").otherwise("kana")
    )
    return segs.select("doc_id", "start", "surface", shown.alias("chip"))


_KANA, _CJK = "[぀-ヿ]", "[㐀-䶿一-鿿豈-﫿々]"


def colour_runs(line: str) -> list[tuple[str, str]]:
    """A tooltip line as (text, kind) runs: conj, paren (nested), kana, kanji or text."""
    import re

    if line.startswith(CONJUGATION_MARK):
        return [(line[1:], "conj")] if len(line) > 1 else []
    japanese = re.compile(f"{_KANA}|{_CJK}|[【】]")
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(line):
        j = i + 1
        if line[i] == "(":
            depth = 1
            while j < len(line) and depth:
                depth += {"(": 1, ")": -1}.get(line[j], 0)
                j += 1
            kind = "paren"
        elif japanese.match(line[i]):
            while j < len(line) and japanese.match(line[j]) and line[j] != "【":
                j += 1
            kind = "kanji" if re.search(_CJK, line[i:j]) else "kana"
        else:
            while j < len(line) and line[j] != "(" and not japanese.match(line[j]):
                j += 1
            kind = "text"
        out.append((line[i:j], kind))
        i = j
    return out


def coloured(tooltips: DataFrame) -> DataFrame:
    """``(doc_id, start, line, run, text, kind)`` of every line of :func:`tooltip`; parentheses nest, so a Python function cuts them."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (d, s, i, j, text, kind)
                for d, s, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "tooltip")), strict=True)
                for i, line in enumerate(t.split("\n"))
                for j, (text, kind) in enumerate(colour_runs(line))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), *[pa.int32()] * 3, pa.string(), pa.string()]
            names = ["doc_id", "start", "line", "run", "text", "kind"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return tooltips.select("doc_id", "start", "tooltip").mapInArrow(run, "doc_id long, start int, line int, run int, text string, kind string")
