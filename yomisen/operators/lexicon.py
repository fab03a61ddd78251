"""From raw entries to the keyed lexicon and the entry table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions.kana import strip_suffix_unified, unify
from ..plans.grammar import Grammar
from .matching import key_lengths, key_prefixes, probes

#: Parts of speech behind the particle and counter flags.
PARTICLE_POS, COUNTER_POS, ARCHAIC = ("prt", "conj"), ("ctr", "suf"), "arch"


def all_pos(senses: Column) -> Column:
    """Parts of speech over all senses, in the order first seen."""
    return F.array_distinct(F.flatten(F.transform(senses, lambda s: s["pos"])))


def counter_flag(pos: Column, misc: Column) -> Column:
    """A counter or suffix that isn't archaic."""
    return F.arrays_overlap(pos, F.array(*map(F.lit, COUNTER_POS))) & ~F.array_contains(misc, ARCHAIC)


def entry_flags(entry: DataFrame) -> DataFrame:
    """Adds ``pos`` and ``shared_flags``, the flags that all forms of an entry have."""
    misc = F.flatten(F.transform("senses", lambda s: s["misc"]))
    common_line = F.exists("kanji", lambda f: f["has_priority"]) | F.exists("readings", lambda f: f["has_priority"])
    particle = F.arrays_overlap(F.col("pos"), F.array(*map(F.lit, PARTICLE_POS)))
    shared = fl.flag_if(common_line, fl.COMMON_LINE).bitwiseOR(fl.flag_if(particle, fl.PARTICLE)).bitwiseOR(fl.flag_if(counter_flag(F.col("pos"), misc), fl.COUNTER))
    return entry.withColumn("pos", all_pos(F.col("senses"))).withColumn("shared_flags", shared)


def headwords(entries: DataFrame) -> DataFrame:
    """``(seq, entry_id, form_ord, surface, flags, pos)``: kanji forms, then readings, of each raw entry."""
    some = entry_flags(entries)
    n = F.size("kanji")
    forms = some.select("seq", "id", "pos", "shared_flags", n.alias("n"), F.posexplode(F.concat("kanji", "readings")).alias("form_ord", "form"))
    reading = F.col("form_ord") >= F.col("n")
    primary = F.col("form_ord") == 0  # the first kanji form, or the first reading of an entry without
    flags = (
        F.col("shared_flags").bitwiseOR(fl.flag_if(primary, fl.PRIMARY)).bitwiseOR(fl.flag_if(reading & (F.col("n") > 0), fl.PRONOUNCE))
        .bitwiseOR(fl.flag_if(F.col("form.has_priority"), fl.COMMON))
    )
    return forms.select("seq", F.col("id").alias("entry_id"), "form_ord", F.col("form.text").alias("surface"), flags.alias("flags"), "pos")


def verb_types(heads: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per headword and annotated type: ``(…, annotated_id, annotated_name)``; a name may stand for several types."""
    tagged = heads.select("*", F.posexplode("pos").alias("pos_ord", "code"))
    named = grammar.types.select(F.col("type_id").alias("annotated_id"), F.col("name").alias("annotated_name"))
    return tagged.join(F.broadcast(named), F.col("code") == F.col("annotated_name")).drop("code")


def stems(heads: DataFrame, grammar: Grammar, v5_fallback: bool = True) -> DataFrame:
    """``(seq, entry_id, form_ord, stem_ord, surface, flags, verb_type, by_fallback)``: what is left of headwords without their endings.

    Every type with an annotated type's name is tried; with ``v5_fallback`` also
    every other v5 type whose name is as long, as dictionaries mix those up.  The
    first ending that fits counts, empty stems stay, repeats of stem and type go.
    """
    tagged = verb_types(heads, grammar)
    ends = grammar.removes().select("type_id", F.col("name").alias("candidate"), F.col("conj").alias("end_ord"), "remove_suffix")
    exact = F.col("annotated_name") == F.col("candidate")
    mixed_up = F.startswith(F.col("annotated_name"), F.lit("v5")) & F.startswith(F.col("candidate"), F.lit("v5")) & (
        F.length("annotated_name") == F.length("candidate")
    )
    tried = tagged.join(F.broadcast(ends), (exact | mixed_up) if v5_fallback else exact)
    tried = tried.withColumn("stem", strip_suffix_unified(F.col("surface"), F.col("remove_suffix"))).where("stem IS NOT NULL")
    one = Window.partitionBy("seq", "entry_id", "form_ord", "stem", "type_id").orderBy("pos_ord", "annotated_id", "end_ord")
    first = Window.partitionBy("seq", "entry_id", "form_ord", "pos_ord", "annotated_id", "type_id").orderBy("end_ord")
    kept = tried.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("k", F.row_number().over(one)).where("k = 1")
    return kept.select(
        "seq", "entry_id", "form_ord", F.array("pos_ord", "annotated_id", "type_id").alias("stem_ord"), F.col("stem").alias("surface"), "flags",
        F.col("type_id").alias("verb_type"), (~exact).alias("by_fallback"),
    )


def lexicon(heads: DataFrame, stemmed: DataFrame) -> DataFrame:
    """``(key, key_chars, surface, flags, verb_type, entry_id, ord)``: each distinct record under its key, in order of insertion.

    ``ord`` sorts records as they were met: entries in order, each form's headword before its stems.
    """
    plain = heads.select("seq", "entry_id", "form_ord", F.array().cast("array<int>").alias("stem_ord"), "surface", "flags", F.lit(None).cast("int").alias("verb_type"))
    both = plain.unionByName(stemmed.drop("by_fallback"))
    met = F.min(F.struct("seq", "form_ord", "stem_ord")).alias("ord")
    keyed = both.withColumn("key", unify(F.col("surface")))
    out = keyed.groupBy("key", "surface", "flags", "verb_type", "entry_id").agg(met)
    return out.select("key", F.length("key").alias("key_chars"), "surface", "flags", "verb_type", "entry_id", "ord")


def entry_table(entries: DataFrame) -> DataFrame:
    """``(id, readings, senses)``; readings only where there are kanji."""
    kept = F.when(F.size("kanji") > 0, F.transform("readings", lambda r: r["text"])).otherwise(F.array().cast("array<string>"))
    return entries.select("id", kept.alias("readings"), "senses")


def build_report(parsed_count: Column, lex: DataFrame, entries: DataFrame, stemmed: DataFrame, skipped: int = 0) -> DataFrame:
    """One row of counts: keys, records, entries, stems by kind, skipped entries."""
    a = lex.agg(F.countDistinct("key").alias("keys"), F.count("*").alias("records"))
    b = entries.agg(F.count("*").alias("entries"))
    c = stemmed.agg(
        F.count_if(~F.col("by_fallback")).alias("exact_stems"), F.count_if("by_fallback").alias("v5_fallback_stems"), F.count_if(F.col("surface") == "").alias("empty_stems")
    )
    return a.crossJoin(b).crossJoin(c).withColumn("skipped", parsed_count if parsed_count is not None else F.lit(skipped).cast("long"))


def needed_entries(entries: DataFrame, texts: DataFrame, grammar: Grammar) -> DataFrame:
    """The entries that texts can reach: a form occurs in one, or a conjugable form without an ending does.

    The empty key is always wanted, as some verbs leave nothing.
    """
    heads = headwords(entries)
    conjugable = F.exists("pos", lambda p: p.rlike("^(?:v|adj-)"))
    ends = grammar.removes().select(unify(F.col("remove_suffix")).alias("ending")).where("ending <> ''").distinct()
    own = heads.select("entry_id", unify(F.col("surface")).alias("key"))
    key = unify(F.col("surface"))
    cut = heads.where(conjugable).join(F.broadcast(ends), F.endswith(key, F.col("ending")))
    cut = cut.select("entry_id", F.substring(key, F.lit(1), F.length(key) - F.length("ending")).alias("key"))
    wanted = own.union(cut).distinct()
    keys = wanted.withColumn("key_chars", F.length("key")).where("key <> ''")
    lengths = key_lengths(keys)
    grams = probes(texts, lengths, prefixes=key_prefixes(keys, lengths)).select("key").distinct()
    found = wanted.join(grams, "key", "left_semi").union(wanted.where("key = ''").select("key", "entry_id")).select("entry_id").distinct()
    return entries.join(found, entries["id"] == found["entry_id"], "left_semi")
