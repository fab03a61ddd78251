"""The whole analysis of texts with a dictionary and a grammar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.grammar import Grammar, closure
from ..plans.store import stored
from . import assemble, lexicon, matching, rank, segment


@dataclass
class Dictionary:
    """A keyed lexicon, its entries, the grammar and its closure."""

    lexicon: DataFrame
    entries: DataFrame
    grammar: Grammar
    paths: DataFrame


def build(raw: DataFrame, grammar: Grammar, v5_fallback: bool = True) -> Dictionary:
    """From raw entries ``(seq, id, kanji, readings, senses)``."""
    heads = lexicon.headwords(raw)
    lex = lexicon.lexicon(heads, lexicon.stems(heads, grammar, v5_fallback))
    return Dictionary(lex, lexicon.entry_table(raw), grammar, closure(grammar))


@dataclass
class Parsed:
    matches: DataFrame
    solved: DataFrame
    spans: DataFrame
    ranked: DataFrame
    alternatives: DataFrame
    segments: DataFrame


def parse(texts: DataFrame, dictionary: Dictionary, hints: DataFrame | None = None) -> Parsed:
    """``texts(doc_id, text)`` to segments; each step is a DataFrame of its own.

    Matches, paths and ranked candidates are read by several later steps, so each
    is computed once and stored.
    """
    found = matching.matches(texts, dictionary.lexicon, dictionary.paths)
    scored = stored(segment.scored(found, texts, hints))
    solved = stored(segment.paths(texts, segment.edges_of(scored)))
    spans = segment.spans(solved)
    ranked = stored(rank.ranked(rank.aligned(spans, scored)))
    alternatives = assemble.entries_of_spans(ranked, dictionary.entries, dictionary.grammar)
    return Parsed(scored, solved, spans, ranked, alternatives, assemble.segments(spans, alternatives))
