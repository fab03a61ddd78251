"""Ranking of the alternatives for each span, with windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..sources.grammar_json import NON_PAST


def aligned(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """Every match that lies exactly on a matched span, with its text as ``source``; counters that follow no number lose that flag."""
    on = spans.where("matched").select("doc_id", "start", "len", F.col("surface").alias("source")).join(matches, ["doc_id", "start", "len"])
    stale = fl.has_flag(F.col("flags"), fl.COUNTER) & ~F.col("after_number")
    return on.withColumn("flags", F.when(stale, F.col("flags").bitwiseAND(F.lit(~fl.COUNTER))).otherwise(F.col("flags")))


def ranked(candidates: DataFrame) -> DataFrame:
    """Adds ``rank`` (1 is the primary entry) to the candidates of each (doc_id, start, len), less those that go.

    Within an entry that has exact and inexact candidates all count as exact; an
    entry's only verb candidate goes if it is the plain non-past and the entry
    also has a candidate that is no verb.
    """
    span = ["doc_id", "start", "len"]
    entry = Window.partitionBy(*span, "entry_id")
    first = F.get("chain", F.lit(0))
    verb = F.size("chain") > 0
    x = candidates.withColumns({
        "inexact": F.min("inexact").over(entry), "n_verbs": F.sum(verb.cast("int")).over(entry), "n_plain": F.sum((~verb).cast("int")).over(entry),
        "form0": F.coalesce(first["form"], F.lit(0)), "tense0": F.coalesce(first["tense"], F.lit(0)), "type0": F.coalesce(first["verb_type"] + 1, F.lit(0)),
    })
    plain_verb = verb & (F.col("tense0") == NON_PAST) & (F.col("form0") == 0) & (F.col("n_verbs") == 1) & (F.col("n_plain") > 0)
    order = Window.partitionBy(*span).orderBy(
        "inexact", fl.has_flag(F.col("flags"), fl.IS_NAME), F.desc(F.col("flags").bitwiseAND(F.lit(fl.RANKED))), "entry_id", "form0", "type0", "tense0", "ord"
    )
    kept = x.where(~plain_verb).withColumn("rank", F.row_number().over(order))
    return kept.drop("n_verbs", "n_plain", "form0", "tense0", "type0")
