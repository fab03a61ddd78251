"""From grammar rows to resolved edges, the closure of conjugation chains, and twins.

The grammar is a dimension of a few hundred rows; everything here is joins and
one recursive query over it, done once, so that matching text needs one
equi-join on the joined suffix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kana import IDEOGRAPH, UNIFY_FROM, UNIFY_TO, strip_suffix_unified, unify
from ..sources.grammar_json import NON_PAST, POTENTIAL, REMOVE, STEM, TENSES, rows_of

MOST_LINKS = 5
#: Characters that a twin may put in place of a leading ideograph.
MOST_TWIN_CHARS = 3


@dataclass
class Grammar:
    """``types(type_id, name, is_adjective, remove_tense)``, ``edges(type_id, conj, tense, form, suffix, next_type)``, ``tenses(tense, tense_name)``."""

    types: DataFrame
    edges: DataFrame
    tenses: DataFrame

    def removes(self) -> DataFrame:
        """``(type_id, name, conj, remove_suffix)``: what a dictionary form loses, in order."""
        same = (F.col("e.tense") == F.col("t.remove_tense")) & (F.col("e.form") == 0) & (F.col("e.type_id") == F.col("t.type_id"))
        joined = self.edges.alias("e").join(F.broadcast(self.types).alias("t"), same)
        return joined.select("e.type_id", "t.name", "e.conj", F.col("e.suffix").alias("remove_suffix"))

    def first_removes(self) -> DataFrame:
        """``(type_id, first_remove)``: the ending that a dictionary form gets back."""
        return self.removes().groupBy("type_id").agg(F.min_by("remove_suffix", "conj").alias("first_remove"))


def intern_tenses(rows: DataFrame) -> DataFrame:
    """``(tense, tense_name)``: the fixed names, then others as they are first met."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame(list(enumerate(TENSES)), "tense int, tense_name string")
    others = rows.join(F.broadcast(fixed), "tense_name", "left_anti")
    met = others.groupBy("tense_name").agg(F.min(F.struct("type_id", "conj")).alias("met"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("met")) + len(TENSES) - 1  # a handful of names
    return fixed.unionByName(met.select(number.cast("int").alias("tense"), "tense_name"))


def resolve(rows: DataFrame) -> tuple[Grammar, DataFrame]:
    """The grammar with its links resolved, and the rows whose ``Next Type`` fits no type.

    A link goes to the first type of that name, in table order, with an ending
    (remove tense, plain form) that ends this row's suffix kana-insensitively; the
    ending is cut off.
    """
    tenses = intern_tenses(rows)
    named = rows.join(F.broadcast(tenses), "tense_name")
    own = F.max((F.col("tense") == REMOVE).cast("int")) == 1
    types = named.groupBy("type_id", "name", "is_adjective").agg(F.when(own, REMOVE).otherwise(NON_PAST).alias("remove_tense"))
    ends = named.alias("r").join(F.broadcast(types).alias("t"), "type_id").where("r.tense = t.remove_tense AND r.form = 0")
    ends = ends.select(F.col("type_id").alias("target"), F.col("r.name").alias("next_name"), F.col("conj").alias("target_conj"), F.col("suffix").alias("ending"))
    linked = named.where("next_name IS NOT NULL").join(F.broadcast(ends), "next_name")
    linked = linked.withColumn("rest", strip_suffix_unified(F.col("suffix"), F.col("ending"))).where("rest IS NOT NULL")
    first = Window.partitionBy("type_id", "conj").orderBy("target", "target_conj")
    linked = linked.withColumn("n", F.row_number().over(first)).where("n = 1").select("type_id", "conj", "target", "rest")
    edges = named.join(linked, ["type_id", "conj"], "left")
    unresolved = edges.where("next_name IS NOT NULL AND target IS NULL").select("type_id", "name", "conj", "next_name")
    edges = edges.select("type_id", "conj", "tense", "form", F.coalesce("rest", "suffix").alias("suffix"), F.col("target").alias("next_type"))
    return Grammar(types, edges, tenses), unresolved


def load(spark: SparkSession, text: str) -> Grammar:
    """A grammar from JSON, held in memory; unresolved links and zero-width cycles are errors."""
    rows = rows_of(spark, text).cache()
    grammar, unresolved = resolve(rows)
    bad = unresolved.limit(5).collect()
    if bad:
        raise ValueError(f"next types that fit no type: {[tuple(r) for r in bad]}")
    small = Grammar(*(_small(spark, df) for df in (grammar.types, grammar.edges, grammar.tenses)))
    rows.unpersist()
    _check_cycles(small.edges)
    return small


def _small(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A grammar table as a local relation: a few hundred rows, whatever the text."""
    return spark.createDataFrame(df.collect(), df.schema)


def _check_cycles(edges: DataFrame) -> None:
    """Stems without letters that lead round in a circle would never end."""
    step: dict[int, set[int]] = {}
    for r in edges.where(f"tense = {STEM} AND form = 0 AND suffix = '' AND next_type IS NOT NULL").collect():
        step.setdefault(r["type_id"], set()).add(r["next_type"])
    for start in step:
        seen, queue = set(), [start]
        while queue:
            for n in step.get(queue.pop(), ()):
                if n == start:
                    raise ValueError(f"stems of type {start} lead back to it without a letter")
                if n not in seen:
                    seen.add(n)
                    queue.append(n)


#: One text for Spark and DuckDB but for how arrays and structs are written.
CLOSURE_SQL = """
WITH RECURSIVE walk(type_id, suffix, chain, tenses, ord, next_type) AS (
    SELECT type_id, suffix, {one_link}, {one_tense}, {one_ord}, next_type FROM grammar_edges WHERE tense <> {remove}
  UNION ALL
    SELECT w.type_id, concat(w.suffix, e.suffix),
        CASE WHEN {skips} THEN w.chain ELSE {more_links} END, CASE WHEN {skips} THEN w.tenses ELSE {more_tenses} END,
        {more_ord}, e.next_type
    FROM walk w JOIN grammar_edges e ON e.type_id = w.next_type
    WHERE e.tense <> {remove} AND ({skips} OR e.next_type IS NULL OR {size} < {most})
        AND ({skips} OR NOT ({last} = {potential} AND e.tense = {potential}))
)
SELECT type_id, suffix AS suffix_raw, translate(suffix, '{from}', '{to}') AS suffix_key, {length} AS n_chars, chain, ord
FROM walk WHERE next_type IS NULL
"""


def closure_sql(spark: bool) -> str:
    """All chains from each type to a form that ends, over a view ``grammar_edges``.

    A plain stem after the first link leaves no link; at most five links; no
    potential directly after a potential; rows with the remove tense never match.
    ``ord`` has every row walked, and sorts as the chains are emitted.
    """
    if spark:
        link = "named_struct('verb_type', {0}.type_id, 'tense', {0}.tense, 'form', {0}.form, 'conj', {0}.conj)"
        parts = {
            "one_link": f"array({link.format('grammar_edges')})", "one_tense": "array(tense)", "one_ord": "array(conj)",
            "more_links": f"concat(w.chain, array({link.format('e')}))", "more_tenses": "concat(w.tenses, array(e.tense))",
            "more_ord": "concat(w.ord, array(e.conj))", "size": "size(w.chain)", "last": "element_at(w.tenses, -1)", "length": "length(suffix)",
        }
    else:
        link = "{{'verb_type': {0}.type_id, 'tense': {0}.tense, 'form': {0}.form, 'conj': {0}.conj}}"
        parts = {
            "one_link": f"[{link.format('grammar_edges')}]", "one_tense": "[tense]", "one_ord": "[conj]",
            "more_links": f"list_concat(w.chain, [{link.format('e')}])", "more_tenses": "list_append(w.tenses, e.tense)",
            "more_ord": "list_append(w.ord, e.conj)", "size": "len(w.chain)", "last": "w.tenses[-1]", "length": "length(suffix)",
        }
    skips = f"(e.next_type IS NOT NULL AND e.tense = {STEM} AND e.form = 0)"
    fixed = {"remove": REMOVE, "potential": POTENTIAL, "most": MOST_LINKS - 1, "skips": skips, "from": UNIFY_FROM.replace("'", "''"), "to": UNIFY_TO.replace("'", "''")}
    if spark:
        fixed["to"] = UNIFY_TO.replace("\\", "\\\\").replace("'", "\\'")
    return CLOSURE_SQL.format(**parts, **fixed)


def closure(grammar: Grammar) -> DataFrame:
    """``paths(type_id, suffix_raw, suffix_key, n_chars, chain, ord)``; see :func:`closure_sql`."""
    spark = grammar.edges.sparkSession
    return spark.sql(closure_sql(True).replace("grammar_edges WHERE", "{edges} AS grammar_edges WHERE").replace("JOIN grammar_edges e", "JOIN {edges} e"), edges=grammar.edges)


def counts(grammar: Grammar) -> DataFrame:
    """One row: types, rows and linked rows of the grammar."""
    return grammar.edges.agg(F.countDistinct("type_id").alias("types"), F.count("*").alias("rows_"), F.count("next_type").alias("linked"))


def twins(grammar: Grammar) -> DataFrame:
    """``(type_id, conj, substitution)``: kana in place of the ideograph that begins a row's suffix.

    Taken from the shortest row, of a type with the same name and with the same
    tense, form and link, whose suffix is as long or longer and ends alike; types
    are tried in order and substitutions of over three characters passed over.
    """
    named = grammar.edges.join(F.broadcast(grammar.types.select("type_id", "name")), "type_id")
    a, b = named.alias("a"), named.alias("b")
    pair = (
        (F.col("a.name") == F.col("b.name")) & (F.col("a.type_id") != F.col("b.type_id")) & (F.col("a.tense") == F.col("b.tense"))
        & (F.col("a.form") == F.col("b.form")) & F.col("a.next_type").eqNullSafe(F.col("b.next_type")) & F.col("a.suffix").rlike(rf"\A{IDEOGRAPH}")
    )
    n, m = F.length("a.suffix"), F.length("b.suffix")
    tails = unify(F.substring(F.col("a.suffix"), F.lit(2), n)) == unify(F.substring(F.col("b.suffix"), m - n + 2, m))
    found = a.join(b, pair).where((m >= n) & tails)
    want = m - n + 1
    found = found.select("a.type_id", "a.conj", F.col("b.type_id").alias("twin"), want.alias("want"), m.alias("m"), F.col("b.conj").alias("twin_conj"), F.col("b.suffix").alias("suffix"))
    shortest = Window.partitionBy("type_id", "conj", "twin").orderBy("m", "twin_conj")
    best = found.withColumn("k", F.row_number().over(shortest)).where((F.col("k") == 1) & (F.col("want") <= MOST_TWIN_CHARS))
    first = best.groupBy("type_id", "conj").agg(F.min_by(F.struct("suffix", "want"), "twin").alias("x"))
    return first.select("type_id", "conj", F.substring(F.col("x.suffix"), F.lit(1), F.col("x.want")).alias("substitution"))


def conjugation_label(chain: Column, tense_names: Column) -> Column:
    """A chain in words, shallowest link first, ``tense_names`` being an array by tense number; an empty label is null.

    Stems have no word; a non-past after the first link has none, but for the second link after a stem.
    """

    def words(link: Column, i: Column) -> Column:
        bare = (link["tense"] == STEM) | (
            (i > 0) & (link["tense"] == NON_PAST) & ((i > 1) | (F.get(chain, F.lit(0))["tense"] != STEM))
        )
        return F.concat_ws(
            " ",
            F.when(link["form"].bitwiseAND(F.lit(2)) != 0, F.lit("Negative")),
            F.when(link["form"].bitwiseAND(F.lit(1)) != 0, F.lit("Formal")),
            F.when(~bare, F.get(tense_names, link["tense"])),
        )

    label = F.array_join(F.filter(F.transform(chain, words), lambda x: x != ""), " ")
    return F.when(label != "", label)
