"""The contract queries of the text operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.spread import spread
from . import decontaminate, exact_dedup, html_text, packing, quality, repeats, secrets, simhash, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Whole columns of a table, for operators whose work is done where rows lie."""
    return spread(_table(spark, sf_dir, name).select(*columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir, "documents", "doc_id", "text"))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_report(_texts(spark, sf_dir, "documents", "doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_texts(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_texts(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_texts(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_texts(spark, sf_dir, "documents", "doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_texts(spark, sf_dir, "documents", "doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = exact_dedup.new_index(spark, exact_dedup.buckets_for(docs))
    out = exact_dedup.exact_duplicates(docs, index, batches=2)
    index.drop()  # of this query alone
    return out


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_texts(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_suffix_repeats, op3_decontaminate, op4_toxicity, op5_quality,
        op6_secrets, op7_packing, op8_url_filter, op9_exact_dedup, op10_html_text,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op8_url_filter": url_filter.judge_sql(),
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY digest) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
            row_number() OVER (PARTITION BY digest ORDER BY doc_id DESC) = 1 AS kept, digest AS text_sha256
        FROM (SELECT doc_id, sha256({_LOWER}) AS digest FROM documents)""",
}
