"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbitree.llm.chat import CHAT_SQL, format_chats
from orbitree.llm.decontaminate import contaminated
from orbitree.llm.html import extract_text, train_on
from orbitree.llm.licenses import license_report
from orbitree.llm.line_dedup import line_dedup_report
from orbitree.llm.merkle import manifest, manifest_sql
from orbitree.llm.mixing import mix, mix_sql
from orbitree.llm.near_dedup import near_duplicates
from orbitree.llm.oracles import decontamination_sql, line_dedup_sql, near_dedup_sql, phrases_sql, quality_sql
from orbitree.llm.phrases import repeated_phrases
from orbitree.llm.quality import quality
from orbitree.llm.secrets import secret_report
from orbitree.llm.shared import table
from orbitree.llm.trie import TRIE_SQL, prefix_trie
from orbitree.llm.urls import judge_urls, listed_by_words, rule_table, url_sql


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated line runs of every document: lines, lines removed and a digest of the rest."""
    return line_dedup_report(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts by kind, digest of the base spans, all spans."""
    return secret_report(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a model trained on a bounded sample of the pages."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, train_on(pages))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words of every document by windows of 50 words, and a digest of the rest."""
    return repeated_phrases(table(spark, sf_dir, "documents")).drop("spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix under the standard weights, with their copies."""
    return mix(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    return license_report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of benchmark items in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality columns and verdict of every document."""
    return quality(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with sums over its subtree."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, rule_table(spark), listed_by_words(pages))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the check of tampered texts."""
    return manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_line_dedup, op2_chat_formatting, op3_secret_scan, op4_html_extraction, op5_near_dedup, op6_substring_dedup, op7_mixing, op8_license_scan, op9_decontamination, op10_quality_rules, op11_prefix_trie, op12_url_filters, op13_merkle_manifest]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup_sql(),
        "op2_chat_formatting": CHAT_SQL,
        "op5_near_dedup": near_dedup_sql(),
        "op6_substring_dedup": phrases_sql(),
        "op7_mixing": mix_sql(),
        "op9_decontamination": decontamination_sql(),
        "op10_quality_rules": quality_sql(),
        "op11_prefix_trie": TRIE_SQL,
        "op12_url_filters": url_sql(),
        "op13_merkle_manifest": manifest_sql(),
    }
