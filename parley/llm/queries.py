"""Registered queries of the thirteen operators, on the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    bpe,
    decontaminate,
    dialogue,
    extract,
    groupjoin,
    language,
    nearcopies,
    prefixes,
    quality,
    repeats,
    spelling,
    tokencount,
    warc,
)
from parley.llm.common import table

MAX_TOKENS = 4096


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.components_of(table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.captures(table(spark, folder, "pages"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokencount.count_tokens(
        table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.main_text(table(spark, folder, "pages"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.report(table(spark, folder, "documents"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.repair(table(spark, folder, "conversations"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return groupjoin.components_of(table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(table(spark, folder, "conversations"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(table(spark, folder, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_minhash_dedup,
        op2_decontamination,
        op3_warc,
        op4_token_counts,
        op5_bpe_round_trip,
        op6_html_extraction,
        op7_suffix_dedup,
        op8_language_id,
        op9_chat_formatting,
        op10_quality_rules,
        op11_ngram_join,
        op12_prefix_trie,
        op13_spelling_variants,
    )
}
ORACLE: dict[str, str] = {
    "op1_minhash_dedup": nearcopies.ORACLE,
    "op2_decontamination": decontaminate.ORACLE,
    "op11_ngram_join": groupjoin.ORACLE,
    "op12_prefix_trie": prefixes.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
