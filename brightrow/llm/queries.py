"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightrow.llm import (
    alignment,
    conversations,
    decontaminate,
    embeddings,
    katz,
    langid,
    licenses,
    links,
    packing,
    secrets,
    simhash,
    suffix,
    tokens,
)
from brightrow.llm.common import pick, remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


@query("op2_license_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = pick(table(spark, folder, "documents"), "doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_embedding_pivots")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


@query("op8_repeated_strings")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, folder, "documents"))


@query("op9_simhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_katz_backoff")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score_texts(table(spark, folder, "documents"), remainder(F.col("doc_id"), 7) == 2)


@query("op11_url_filters", links.pages_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return links.judge_pages(table(spark, folder, "pages"))


@query("op12_token_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return alignment.alignment_report(documents, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(table(spark, folder, "conversations")))
