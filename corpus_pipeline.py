"""A corpus pipeline: each stage works on all that its predecessor kept.

1. Language ID: a model learns from the labelled documents. Those without a letter go, which
   have no language, and those in none of the learned languages: no language's code is shorter
   than the plain bytes, with ``ALLOWANCE`` bits for a text too short to tell. With no labelled
   text to learn from, all with letters stay.
2. SimHash near-dedup: one document of each group stays.
3. Benchmark decontamination: documents with a window of a benchmark item go.
4. Secret scans: secrets give way to their kind in brackets, and n_chars follows.
5. Best-fit packing: pieces of the documents with their place in a sequence.

All stages but the last return the columns they get. Null texts are rejected by stage 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightrow.llm import decontaminate, langid, packing, secrets, simhash
from brightrow.llm.common import numbered_columns, pick, remainder
from brightrow.llm.queries import vocabulary
from brightrow.session import durable

BYTE_BITS = 8
ALLOWANCE = 64


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(pick(docs, "doc_id", "text", "lang").where(remainder(F.col("doc_id"), 4) != 2))
    plain = numbered_columns(docs)
    text = f"_{docs.columns.index('text')}"
    if model.languages:
        found = langid.identify(plain, model, text, tuple(plain.columns)).where(F.col("lang_pred") != langid.UNKNOWN)
        excess = (F.col("bits_per_byte") - BYTE_BITS) * F.octet_length(text)
        found = found.where(excess <= ALLOWANCE)
    else:
        found = langid.letters(plain, text, tuple(plain.columns)).where("has_letter")
    return found.select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = numbered_columns(docs)
    text, size = (f"_{docs.columns.index(c)}" for c in ("text", "n_chars"))
    found = secrets.redact_secrets(plain, text, tuple(c for c in plain.columns if c != text))
    found = found.withColumn(size, F.length(text).cast("long"))
    return found.select(*plain.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

# The stages use models, hashes and tokenizers that SQL cannot express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage kept is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
