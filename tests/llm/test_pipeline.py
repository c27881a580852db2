"""The pipeline, stage by stage, against plain versions; and its registration."""

import zlib

import brute
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from brightrow.llm import secrets
from brightrow.llm.queries import QUERIES, SQL, vocabulary


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_registration():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame(
        [(100001, None, None, "x", 0), (100002, "12 34 !", "en", "x", 7), (100003, "", None, None, 0)], docs.schema
    )
    docs = docs.unionByName(more).withColumn("lang_pred", F.lit(1)).withColumn("_key", F.lit(2))
    benchmark = rows_of(spark.read.parquet(f"{folder}/benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        given = rows_of(docs)
        found = stage(spark, docs, folder)
        got = rows_of(found)
        if name == "best-fit packing":
            break
        assert found.columns == docs.columns
        if name == "language ID":
            want = [r for r in given if r[1] and any(map(str.isalpha, r[1]))]
        elif name == "SimHash near-dedup":
            _, groups = brute.simhash_groups([r[:2] for r in given])
            want = [given[min(g, key=lambda i: given[i][0])] for g in groups]
        elif name == "benchmark decontamination":
            hits = brute.contamination([r[:2] for r in given], benchmark)
            want = [r for r, h in zip(given, hits) if not h[1]]
        else:
            want = [(r[0], redacted(r[1]), *r[2:4], len(redacted(r[1])), *r[5:]) for r in given]
        assert sorted(got, key=str) == sorted(want, key=str), name
        docs = spark.createDataFrame(got, docs.schema)
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), []
    for row in given:
        ids = np.array([*tokenizer.encode(row[1], add_special_tokens=False).ids, 0], dtype="<u4")
        pieces += [(row[0], i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(r[:5] for r in got) == sorted(pieces)
    assert len({r[5] for r in got}) == len(brute.best_fit([p[3] for p in pieces], 2048))


def redacted(text):
    out, at = "", 0
    for a, k, b in brute.rule_spans(text, secrets.RULES):
        if b > at:
            out += text[at : max(a, at)] + (f"[{secrets.RULES[k].kind}]" if a >= at else "")
            at = b
    return out + text[at:]


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_documents_stay_when_no_language_is_learned(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    more = spark.createDataFrame(
        [(100001, None, None, "x", 0), (100002, "12 34 !", None, "x", 7), (100003, "é", None, None, 1)], docs.schema
    )
    docs = docs.unionByName(more).withColumn("lang", F.lit(None).cast("string"))
    given = rows_of(docs)
    want = [r for r in given if r[1] and any(map(str.isalpha, r[1]))]
    got = rows_of(corpus_pipeline.identify_language(spark, docs, folder))
    assert len(want) > 10 and sorted(got, key=str) == sorted(want, key=str)


def test_texts_in_no_learned_language_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = rows_of(docs)
    lettered = [r for r in given if r[1] and any(map(str.isalpha, r[1]))]
    odd = [(100001, "漢字仮名交文" * 40, None, "x", 240), (100002, "漢字", None, "x", 2), (100003, "ω", None, "x", 1)]
    more = spark.createDataFrame(odd, docs.schema)
    got = rows_of(corpus_pipeline.identify_language(spark, docs.unionByName(more), folder))
    assert sorted(got, key=str) == sorted([*lettered, *odd[1:]], key=str)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
