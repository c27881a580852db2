"""Token alignment against the libraries on whole texts and a plain walk."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from brightrow.llm import alignment
from brightrow.llm.queries import vocabulary

DOCS = "doc_id long, text string"
BITS = [
    "the", " ", "  ", "\n", "\t", "naïve", "日本語のテキスト", "🎉", "don't", "'s", "12345", "...", "<s>", "</s>", "<|endoftext|>",
    "<0x41>", "A", "antidisestablishmentarianism", "x" * 40, "é", "é", "\x00", " ", " ", "\r\n", "(", "),", "ß-",
    "Öffentlichkeit", "señor", " \n ", " ", "\x1c",
]


@pytest.fixture(scope="module")
def pair():
    return vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def found(texts, pair):
    known = alignment.Memory(*pair)
    v = known.vocabularies
    out = []
    for text in texts:
        a, _, b, _ = known.tokens([text])
        last_a, last_b = alignment.closed(np.cumsum(v.sizes_a[a]), np.cumsum(v.sizes_b[b]))
        written = alignment.in_groups(v, a, b, last_a, last_b)
        groups = b"".join([v.signs[i] for i in written])[:-1].decode()
        out.append((len(a), len(b), groups, list(zip(a[last_a].tolist(), b[last_b].tolist()))))
    return out


def test_random_texts_equal_the_libraries(pair):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) + rng.choice(("", " ", " ")) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["", " ", "▁", "a ▁b", " a", "a ", "\n", "a\n b", "a \nb", "<s> </s>", "日本語" * 500]
    want = brute.aligned(texts, *pair)
    for text, got, expected in zip(texts, found(texts, pair), want):
        assert got == expected, repr(text)
    v = alignment.vocabularies(*pair)
    links = np.array([v.key(a, b) for w in want for a, b in w[3]])
    assert np.isin(links, v.pairs).all()
    assert len(v.pairs) <= v.sizes_a.sum() + v.sizes_b.sum() + 2 * 256


def test_runs_equal_a_plain_walk():
    rng = random.Random(6)
    for _ in range(2000):
        size = rng.randint(1, 60)
        both = [x for x in range(1, size) if rng.random() < rng.choice((0.2, 0.9))]
        a = sorted({*both, *[x for x in range(1, size) if rng.random() < 0.1]} | {size})
        b = sorted({*both, *[x for x in range(1, size) if rng.random() < 0.1]} | {size})
        last_a, last_b = alignment.closed(np.array(a), np.array(b))
        assert [a[i] for i in last_a] == sorted(set(a) & set(b)) == [b[i] for i in last_b]


def test_memory_is_emptied_when_full(pair, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 2_000)
    texts = [f"word{i} other{i % 7} thing" for i in range(100)]
    assert found(texts, pair) == brute.aligned(texts, *pair)


def test_report(spark, folder, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "▁ no"), (902, "▁ no"), (903, "again and again"), (903, "again and again"), (None, "no id")]
    rows += [(904, "lorem ipsum " * 20_000), (905, "日本語" * 5_000), (906, "  \n ")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for clash in ("n_a", "links", "groups", "_0"):
        df = df.withColumn(clash, F.lit(1))
    df = df.select("*", F.lit(1).alias("TEXT"))
    whole = brute.aligned([t for _, t in rows], *pair)
    count = Counter(link for _, _, _, links in whole for link in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for (name, _), (n_a, n_b, groups, links) in zip(rows, whole):
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        n_best = sum(count[link] == best[link[1]] for link in links)
        want.append((name, n_a, n_b, len(links), len(links), n_best, sum(count[link] for link in links), digest))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in alignment.alignment_report(df, *pair).select(columns).collect()]
    assert Counter(map(str, got)) == Counter(map(str, want))
    listed = alignment.align(df, *pair).select("doc_id", "groups").collect()
    assert Counter(map(str, map(tuple, listed))) == Counter(str((n, w[2])) for (n, _), w in zip(rows, whole))
    empty = spark.createDataFrame([], DOCS)
    assert alignment.alignment_report(empty, *pair).collect() == []
