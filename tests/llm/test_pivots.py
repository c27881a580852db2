"""The pivot index at growing sizes: candidates per vector stay level, recall stays high."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightrow.llm import embeddings


def near_pairs(n, seed):
    """Half of the vectors, and one partner for each at a cosine from the threshold to 0.99."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n // 2, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.93, 0.99, (n // 2, 1))
    return np.vstack([x, c * x + np.sqrt(1 - c * c) * z]).astype(np.float32)


def test_candidates_level_and_recall(spark):
    per_vector, recalls = [], []
    for n in (1_000, 4_000, 9_000):
        vectors = near_pairs(n, n)
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
        nodes = df.selectExpr("vec_id AS node", "label", "size(embedding) AS size", "1L AS copies", "embedding AS vector")
        pivots = embeddings.choose_pivots(nodes, embeddings.pivots_for(nodes))
        lists = embeddings.in_lists(embeddings.describe(nodes, pivots))
        sizes = lists.groupBy("p", "q").count()
        per_vector.append(sizes.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] / n)
        got = sum(r["n_links"] for r in embeddings.near_vectors(df).collect())
        unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
        want = sum(int((unit[a : a + 1_000] @ unit.T >= 0.93).sum()) for a in range(0, n, 1_000)) - n
        recalls.append(got / want)
    assert min(recalls) >= 0.9, recalls
    assert per_vector[2] < 2 * per_vector[0], per_vector


@pytest.mark.parametrize("at_once, batch", [(65_536, 8_192), (50, 7), (1, 1)])
def test_batches_of_lists_make_no_difference(spark, monkeypatch, at_once, batch):
    vectors = near_pairs(300, 3)
    vectors[:60] = vectors[0] + 0.02 * vectors[:60]
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, embeddings.near_vectors(df, tile=8).collect()))
    monkeypatch.setattr(embeddings, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(embeddings, "BATCH_OF_LISTS", batch)
    assert sorted(map(tuple, embeddings.near_vectors(df, tile=16).collect())) == whole
