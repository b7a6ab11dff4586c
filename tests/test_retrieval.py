"""Retrieval by many queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.operators import vector_index, vectors
from docframe.operators.vector_index import VectorIndex, decode, encode
from docframe.plans import QUERIES


def test_retrieval_takes_any_number_of_queries(spark):
    chunks = spark.createDataFrame([(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(30)], "chunk_id long, embedding array<float>")
    queries = spark.range(12_000).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    got = vectors.retrieve(chunks, queries, 2).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    assert got.count() == got.filter("n = 2 AND low = 1 AND high = 2").count() == 12_000


def test_retrieval_of_odd_rows(spark):
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0, None]), ("f", [-1.0, 0.0]), ("g", [1.0, 0.0, 0.0]), ("a", [1.0, 1.0]), (None, [3.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(7, [5.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "query_id long, embedding array<double>")
    got = sorted((r.rank, r.query_id, r.chunk_id, r.similarity) for r in vectors.retrieve(chunks, queries).collect())
    assert got == [(1, 7, None, 1.0), (2, 7, "a", 1.0), (3, 7, "b", 1.0), (4, 7, "a", 0.707107), (5, 7, "f", -1.0), (6, 7, "g", None)]
    assert vectors.retrieve(chunks, queries.limit(0)).count() == vectors.retrieve_approx(chunks.limit(0), queries).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_over_all_queries(spark, sf):
    exact, near = ({(r.query_id, r.chunk_id) for r in QUERIES[name](spark, f"/root/testdata/{sf}").collect()} for name in ("TK1_topk", "TK2_approx"))
    assert len({q for q, _ in near}) == len({q for q, _ in exact}) == spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    n = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").count()
    print(sf, "mean recall", len(exact & near) / len(exact))
    assert vector_index.REFINE * 10 <= n / 10, "at most a tenth of the vectors is scored exactly"
    assert len(exact & near) >= 0.9 * len(exact)


def test_rounds_find_what_one_round_finds(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    queries = chunks.withColumnRenamed("chunk_id", "query_id")
    many, one = (sorted(map(tuple, vectors.retrieve(chunks, queries, 3, n).collect())) for n in (1, 99))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = np.round(x @ x.T, 6)
    assert many == one and len(one) == 9000
    assert all(abs(cosines[q, c] - s) < 2e-6 for q, c, s, _ in one[:300])


def clustered(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(30, dims))
    return [(k, (centres[k % 30] + rng.normal(size=dims) * 0.3).tolist()) for k in range(n)]


def test_an_index_is_kept(spark, tmp_path):
    """Written once, read by another session; later rows are found; clustered vectors take few cells."""
    rows, path = clustered(6000, 1), str(tmp_path / "index")
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(6)
    VectorIndex.create(chunks, path)
    index = VectorIndex(spark.newSession(), path)
    parts = index.lists().selectExpr("cell", "part", "size(ids) AS n").collect()
    assert sum(p.n for p in parts) == 6000 and max(p.n for p in parts) <= vector_index.PART and len({p.part for p in parts}) == len(parts)
    assert len(index.centroids()) == 77  # cells grow with the table

    def recall(all_rows, share):
        q = all_rows[::20]
        x, ids = np.array([v for _, v in all_rows]), np.array([i for i, _ in all_rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        exact = {i: set(ids[np.argsort(-(x @ x[i]))[:10]]) for i in range(0, len(x), 20)}
        asked = index.spark.createDataFrame([(i, v) for i, v in q], "query_id long, embedding array<double>")
        found = index.search(asked, 10, share=share, round_bytes=200_000).collect()
        assert max(r.rank for r in found) == 10 and len(found) == 10 * len(q)
        return np.mean([r.chunk_id in exact[r.query_id] for r in found])

    assert recall(rows, 0.15) >= 0.9
    more = [(6000 + k, v) for k, v in clustered(900, 2)]
    index.add(spark.createDataFrame(more, "chunk_id long, embedding array<double>"))
    index.add(spark.createDataFrame([], "chunk_id long, embedding array<double>"))
    parts = index.lists().select("part").collect()
    assert len({p.part for p in parts}) == len(parts)
    assert recall(rows + more, 0.15) >= 0.9
    with pytest.raises(ValueError, match="takes no others"):
        index.add(spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<double>"))


def test_a_common_vector_fills_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 64)
    rows = [(k, [1.0, 2.0, 2.0]) for k in range(1000)] + [(k, [np.cos(k), np.sin(k), 0.1]) for k in range(1000, 1300)]
    chunks = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "chunk_id long, embedding array<double>").repartition(3)
    index = VectorIndex.create(chunks, str(tmp_path / "index"))
    assert index.lists().selectExpr("max(size(ids))").first()[0] <= 64
    found = index.search(spark.createDataFrame([(7, [1.0, 2.0, 2.0]), (8, None), (9, [0.0, 0.0, 0.0]), (10, [1.0])], "query_id int, embedding array<double>"), 5).collect()
    assert [(r.query_id, r.rank, r.similarity) for r in sorted(found, key=lambda r: r["rank"])] == [(7, k, 1.0) for k in range(1, 6)]


def test_codes_are_near():
    x = np.random.default_rng(2).normal(size=(33, 7)) * 0.1
    codes, scale = encode(x)
    assert len(codes) == 116 and np.abs(decode(codes, scale, x.shape) - x).mean() < 0.01
